"""Named queries over the tables of a data folder."""

from __future__ import annotations

from graphloom.registry import Registry


def registries() -> list[Registry]:
    from graphloom.plans import general, graph, wiki

    return [general.registry, graph.registry, wiki.registry]
