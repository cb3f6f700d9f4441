"""python -m tests.llm.measure_wrappers FOLDER: how many of p2_found's pieces wrapper induction finds by itself.

Texts of one language are the pages of one host. A piece of content is an element whose texts are not all
template: headings h1 to h6, items li, code pre, code and syntaxhighlight, formulas math.
"""

import sys
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from graphloom.llm import markup, wrappers

KINDS = {**{f"h{k}": "heading" for k in range(1, 7)}, "li": "item", "pre": "code", "code": "code", "syntaxhighlight": "code", "math": "formula"}


def elements(node):
    for k in node.kids:
        kind = KINDS.get(k.tag)
        if kind:
            yield kind, " ".join(next(iter(x.texts)) for x in k.below() if x.tag == "#")
        yield from elements(k)


def main(folder: str) -> None:
    read = lambda name, *c: pq.read_table(f"{folder}/{name}.parquet", columns=list(c)).to_pylist()
    language = {r["id"]: (r["language"] or "").strip().lower() for r in read("pages", "id", "language")}
    hosts = defaultdict(dict)
    for r in read("revisions", "id", "page_id", "text"):
        if r["text"]:
            hosts[language.get(r["page_id"], "")][r["id"]] = r["text"]
    found, true = set(), set()
    for pages in hosts.values():
        root = wrappers.template(sorted(pages.values(), key=lambda t: wrappers.place_hash("", t)))
        trees = {i: wrappers.parse(t) for i, t in pages.items()}
        n = Counter()
        for t in trees.values():
            n.update({wrappers.place_hash(*x) for x in wrappers.places(root, t)})
        same = {h for h, c in n.items() if c > 1 and c >= wrappers.SHARE * len(pages)}
        for i, t in trees.items():
            own = set(wrappers.own_texts(root, t, same))
            found |= {(i, k, c) for k, c in elements(t) if c and any(x in c for x in own)}
            true |= {(i, k, c) for k, c in markup.pieces(pages[i])}
    print(f"pieces {len(true)}, found {len(found)}, both {len(found & true)}: recall {len(found & true) / len(true):.3f}, precision {len(found & true) / max(len(found), 1):.3f}")


if __name__ == "__main__":
    main(sys.argv[1])
