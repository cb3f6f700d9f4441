"""Wikitext: links, titles, redirects, sections, markup removal, templates and expressions.

What regular expressions can say is a column expression; nested constructs run in
Arrow-batched Pandas functions.
"""

from __future__ import annotations

import html
import math
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import capitalize
from graphloom.functions.text import collapse, unescape_basic

LINK = r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]([a-z]*)"
REDIRECT = r"(?is)\A\s*#REDIRECT\s*\[\[(.*?)\]\]"
LONGEST_TITLE = 255


def is_redirect(text: Column) -> Column:
    return text.rlike(REDIRECT)


def redirect_target(text: Column) -> Column:
    """The raw link of a redirect page; null for others."""
    found = F.regexp_extract(text, REDIRECT, 1)
    return F.when(found != "", found)


def template_pattern(names: list[str]) -> str:
    """A regex for uses of these templates: the first letter in either case, spaces and
    underscores alike, any parameters."""

    def one(name: str) -> str:
        rest = r"[ _]+".join(regex.escape(w) for w in regex.split(r"[ _]+", name[1:]))
        return f"[{name[0].upper()}{name[0].lower()}]{rest}"

    return r"\{\{\s*(?:" + "|".join(one(n) for n in names if n) + r")\s*(?:\|[^{}]*)?\}\}"


def dab_template(text: Column, names: list[str]) -> Column:
    """The first use of one of the templates outside comments; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(text, "<!--.*?-->", ""), "(" + template_pattern(names) + ")", 1)
    return F.when(found != "", found)


def extract_links(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``pos``, ``raw``, ``title``, ``anchor``, ``display``, ``colon``, ``trail``: the
    links of each text in order.

    ``title`` has collapsed spaces and an upper-case first letter, ``anchor`` is what
    follows '#', with underscores, or null. ``display`` is what the link shows: the
    given text, else the target; an empty given text shows the title without its
    language part and closing parentheses; letters behind the link belong to it.
    """
    d = df.select(F.col(id).alias(id), F.posexplode(F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1))).alias("pos", "raw"))
    part = lambda k: F.regexp_extract("raw", LINK, k)
    target = unescape_basic(part(1))
    colon = F.trim(target).startswith(":")
    bare = F.regexp_replace(target, r"^\s*:", "")
    title = capitalize(collapse(F.regexp_replace(bare, "(?s)#.*", "")))
    anchor = F.when(F.instr(bare, "#") > 0, F.translate(F.trim(F.regexp_replace(bare, "(?s)^[^#]*#", "")), " ", "_"))
    shown = unescape_basic(part(2))
    piped = F.instr("raw", "|") > 0
    hidden = F.trim(F.regexp_replace(F.regexp_replace(title, "^[^:]*:", ""), r"\s*\([^()]*\)$", ""))
    display = F.when(~piped, target).when(F.trim(shown) == "", hidden).otherwise(shown)
    display = F.trim(F.regexp_replace(F.concat(display, part(3)), r"\s+", " "))
    return d.select(id, F.col("pos").cast("bigint").alias("pos"), "raw", title.alias("title"), anchor.alias("anchor"), display.alias("display"), colon.alias("colon"), part(3).alias("trail"))


def split_title(df: DataFrame, title: str, namespaces: DataFrame) -> DataFrame:
    """Adds ``language``, ``namespace_id``, ``short_title`` to titles like ``lang:Name:Title``.

    The first part is the language if ``namespaces`` has it, else the language is
    null and nothing else is split off; the second part is a namespace if its
    lower-cased name is one of the language's, else the namespace is 0.
    """
    ns = namespaces.where(F.col("name") != "").select(F.col("lang").alias("_lang"), F.lower("name").alias("_name"), F.col("ns_id").alias("_id")).dropDuplicates(["_lang", "_name"])
    langs = namespaces.select(F.col("lang").alias("_known")).distinct()
    d = df.withColumn("_head", F.lower(F.substring_index(title, ":", 1))).withColumn("_rest", F.expr(f"substring(`{title}`, instr(`{title}`, ':') + 1)"))
    d = d.join(langs, (d["_head"] == langs["_known"]) & (F.instr(title, ":") > 0), "left")
    d = d.withColumn("_second", F.when(F.col("_known").isNotNull() & (F.instr("_rest", ":") > 0), F.lower(F.substring_index("_rest", ":", 1))))
    d = d.join(ns, (d["_known"] == ns["_lang"]) & (d["_second"] == ns["_name"]), "left")
    short = F.when(F.col("_id").isNotNull(), F.expr("substring(_rest, instr(_rest, ':') + 1)")).when(F.col("_known").isNotNull(), F.col("_rest")).otherwise(F.col(title))
    keep = [F.col(c) for c in df.columns]
    return d.select(*keep, F.col("_known").alias("language"), F.coalesce("_id", F.lit(0)).alias("namespace_id"), capitalize(collapse(short)).alias("short_title"))


def resolve_titles(links: DataFrame, page: str, namespaces: DataFrame) -> DataFrame:
    """Adds ``language``, ``namespace_id``, ``short_title``, ``page_language`` and ``dst``, the key of
    the page that ``title`` means on the page with the key ``page``.

    A title without a language is in the page's own; one that begins with a slash is
    a subpage of the page unless that is in the main namespace. A key is
    ``language:Name:Title``, without a name in the main namespace; where the page's
    key has no known language, nothing comes before the title.
    """
    langs = namespaces.select(F.col("lang").alias("_l")).distinct()
    own = F.lower(F.substring_index(page, ":", 1))
    inner = F.expr(f"substring(`{page}`, instr(`{page}`, ':') + 1)")
    sub = F.col("title").startswith("/") & (F.instr(inner, ":") > 0)
    d = links.withColumn("_title", F.when(sub, F.concat(inner, "title")).otherwise(F.col("title")))
    d = d.join(langs, F.lower(F.substring_index("_title", ":", 1)) == F.col("_l"), "left").withColumn("_full", F.when(F.col("_l").isNotNull(), F.col("_title")).otherwise(F.concat_ws(":", own, "_title"))).drop("_l")
    d = split_title(d, "_full", namespaces).withColumn("page_language", own)
    names = namespaces.where("name <> ''").groupBy(F.col("lang").alias("_lang"), F.col("ns_id").alias("_ns")).agg(F.min("name").alias("_name"))
    d = d.join(names, (d["language"] == names["_lang"]) & (d["namespace_id"] == names["_ns"]), "left")
    return d.withColumn("dst", F.concat_ws(":", "language", "_name", "short_title")).drop("_title", "_full", "_lang", "_ns", "_name")


def admitted_links(links: DataFrame, page_language: str = "page_language") -> DataFrame:
    """Links that count: those with a leading colon, and those to the page's own language
    outside categories (14) and files (6), with titles of at most 255 characters."""
    own = F.col("language").eqNullSafe(F.col(page_language)) & ~F.col("namespace_id").isin(6, 14)
    return links.where((F.col("colon") | own) & (F.length("short_title") <= LONGEST_TITLE))


def hidden_links(language: str = "language", page_language: str = "page_language") -> Column:
    """Whether a link shows nothing: one without a leading colon to another language, a category (14) or a file (6)."""
    return ~F.col("colon") & (~F.col(language).eqNullSafe(F.col(page_language)) | F.col("namespace_id").isin(6, 14))


def links_to_text(df: DataFrame, page: str, text: str, namespaces: DataFrame) -> DataFrame:
    """``page``, ``text``, ``links``: the text of each page with links replaced by what they show, and the links in
    order as ``offset`` in the new text, ``dst``, ``display`` and ``hidden``.

    Hidden links show nothing (``hidden_links``). Repeated rows come once, null texts are left out.
    """
    d = df.select(F.col(page).alias("page"), F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("_h", F.xxhash64("text"))
    d = d.withColumn("_key", F.concat_ws("\u0001", "page", F.col("_h").cast("string")))
    found = extract_links(d, "_key", "text").withColumn("page", F.substring_index("_key", "\u0001", 1))
    found = resolve_titles(found, "page", namespaces).withColumn("hidden", hidden_links())
    shown = F.when(F.col("hidden"), "").otherwise(F.col("display"))
    found = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "dst", shown.alias("display"), "hidden"))).alias("_l"))
    none = F.array().cast("array<struct<pos:bigint,dst:string,display:string,hidden:boolean>>")
    j = d.join(found, "_key", "left").withColumn("_l", F.coalesce("_l", none)).withColumn("_between", F.split("text", LINK))
    placed = F.aggregate(
        F.sequence(F.lit(0), F.size("_l")),
        F.struct(F.lit("").alias("out"), F.array().cast("array<int>").alias("at")),
        lambda s, i: F.struct(
            F.concat(s["out"], F.get("_between", i), F.coalesce(F.get("_l", i)["display"], F.lit(""))).alias("out"),
            F.array_append(s["at"], F.length(s["out"]) + F.length(F.get("_between", i))).alias("at"),
        ),
    )
    j = j.withColumn("_p", placed)
    listed = F.transform("_l", lambda x, i: F.struct(F.get("_p.at", i).alias("offset"), x["dst"].alias("dst"), x["display"].alias("display"), x["hidden"].alias("hidden")))
    return j.select("page", F.col("_p.out").alias("text"), listed.alias("links"))


def split_sections(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``pos``, ``level``, ``title``, ``text``: the sections at ``==`` headings; what
    stands before the first has level 0 and a null title."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), r"\n(={2,6})[ \t]*([^\n]*?[^=\n])[ \t]*={2,6}[ \t\r]*(?=\n|$)", "\u0001$1\u0002$2\u0003")
    d = df.select(F.col(id), F.posexplode(F.split(marked, "\u0001")).alias("pos", "_part"))
    head = F.substring_index("_part", "\u0003", 1)
    first = F.col("pos") == 0
    body = F.when(first, F.col("_part")).otherwise(F.expr("substring(_part, instr(_part, '\u0003') + 1)"))
    return d.select(
        id,
        F.col("pos").cast("bigint").alias("pos"),
        F.when(first, 0).otherwise(F.length(F.substring_index(head, "\u0002", 1))).cast("int").alias("level"),
        F.when(~first, F.trim(F.substring_index(head, "\u0002", -1))).alias("title"),
        F.regexp_replace(body, r"^\n", "").alias("text"),
    )


def list_lines(text: Column) -> Column:
    """The lines that begin with ``:``, ``#`` or ``*``."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("^[:#*]"))


# Nested constructs

_steps = [
    (regex.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\]]*))?\]"), lambda m: m[1] or ""),
    (regex.compile(r"<nowiki>.*?</nowiki>|<source\b.*?</source>|<!--.*?-->|<ref\b[^<>]*/>|<ref\b.*?</ref>", regex.S | regex.I), ""),
    (regex.compile(r"\{\{\{[^{}]*\}\}\}|\{\{[^{}]*\}\}"), ""),
]
_table = (regex.compile(r"\{\|[^{}]*\|\}"), "")
_tags = regex.compile(r"</?[a-zA-Z][^<>]*>")


def strip_wiki(text: str, tables: bool = False) -> str:
    """Text without external links (their label stays), nowiki, source, comments, references
    and templates, removed from the inside out until nothing changes, and then without tags;
    with ``tables`` without tables too."""
    steps = [*_steps, _table] if tables else _steps
    while True:
        before = text
        for pattern, by in steps:
            text = pattern.sub(by, text)
        if text == before:
            return _tags.sub("", text)


def strip_wiki_column(c: Column) -> Column:
    return _series(strip_wiki)(c)


def unescape_column(c: Column) -> Column:
    """All named, decimal and hexadecimal character references decoded."""
    return _series(html.unescape)(c)


def _series(f: Callable[[str], str | None]):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or t != t else f(t))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


_OPERATORS = {
    "or": (1, lambda a, b: float(bool(a) or bool(b))),
    "and": (2, lambda a, b: float(bool(a) and bool(b))),
    **{op: (3, f) for op, f in {"=": lambda a, b: float(a == b), "!=": lambda a, b: float(a != b), "<>": lambda a, b: float(a != b), "<": lambda a, b: float(a < b), ">": lambda a, b: float(a > b), "<=": lambda a, b: float(a <= b), ">=": lambda a, b: float(a >= b)}.items()},
    "round": (4, lambda a, b: math.floor(a * 10**b + 0.5) / 10**b if a >= 0 else -math.floor(-a * 10**b + 0.5) / 10**b),
    "+": (5, lambda a, b: a + b),
    "-": (5, lambda a, b: a - b),
    "*": (6, lambda a, b: a * b),
    "/": (6, lambda a, b: a / b),
    "div": (6, lambda a, b: a / b),
    "mod": (6, lambda a, b: math.fmod(int(a), int(b))),
}
_number = regex.compile(r"\s*(?:(\d+(?:\.\d*)?(?:e[+-]?\d+)?|\.\d+)|(<=|>=|<>|!=|[-+*/<>=()])|([a-z]+))", regex.I)


def evaluate(expression: str) -> float:
    """The value of an arithmetic expression; ValueError if it isn't one."""
    tokens, at = [], 0
    while expression[at:].strip():
        m = _number.match(expression, at)
        if not m:
            raise ValueError(f"unexpected {expression[at:].strip()[:10]!r}")
        tokens.append(float(m[1]) if m[1] else (m[2] or m[3].lower()))
        at = m.end()
    tokens.append(None)
    i = 0

    def value() -> float:
        nonlocal i
        t = tokens[i]
        i += 1
        if isinstance(t, float):
            return t
        if t == "(":
            v = climb(0)
            if tokens[i] != ")":
                raise ValueError("a bracket isn't closed")
            i += 1
            return v
        if t in ("-", "+"):
            v = value()
            return -v if t == "-" else v
        if t == "not":
            return float(not value())
        raise ValueError(f"unexpected {t!r}")

    def climb(least: int) -> float:
        nonlocal i
        left = value()
        while tokens[i] in _OPERATORS and _OPERATORS[tokens[i]][0] > least:
            rank, f = _OPERATORS[tokens[i]]
            i += 1
            left = f(left, climb(rank))
        return left

    try:
        v = climb(0)
    except ZeroDivisionError:
        raise ValueError("division by zero") from None
    if tokens[i] is not None:
        raise ValueError(f"unexpected {tokens[i]!r}")
    return v


def shown_number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


class Templates:
    """Expands ``{{name|…}}`` in texts from a map of template texts.

    Supports parameters by position and name with defaults, nested templates, the
    page name words and the functions #if, #ifeq, #expr, #ifexpr, lc, urlencode and
    formatnum. A template within itself and one that isn't in the map come out empty.
    """

    DEPTH = 40

    def __init__(self, texts: dict[str, str]) -> None:
        self.texts = {self.name(k): v for k, v in texts.items()}

    @staticmethod
    def name(s: str) -> str:
        s = " ".join(s.replace("_", " ").split())
        return s[:1].upper() + s[1:]

    @staticmethod
    def prepared(text: str) -> str:
        text = regex.sub(r"<!--.*?-->|<noinclude>.*?</noinclude>|<ref\b[^<>]*/>|<ref\b.*?</ref>", "", text, flags=regex.S)
        return regex.sub(r"</?includeonly>", "", text)

    def expand(self, title: str, text: str, args: dict[str, str] | None = None, stack: tuple[str, ...] = ()) -> str:
        inner = regex.compile(r"\{\{\{([^{}|]*)(?:\|([^{}]*))?\}\}\}|\{\{((?:[^{}]|\{(?!\{)|\}(?!\}))*)\}\}")
        for _ in range(10_000):
            m = inner.search(text)
            if not m:
                break
            if m[3] is None:
                key = m[1].strip()
                got = (args or {}).get(key)
                out = got if got is not None else m[2] if m[2] is not None else ""
            else:
                out = self.call(title, m[3], stack)
            text = text[: m.start()] + out + text[m.end() :]
        return text

    def call(self, title: str, body: str, stack: tuple[str, ...]) -> str:
        parts = regex.split(r"\|(?![^\[\]]*\]\])", body)
        head = parts[0].strip()
        if head in ("PAGENAME", "FULLPAGENAME"):
            return title.split(":", 1)[-1] if head == "PAGENAME" else title
        if head == "FULLPAGENAMEE":
            return title.replace(" ", "_")
        if ":" in head and head.split(":", 1)[0].lower() in ("#if", "#ifeq", "#expr", "#ifexpr", "lc", "urlencode", "formatnum"):
            name, first = head.split(":", 1)
            return self.function(name.lower(), [first, *parts[1:]])
        name = self.name(head)
        if name in stack or len(stack) >= self.DEPTH or name not in self.texts:
            return ""
        args: dict[str, str] = {}
        position = 0
        for p in parts[1:]:
            key, sign, v = p.partition("=")
            if sign:
                args[key.strip()] = v.strip()
            else:
                position += 1
                args[str(position)] = p
        return self.expand(title, self.prepared(self.texts[name]), args, (*stack, name))

    @staticmethod
    def function(name: str, a: list[str]) -> str:
        from urllib.parse import quote_plus

        at = lambda k: a[k].strip() if k < len(a) else ""
        if name == "#if":
            return at(1) if at(0) else at(2)
        if name == "#ifeq":
            return at(2) if at(0) == at(1) else at(3)
        if name == "lc":
            return at(0).lower()
        if name == "urlencode":
            return quote_plus(at(0))
        if name == "formatnum":
            return at(0)
        try:
            v = evaluate(at(0))
        except ValueError as e:
            return f'<strong class="error">{e}</strong>'
        if name == "#expr":
            return shown_number(v)
        return at(1) if v else at(2)


def expand_templates(df: DataFrame, title: str, text: str, templates: dict[str, str]) -> DataFrame:
    """``df`` with ``text`` expanded; the map of templates is sent to each executor once."""
    shared = df.sparkSession.sparkContext.broadcast(templates)

    @F.pandas_udf("string")
    def run(titles: pd.Series, texts: pd.Series) -> pd.Series:
        t = Templates(shared.value)
        return pd.Series([None if x is None else t.expand(n or "", Templates.prepared(x)) for n, x in zip(titles, texts)])

    return df.withColumn(text, run(F.col(title), F.col(text)))
