"""Texts that were cut off, by longer copies of them and by where they stop."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut

#: Beginnings of so many characters and twice, four times, … as many are compared by hash before texts are;
#: shorter texts are looked up by their own length.
LEAST = 64
#: So many hashes are broadcast at most, 8 bytes each.
MOST_HASHES = 500_000

#: Marks that sources put at a cut.
MARKS = regex.compile(
    r"(?:\s*(?:\[\s*(?:\.\.\.|…|cut|truncated|more|continued|snip|read more)\s*\]|\(\s*(?:\.\.\.|…|cut|truncated|more|continued|read more)\s*\)"
    r"|<\s*(?:cut|truncated|snip)\s*>|>>+|»+|→|-->|…|\.\.\.+))+\s*$",
    regex.I,
)
#: Words with which an author's own ellipsis closes a sentence.
OWN_ELLIPSIS = regex.compile(r"(?:\band so (?:on|forth)|\betc|\bund so weiter|\busw|\bи так далее|\bи т\. ?д|\by así sucesivamente|\bet ainsi de suite|など)\s*(?:…|\.\.\.+)\s*$", regex.I)

_sentence = regex.compile(r"[.!?。！？｡…؟।](?:[\"'”’»«›‹」』）)\]*_]|</?\w+[^<>]*>|\s)*$")
_list = regex.compile(r"^\s*(?:[*#;]+(?:\s|(?!.*\*))|[-+•·]\s|\d+[.)]\s|<li>)")
_heading = regex.compile(r"^\s*(?:(={1,6})\s*\S.*?\1|#{1,6}\s+\S.*|<h[1-6][^>]*>.*</h[1-6]>)\s*$", regex.I)
_signature = regex.compile(r"(?:^|[.!?。！？…][\"'”’»)\]]*\s*)(?:--|—|–|~{2,})\s*\p{Lu}[^\s.]*(?:,?\s+\d{1,2}:\d{2},.*\(\w+\))?\s*$")
_stamp_begun = regex.compile(r"--\s*\S+\s+\d{1,2}:?\d{0,2}(?:,[^()]*(?:\(\w{0,3})?)?$")
_stamp = regex.compile(r"\(UTC\)\s*$")
_broken = regex.compile(r"(?:�|&#?\w{0,8}|<[/!a-zA-Z][^<>]*|<|\[\[[^\[\]]*|\{\{[^{}]*|\[https?:[^\]]*|\[\[[^\[\]]*\]|\{\{[^{}]*\}|\p{Cs})$")
_word = regex.compile(r"\w")


def stop(text: str | None, title: str | None = None) -> str:
    """Where a text stops: 'blank', 'title', 'sentence', 'entry' (a list entry, heading,
    table, category, link, signature or code line), or, for a cut one, 'mark' (the
    source marked the cut), 'broken' (a tag, link, entity or character is broken
    off), 'open' (a note or bracket isn't closed) or 'inside' (a word or sentence)."""
    t = (text or "").rstrip()
    if not t.strip():
        return "blank"
    last = t[t.rfind("\n") + 1 :].strip()
    if title and last == title.strip():
        return "title"
    fences = sum(1 for x in t.split("\n") if x.lstrip().startswith("```"))
    if fences and last.startswith("```") and fences % 2 == 0:
        return "entry"
    if fences % 2:
        return "entry"
    if OWN_ELLIPSIS.search(last):
        return "sentence"
    if MARKS.search(t):
        return "mark"
    if _heading.match(last) or last.endswith(("|}", "</table>")):
        return "entry"
    if _broken.search(last):
        return "broken"
    if last.startswith(("==", "|", "!", "{|")):
        return "open"
    if last.endswith("]") and last.startswith(("[[", "[http")) or _list.match(last):
        return "entry"
    if _stamp.search(last):
        return "entry"
    if _stamp_begun.search(last):
        return "inside"
    if _signature.search(last):
        return "entry"
    if _sentence.search(last):
        if last.count("<ref") > last.count("</ref") + last.count("/>") or last.rfind("(") > last.rfind(")"):
            return "open"
        return "sentence"
    if "\n" not in t and not title and len(last) <= 60 and len(last.split()) <= 5:
        return "title"
    return "inside"


CUT = ("mark", "broken", "open", "inside")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted distinct texts, those that the next one begins with, and both ends of the partition."""
    part = TaskContext.get().partitionId()
    last: tuple[int, str] | None = None
    for batch in batches:
        out = []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last is None:
                out.append((h, None, part, 0, t))
            elif t.startswith(last[1]):
                out.append((last[0], t[len(last[1]) : len(last[1]) + 8], part, None, None))
            last = (h, t)
        yield _rows(out)
    if last is not None:
        yield _rows([(last[0], None, part, 1, last[1])])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["h", "rest", "part", "side", "text"])


def longer_copies(df: DataFrame, text: str, least: int = LEAST) -> DataFrame:
    """``h``, ``rest``, ``word``, ``digit``, ``more``: the distinct texts of one character or more that another text
    continues, by the hash ``xxhash64(text)``, with the first eight characters of the continuation that is first in
    order, and whether a continuation begins with a letter or digit, with a digit, and with more of the same line.

    For texts under ``least`` characters every longer text counts: the beginnings of all texts are looked up
    by the lengths that occur, and what follows them is combined before it is shuffled. For others
    beginnings of 64, 128, 256, ... characters are hashed for every text; only texts
    that share one with a different text are compared. These are sorted by range of
    the text itself, so a beginning that very many texts share is spread over tasks,
    and each is held against its successor: the next text in byte order continues a
    text if any does, and it alone decides. Copies are removed first. Nulls are left out.
    """
    return _short_copies(df, text, least).unionByName(_long_copies(df, text, least).select("h", "rest", *_goes_on()))


def _goes_on(rest: str = "rest") -> list[Column]:
    c = F.col(rest)
    return [c.rlike(r"^[\p{L}\p{N}]").alias("word"), c.rlike(r"^\p{N}").alias("digit"), (~c.rlike(r"^\s*\n")).alias("more")]


def _short_copies(df: DataFrame, text: str, least: int) -> DataFrame:
    begin = lambda c, n: F.xxhash64(F.substring(c, F.lit(1), n))
    power = lambda k: F.pow(F.lit(2), k).cast("int")
    level = F.floor(F.log2(F.length(text))).cast("int")
    t = df.where((F.length(text) > 0) & (F.length(text) < least)).select(F.length(text).alias("n"), F.xxhash64(text).alias("h"), level.alias("k"), begin(text, power(level)).alias("p"))
    t = cut(t.distinct())
    few = t.count() <= MOST_HASHES
    sent = F.broadcast if few else lambda x: x
    # Beginnings of 1, 2, 4, ... characters tell which lengths a text has to be looked up by.
    lengths = sent(t.groupBy("k", "p").agg(F.collect_set("n").alias("_lengths")))
    d = df.where(F.length(text) > 1).select(F.length(text).alias("_n"), F.substring(text, 1, least + 8).alias("_head"))
    levels = F.filter(F.sequence(F.lit(0), F.lit(least.bit_length() - 1)), lambda k: power(k) < F.col("_n"))
    d = d.withColumn("_k", F.explode(levels)).withColumn("_p", begin("_head", power(F.col("_k"))))
    near = d.join(lengths, (F.col("_k") == F.col("k")) & (F.col("_p") == F.col("p"))).withColumn("_at", F.explode(F.filter("_lengths", lambda n: n < F.col("_n"))))
    begun = near.select(F.col("_at").alias("n"), begin("_head", F.col("_at")).alias("h"), F.substring("_head", F.col("_at") + 1, F.lit(8)).alias("rest"))
    begun = begun.join(sent(t.select("n", "h")), ["n", "h"], "left_semi")
    return begun.select("h", "rest", *_goes_on()).groupBy("h").agg(F.min("rest").alias("rest"), *[F.max(c).alias(c) for c in ("word", "digit", "more")])


def _long_copies(df: DataFrame, text: str, least: int) -> DataFrame:
    t = df.where(F.length(text) >= least).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    level = F.explode(F.sequence(F.lit(least.bit_length() - 1), F.floor(F.log2(F.length("text"))).cast("int")))
    starts = t.select("h", "text", level.alias("level"))
    starts = cut(starts.select("h", "level", F.xxhash64(F.substring("text", F.lit(1), F.expr("shiftleft(1, level)"))).alias("p")))
    shared = starts.groupBy("level", "p").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("level", "p")
    able = cut(starts.join(shared, ["level", "p"], "left_semi").select("h").distinct())
    # Few hashes are sent to the texts; for more, copies merge before the texts are shuffled.
    if able.count() <= MOST_HASHES:
        texts = t.join(F.broadcast(able), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    else:
        texts = t.groupBy("h").agg(F.min("text").alias("text")).join(able, "h", "left_semi")
    pairs = cut(texts.repartitionByRange("text").sortWithinPartitions("text").select("h", "text").mapInArrow(_neighbours, "h bigint, rest string, part int, side int, text string"))
    number = pairs.where("side = 0").select("part").withColumn("r", F.row_number().over(Window.orderBy("part")))  # a number per partition
    ends = pairs.where("side IS NOT NULL").join(number, "part")
    first = ends.where("side = 0").select((F.col("r") - 1).alias("r"), F.col("text").alias("_next"))
    following = ends.where("side = 1").join(first, "r").where("startswith(_next, text)")
    following = following.select("h", F.expr("substring(_next, length(text) + 1, 8)").alias("rest"))
    return pairs.where("side IS NULL").select("h", "rest").unionByName(following).where("rest <> ''")


def _stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, titles = batch.column("text").to_pylist(), batch.column("title").to_pylist()
        kinds = [stop(t, n) for t, n in zip(texts, titles)]
        tails = [(t or "")[-8:] for t in texts]
        lists = [bool(_list.match(t[t.rfind("\n") + 1 :])) if t else False for t in texts]
        single = [k == "title" and (bool(n) or len(t.split()) == 1) for k, t, n in zip(kinds, texts, titles)]
        columns = [pa.array(kinds, pa.string()), pa.array(tails, pa.string()), pa.array(lists, pa.bool_()), pa.array(single, pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("h"), *columns], names=["id", "source", "h", "stop", "tail", "in_list", "word"])


def text_stops(df: DataFrame, id: str = "doc_id", text: str = "text", title: str = "title", source: str = "source") -> DataFrame:
    """``id``, ``source``, ``stop``, ``truncated`` of each row.

    ``stop`` is where the text stops (see ``stop``). ``truncated`` holds if that is
    inside a word or sentence, or if a longer copy shows that a word or number, or
    a list entry, goes on at the end (``stop`` 'copy'); a title of one word, with which other texts may
    begin by chance, or the record's own title is never cut. Null, empty and blank texts
    are 'blank' and not truncated. Rows keep their number.
    """
    d = df.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), F.col(title).alias("title"), F.xxhash64(text).alias("h"))
    kind = d.schema["id"].dataType.simpleString()
    stops = d.mapInArrow(_stops, f"id {kind}, source string, h bigint, stop string, tail string, in_list boolean, word boolean")
    longer = longer_copies(df, text).withColumnRenamed("word", "in_word")
    goes_on = (F.col("tail").rlike(r"[\p{L}\p{N}]$") & F.col("in_word") & ~F.col("word")) | (F.col("tail").rlike(r"\p{N}[.,]$") & F.col("digit")) | (F.col("in_list") & F.col("more"))
    own = F.col("stop").isin(*CUT)
    copied = F.coalesce(goes_on, F.lit(False))
    return stops.join(longer, "h", "left").select("id", "source", F.when(~own & copied, "copy").otherwise(F.col("stop")).alias("stop"), (own | copied).alias("truncated"))


def truncation_by_source(stops: DataFrame) -> DataFrame:
    """``source``, ``n``, ``truncated``, ``share``: texts that aren't blank, and those cut off, per source."""
    n = F.count_if(F.col("stop") != "blank")
    cut_off = F.count_if("truncated")
    return stops.groupBy("source").agg(n.alias("n"), cut_off.alias("truncated"), F.round(cut_off / F.greatest(n, F.lit(1)), 6).alias("share"))
