"""Tokenizers and string functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_tokens(c: Column) -> Column:
    """Lower-cased maximal runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(0))


def standard_tokens(c: Column) -> Column:
    """Lower-cased words of letters and digits, joined inside by single dots or apostrophes.

    Approximates Unicode word boundaries; scripts without spaces come out as runs.
    """
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+(?:['.][\p{L}\p{N}]+)*)"), F.lit(0))


#: The letters of the Latin tokenizer, basic and accented.
LATIN = "àÀâÂçÇéÉèÈêÊëËîÎïÏôÔûÛùÙüÜÿŸA-Za-z"


def latin_tokens(c: Column) -> Column:
    """Runs of the letters of ``LATIN``, case kept."""
    return F.regexp_extract_all(c, F.lit(f"([{LATIN}]+)"), F.lit(0))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"simple": simple_tokens, "standard": standard_tokens, "latin": latin_tokens}


def register_tokenizer(name: str, tokenizer: Callable[[Column], Column]) -> None:
    """Makes ``tokenizer`` known to every operator that takes a tokenizer's name."""
    TOKENIZERS[name] = tokenizer


def tokens(c: Column, tokenizer: str = "simple") -> Column:
    return TOKENIZERS[tokenizer](c)


def normal_label(c: Column, tokenizer: str = "standard") -> Column:
    """The label's tokens joined by one space; null if there are none."""
    t = tokens(c, tokenizer)
    return F.when(F.size(t) > 0, F.array_join(t, " "))


def without_comments(c: Column) -> Column:
    """Comments that begin and end on one line are removed."""
    return F.regexp_replace(c, "<!--.*?-->", "")


def unescape_basic(c: Column) -> Column:
    """The named references of XML and the two common forms of the apostrophe."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def escape_basic(c: Column) -> Column:
    """The characters that XML reserves as named references."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def without_language(title: Column) -> Column:
    """What follows the first colon; the whole where there is none."""
    return F.regexp_replace(title, "^[^:]*:", "")


def quote_escaped(c: Column) -> Column:
    r"""``\`` and ``"`` with a backslash before them."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s_]+", " "))
