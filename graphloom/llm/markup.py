"""Wiki, HTML, Markdown and LaTeX markup turned into clean, structured text.

A text is read in three steps: code, comments, nowiki and formulas are taken out
first, whichever opens first; then the block structure is read in the text's own
kind of markup, with HTML elements understood in all of them; last, the inline
markup of each block is reduced to what a reader sees.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of blocks; 'text' is everything else.
PIECES = ("heading", "item", "code", "formula")
#: The words that begin a redirect.
REDIRECTS = ("redirect", "weiterleitung", "redirection", "redirección", "redirecciona", "перенаправление", "転送", "リダイレクト")
#: Private characters: a block or literal taken out, and the start of a converted line.
HOLD, HELD, MARK = "\ue000", "\ue001", "\ue002"

_re = cache(regex.compile)
_flags = regex.S | regex.I
_comment = r"(?P<comment><!--.*?(?:-->|\Z))"
_tagged_code = r"<(?P<tag>pre|source|syntaxhighlight)\b(?:[^<>/]|/(?!>))*>(?P<code>.*?)</(?P=tag)\s*>"
_tagged_math = r"<(?P<mtag>math|chem)\b(?:[^<>/]|/(?!>))*>(?P<math>.*?)</(?P=mtag)\s*>"
_hidden = r"(?P<hidden><(?P<htag>script|style)\b[^<>]*>.*?</(?P=htag)\s*>)"
_round = r"\\\((?P<round>.+?)\\\)|\\\[(?P<square>.+?)\\\]"
_dollar = r"(?<!\\)\$\$(?P<display>(?:[^$\\]|\\.)+?)\$\$|(?<![\\$])\$(?![\s$])(?P<inline>(?:[^$\\\n]|\\.|\n(?!\s*\n))+?)(?<![\s\\])\$(?![\d$])"
_loose_dollar = r"(?<!\\)\$\$(?P<display>(?:[^$\\]|\\.)+?)\$\$|(?<![\\$])\$(?P<inline>(?:[^$\\\n]|\\.|\n(?!\s*\n))+?)\$"
_fence = r"(?m:^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^`\n]*\n)(?P<fenced>.*?)(?m:^[ ]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)"
_span = r"(?P<tick>(?<![`\\])`+(?!`))(?P<literal>[^\n](?:.(?!\n\s*\n))*?)(?<!`)(?P=tick)(?!`)"
_environment = r"\\begin\{(?P<env>verbatim\*?|Verbatim|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?(?<=\{minted\})\{[^}\n]*\})(?P<listing>.*?)\\end\{(?P=env)\}"
_equation = r"\\begin\{(?P<eq>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(?P<equation>.*?)\\end\{(?P=eq)\}"
_verb = r"\\(?:verb|lstinline)\*?(?P<bar>[^\w\s{*])(?P<verb>[^\n]*?)(?P=bar)"
_percent = r"(?P<percent>(?<!\\)%[^\n]*(?:\n[ \t]*(?=\S))?)"


def _any(*parts: str):
    return regex.compile("|".join(parts), _flags)


_held = {
    "wiki": _any(_comment, r"<nowiki\s*/>", r"<nowiki>(?P<literal>.*?)</nowiki>", _tagged_code, _tagged_math),
    "html": _any(_comment, _hidden, _tagged_code, _tagged_math, _round, r"\$\$(?P<display>[^$]+?)\$\$"),
    "markdown": _any(_comment, _fence, _tagged_code, _tagged_math, _span, _dollar),
    "latex": _any(_percent, _environment, _equation, _verb, _loose_dollar, _round, _tagged_code, _tagged_math),
    "plain": _any(_comment, _tagged_code, _tagged_math),
}
_latex = regex.compile(r"\\(?:(?:sub){0,2}section|chapter|(?:sub)?paragraph|begin|end|item|textbf|emph|documentclass|footnote)\b\*?\s*(?:[{\[]|(?<=\\item)\s)")
_wiki = regex.compile(r"'''|\[\[[^\[\]\n]+\]\]|\{\{|^\{\||^(={2,6})[^=\n].*?\1\s*$|<ref\b|<nowiki|^#redirect", regex.M | regex.I)
_markdown = regex.compile(r"\*\*[^*\s\n][^*\n]*\*\*|\]\([^)\s]*\)|^ {0,3}(?:`{3}|~{3})|^\S.*\n {0,3}(?:=+|-+)[ \t]*$|^\[[^\]]+\]: \S|\]\[[^\]]*\]|^ {0,3}[-+] \S", regex.M)
_html = regex.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|pre|br|b|i|em|strong|a|span|font|u|code)\b[^<>]*>", regex.I)
_noise = regex.compile(r"<!--.*?(?:-->|\Z)|<(pre|source|syntaxhighlight)\b[^<>]*>.*?</\1\s*>|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}", _flags)

_marks = regex.compile(r"^ {0,3}#{1,6} \S", regex.M)
_plainly_markdown = regex.compile(r"\*\*\S|\]\(|^ {0,3}`{3}", regex.M)
_entity = regex.compile(r"&#?\w+;")


def kind_of(text: str) -> str:
    """'latex', 'wiki', 'markdown', 'html' or 'plain': the markup that a text is written in."""
    bare = _noise.sub("", text)
    if _latex.search(bare):
        return "latex"
    wiki = len(_wiki.findall(bare))
    if wiki and not ("**" in bare or "](" in bare or "```" in bare or "~~~" in bare):
        return "wiki"
    markdown = len(_markdown.findall(bare))
    if wiki and wiki >= markdown:
        return "wiki"
    tags = len(_html.findall(text))
    # A line of # marks is a numbered list in a wiki, so it only tells where nothing else does.
    markdown = markdown or (0 if tags else len(_marks.findall(bare)))
    if markdown and (markdown >= tags or _plainly_markdown.search(bare)):
        return "markdown"
    return "html" if tags or _entity.search(bare) else "plain"


_private = regex.compile("[\ue000-\ue004]")
_inner_code = regex.compile(r"\A\s*<code\b[^<>]*>|</code\s*>\s*\Z", _flags)


class _Reader:
    """One text under reading."""

    def __init__(self, text: str) -> None:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if _private.search(text):
            text = _private.sub("", text)
        self.kind = kind_of(text)
        self.kept: list[tuple[str, str]] = []  # what was taken out: piece or 'literal', and its text
        self.text = _held[self.kind].sub(self._hold, text)

    def _hold(self, m) -> str:
        g = m.groupdict()
        for name in ("code", "fenced", "listing"):
            if g.get(name) is not None:
                body = g[name]
                if name == "code":
                    body = _inner_code.sub("", body)
                return "\n\n" + self._keep("code", body) + "\n\n"
        for name in ("math", "round", "square", "display", "inline", "equation"):
            if g.get(name) is not None:
                return self._keep("formula", g[name])
        for name in ("literal", "verb"):
            if g.get(name) is not None:
                return self._keep("literal", g[name])
        return ""

    def _keep(self, piece: str, body: str) -> str:
        if self.kind != "latex" and not (piece == "literal" and self.kind == "markdown"):
            body = html.unescape(body)
        self.kept.append((piece, body))
        return f"{HOLD}{len(self.kept) - 1}{HELD}"

    def blocks(self, texts: bool = True) -> list[tuple[str, str, str]]:
        """Pieces and, with ``texts``, texts in their order, the content as it is read and, of
        headings, items and texts, with formulas between dollar signs."""
        reduce = _REDUCE[self.kind]
        out: list[tuple[str, str, str]] = []
        for piece, raw in _LINES[self.kind](_elements(self.text, self.kind == "html")):
            for m in _slot.finditer(raw):
                held, body = self.kept[int(m[1])]
                if held != "literal":
                    out.append((held, " ".join(body.split()), body.strip("\n")))
            if piece == "text" and not texts:
                continue
            shown = reduce(_slot.sub(lambda m: " " if self.kept[int(m[1])][0] == "code" else m[0], raw))
            read = _slot.sub(lambda m: self.kept[int(m[1])][1], shown)
            marked = _slot.sub(lambda m: "${}$".format(self.kept[int(m[1])][1].strip()) if self.kept[int(m[1])][0] == "formula" else self.kept[int(m[1])][1], shown)
            out.append((piece, " ".join(read.split()), " ".join(marked.split())))
        return [b for b in out if b[1]]


_slot = regex.compile(f"{HOLD}(\\d+){HELD}")

# HTML elements, in every kind of markup

_tag = regex.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")
_block = {"p", "div", "section", "article", "blockquote", "hr", "tr", "dl", "dt", "dd", "center"}


def _elements(text: str, own: bool) -> str:
    """``text`` with headings and list items as marked lines; a nested item gets its own line.

    Table cells come out as text lines. With ``own`` paragraphs are separated too.
    """
    out: list[str] = []
    frames: list[list] = []  # ['L'] for a list, [mark, place in out, parts] for an element that is open
    table = 0

    def put(s: str) -> None:
        for f in reversed(frames):
            if f[0] != "L":
                f[2].append(s)
                return
            if s.strip() == "":
                return
        out.append(s)

    def close(f: list) -> None:
        out[f[1]] = f"\n{MARK}{f[0]}" + " ".join("".join(f[2]).split("\n")) + "\n"

    def close_until(stop) -> None:
        while frames and not stop(frames[-1]):
            f = frames.pop()
            if f[0] != "L":
                close(f)

    def open_(mark: str) -> None:
        out.append("")
        frames.append([mark, len(out) - 1, []])

    at = 0
    for m in _tag.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        end, name = bool(m[1]), m[2].lower()
        if name == "table":
            close_until(lambda f: f[0] == "L" or f[0] == "I")
            table = max(0, table - 1) if end else table + 1
            put("\n")
        elif table:
            put("\n" if name in ("tr", "td", "th", "li", "p") else m[0])
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if end:
                if any(f[0] == "H" for f in frames):
                    close_until(lambda f: f[0] == "H")
                    close(frames.pop())
            else:
                close_until(lambda f: f[0] != "H")
                open_("H")
        elif name in ("ul", "ol"):
            if end:
                if any(f[0] == "L" for f in frames):
                    close_until(lambda f: f[0] == "L")
                    frames.pop()
            else:
                close_until(lambda f: f[0] != "H")
                frames.append(["L"])
        elif name == "li":
            if any(f[0] == "I" for f in frames):
                if end and not (frames and frames[-1][0] == "L"):
                    close_until(lambda f: f[0] in ("I", "L"))
                    if frames and frames[-1][0] == "I":
                        close(frames.pop())
                elif not end:
                    close_until(lambda f: f[0] == "L")
            if not end:
                open_("I")
        elif name == "br":
            put("\n" if own and not frames else " ")
        elif name in _block and own:
            close_until(lambda f: f[0] != "H")
            put(" " if frames else "\n\n")
        else:
            put(m[0])
    put(text[at:])
    close_until(lambda f: False)
    return "".join(out)


# Lines

_MARKS = {"H": "heading", "I": "item"}


def _marked(line: str) -> tuple[str, str] | None:
    return (_MARKS[line[1]], line[2:]) if line.startswith(MARK) else None


def _plain_lines(text: str) -> Iterator[tuple[str, str]]:
    for part in _re(r"\n\s*\n").split(text):
        rest: list[str] = []
        for line in part.split("\n"):
            if found := _marked(line):
                if rest:
                    yield "text", "\n".join(rest)
                    rest = []
                yield found
            else:
                rest.append(line)
        if rest:
            yield "text", "\n".join(rest)


_template = regex.compile(r"\{\{(?:[^{}]|\{(?!\{)|\}(?!\}))*\}\}")
_references = regex.compile(r"<ref\b(?:[^<>/]|/(?!>))*/>|<ref\b[^<>]*>.*?</ref\s*>", _flags)
_wiki_heading = regex.compile(r"^(={1,6})(.+?)(={1,6})\s*$")
_wiki_item = regex.compile(r"^([:;*#]*[*#])[:;*#]*(.*)$")
_redirect = regex.compile(r"^\s*#\s*(?:" + "|".join(REDIRECTS) + r")\s*:?\s*\[\[", regex.I)


def _wiki_lines(text: str) -> Iterator[tuple[str, str]]:
    text = _references.sub("", text)
    while True:
        less = _template.sub("", text)
        if less == text:
            break
        text = less
    table = 0
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("{|"):
            table += 1
        elif table:
            if s.startswith("|}"):
                table -= 1
            elif not s.startswith("|-"):
                yield "text", _re(r"\|\||!!|^[|!]").sub(" ", s)
        elif found := _marked(line):
            yield found
        elif _redirect.match(line):
            continue
        elif m := _wiki_heading.match(line):
            n = min(len(m[1]), len(m[3]))
            yield "heading", m[1][n:] + m[2] + m[3][n:]
        elif m := _wiki_item.match(line):
            yield "item", m[2]
        elif s:
            yield "text", line


_fold = regex.compile(r"^ {0,3}(?:\[[^\]]+\]: *\S.*|([-*_])(?: *\1){2,} *|\|.*\|[ \t]*|\|?(?: *:?-{3,}:? *\|)+ *(?:-{3,})?)$")
_atx = regex.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_underline = regex.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_bullet = regex.compile(r"^(\s*)(?:[-+*]|\d{1,9}[.)])(?:[ \t]+(.*)|)$")


def _markdown_lines(text: str) -> Iterator[tuple[str, str]]:
    defined = set(_re(r"(?m)^ {0,3}\[([^\]]+)\]: *\S").findall(text))
    paragraph: list[str] = []
    item: list[str] | None = None
    blank = True

    def flush() -> Iterator[tuple[str, str]]:
        nonlocal item, paragraph
        if item is not None:
            yield "item", _shortcuts("\n".join(item), defined)
        if paragraph:
            yield "text", _shortcuts("\n".join(paragraph), defined)
        item, paragraph = None, []

    for line in text.split("\n"):
        if not line.strip():
            blank = True
            yield from flush()
            continue
        if found := _marked(line):
            yield from flush()
            yield found[0], _shortcuts(found[1], defined)
        elif paragraph and item is None and _underline.match(line):
            yield "heading", _shortcuts("\n".join(paragraph), defined)
            paragraph = []
        elif _fold.match(line):
            yield from flush()
            if line.lstrip().startswith("|") and not _re(r"[\s|:-]+").fullmatch(line):
                yield "text", line.replace("|", " ")
        elif m := _atx.match(line):
            yield from flush()
            yield "heading", _shortcuts(m[1] or "", defined)
        elif m := _bullet.match(line):
            yield from flush()
            item = [m[2] or ""]
        elif item is not None and not blank and line[:1] in " \t":
            item.append(line.strip())
        else:
            if item is not None:
                yield from flush()
            paragraph.append(_re(r"^ {0,3}> ?").sub("", line))
        blank = False
    yield from flush()


def _shortcuts(s: str, defined: set[str]) -> str:
    """Bare references ``[x]`` to a link defined in the text become ``[x][]``."""
    return _re(r"(?<![\]\\])\[([^\[\]]+)\](?![\[(:])").sub(lambda m: f"[{m[1]}][]" if m[1] in defined else m[0], s) if defined else s


_brace = r"(?P<arg>\{(?:[^{}\\]|\\.|(?&arg))*\})"
_latex_block = regex.compile(
    r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\s*(?P<title>" + _brace + r")"
    r"|\\begin\{(?P<begin>[^{}]*)\}(?:\[[^\]\n]*\])?|\\end\{(?P<end>[^{}]*)\}|\\item\b[ \t]*(?:\[(?P<label>[^\]\n]*)\])?|(?P<par>\n\s*\n)|\n?" + MARK + r"(?P<mark>[HI])(?P<marked>[^\n]*)\n"
)
_LISTS = {"itemize", "enumerate", "description", "compactitem", "compactenum"}


def _latex_lines(text: str) -> Iterator[tuple[str, str]]:
    text = _re(r"\A.*?\\begin\{document\}|\\end\{document\}.*\Z", regex.S).sub("", text)
    at, inside, label = 0, "", ""  # what the run of text belongs to, and the item's label
    depth = table = 0
    for m in _latex_block.finditer(text):
        run = f"{label} {text[at : m.start()]}"
        at, label = m.end(), ""
        if run.strip():
            yield inside or "text", _re(r"(?<!\\)&").sub(" ", run) if table else run
            inside = ""
        if m["title"]:
            inside = ""
            yield "heading", m["title"][1:-1]
        elif m["mark"]:
            yield _MARKS[m["mark"]], m["marked"]
        elif (name := m["begin"]) is not None:
            if name.rstrip("*") in _LISTS:
                depth += 1
            elif name in ("tabular", "table", "tabularx", "longtable", "array"):
                table += 1
                at += len(_re(r"(?:\{[^{}]*\})*").match(text[at:])[0])
            inside = ""
        elif (name := m["end"]) is not None:
            if name.rstrip("*") in _LISTS:
                depth = max(0, depth - 1)
            elif name in ("tabular", "table", "tabularx", "longtable", "array"):
                table = max(0, table - 1)
            inside = ""
        elif m["par"]:
            inside = ""
        else:
            inside = "item" if depth else ""
            label = m["label"] or ""
    if text[at:].strip():
        yield inside or "text", label + text[at:]


# Inline markup

_any_tag = regex.compile(r"</?[a-zA-Z][^<>]*>")


def _no_tags(s: str) -> str:
    return _any_tag.sub(lambda m: " " if m[0][1:3].lower() == "br" else "", s)


def _reduce_html(s: str) -> str:
    return html.unescape(_no_tags(s))


_link = regex.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\](\p{L}*)")
_not_shown = regex.compile(r"\s*(?:file|image|category|datei|bild|kategorie|fichier|catégorie|archivo|categoría|файл|категория|ファイル|カテゴリ)\s*:", regex.I)


def _wiki_link(m) -> str:
    target, shown, trail = m[1], m[2], m[3]
    if _not_shown.match(target):
        return trail
    if shown is None:
        shown = target[1:] if target.startswith(":") else target
    elif not shown.strip():
        shown = _re(r"^[^:]*:|\s*\([^()]*\)$|,.*$").sub("", target)
    else:
        shown = shown.rsplit("|", 1)[-1]
    return shown + trail


def _reduce_wiki(s: str) -> str:
    while True:
        t = _link.sub(_wiki_link, s)
        if t == s:
            break
        s = t
    s = _re(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*\s+([^\[\]]*)\]|\[mailto:[^\s\]]*\s+([^\[\]]*)\]").sub(lambda m: m[1] or m[2] or "", s)
    s = _re(r"\[(?:https?:|ftp:)?//[^\s\[\]]*\]").sub("", s)
    s = _re(r"'{5}|'{2,3}").sub("", s)
    s = _re(r"__[A-Z]+__").sub("", s)
    return html.unescape(_no_tags(s))


_escape = regex.compile(r"\\([!-/:-@\[-`{-~])")
_STRESS = [regex.compile(rf"(?<![\\*])\*{{{n}}}(?![\s*])((?:[^*\n]|\n(?!\n)|(?<=\s)\*+(?=\s))+?)(?<!\s)\*{{{n}}}(?!\*)") for n in (3, 2, 1)]
_UNDER = [regex.compile(rf"(?<![\p{{L}}\p{{N}}_\\])_{{{n}}}(?![\s_])((?:[^_\n]|\n(?!\n)|(?<=[\p{{L}}\p{{N}}])_(?=[\p{{L}}\p{{N}}]))+?)(?<!\s)_{{{n}}}(?![\p{{L}}\p{{N}}_])") for n in (3, 2, 1)]


def _reduce_markdown(s: str) -> str:
    escaped: list[str] = []

    def keep(m) -> str:
        escaped.append(m[1])
        return f"\ue003{len(escaped) - 1}\ue004"

    s = _escape.sub(keep, s)
    while True:
        t = _re(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\([^()\s]*(?:\([^()]*\)[^()\s]*)?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[[^\[\]]*\])").sub(r"\1", s)
        if t == s:
            break
        s = t
    s = _re(r"<((?:https?|mailto|ftp):[^<>\s]*)>").sub(r"\1", s)
    for pattern in (*_STRESS, *_UNDER, *_STRESS):
        s = pattern.sub(r"\1", s)
    s = _re(r"~~(\S(?:.*?\S)?)~~").sub(r"\1", s)
    s = html.unescape(_no_tags(s))
    return _re("\ue003(\\d+)\ue004").sub(lambda m: escaped[int(m[1])], s)


_gone = regex.compile(r"~?\\(?:cite[a-z]*|footnote(?:mark|text)?|label|index|pagestyle|vspace|hspace|thanks|nocite|bibliography|includegraphics)\*?\s*(?:\[[^\]]*\])*\s*" + _brace)
_two = regex.compile(r"\\(?:href|textcolor|colorbox|hyperref|ifthenelse)\s*" + _brace.replace("arg", "first") + r"\s*" + _brace)
_one = regex.compile(r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?(?P<body>" + _brace + ")")
_switch = regex.compile(r"\\(?:bf|it|em|tt|sc|rm|sf|sl|bfseries|itshape|ttfamily|scshape|rmfamily|sffamily|slshape|tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge|centering|noindent|par)\b\s*")
#: Combining characters of the accent commands.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "r": "\u030a", "k": "\u0328"}
#: Commands that stand for characters.
SYMBOLS = {"ldots": "…", "dots": "…", "textbackslash": "\\", "ss": "ß", "ae": "æ", "AE": "Æ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "oe": "œ", "OE": "Œ", "l": "ł", "L": "Ł", "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "textasciitilde": "~", "textasciicircum": "^", "LaTeX": "LaTeX", "TeX": "TeX"}


def _reduce_latex(s: str) -> str:
    import unicodedata

    kept: list[str] = []

    def keep(c: str) -> str:
        kept.append(c)
        return f"\ue003{len(kept) - 1}\ue004"

    s = _re(r"\\\\(?:\[[^\]]*\])?").sub(" ", s)
    s = _re(r"\\([#$%&_{}])").sub(lambda m: keep(m[1]), s)
    s = _re(r"\\([`'^\"~=.])\s*(?:\{\\?(\p{L})\}|\\?(\p{L}))|\\([uvHcdbrk])(?:\{\\?(\p{L})\}|\s+(\p{L})\b)").sub(lambda m: keep(unicodedata.normalize("NFC", (m[2] or m[3] or m[5] or m[6]) + ACCENTS[m[1] or m[4]])), s)
    while True:
        t = _gone.sub("", s)
        t = _two.sub(lambda m: m["arg"][1:-1], t)
        t = _one.sub(lambda m: m["body"][1:-1], t)
        if t == s:
            break
        s = t
    s = _switch.sub("", s)
    s = _re(r"\\([a-zA-Z]+)\*?(?:\{\}|\s+|(?![a-zA-Z]))").sub(lambda m: keep(SYMBOLS[m[1]]) if m[1] in SYMBOLS else "", s)
    s = _re(r"\\[,;:! /@-]").sub(lambda m: " " if m[0][1] in ",;: " else "", s)
    s = _re(r"``|''").sub('"', s)
    s = _re(r"[{}]").sub("", s).replace("~", " ")
    return _re("\ue003(\\d+)\ue004").sub(lambda m: kept[int(m[1])], _no_tags(s))


_LINES = {"wiki": _wiki_lines, "html": _plain_lines, "markdown": _markdown_lines, "latex": _latex_lines, "plain": _plain_lines}
_REDUCE = {"wiki": _reduce_wiki, "html": _reduce_html, "markdown": _reduce_markdown, "latex": _reduce_latex, "plain": lambda s: _reduce_html(s) if "<" in s or "&" in s else s}


def pieces(text: str | None) -> list[tuple[str, str]]:
    """The distinct ('heading' | 'item' | 'code' | 'formula', content) of a text, in their order."""
    if not text or not text.strip():
        return []
    return list(dict.fromkeys((p, s) for p, s, _ in _Reader(text).blocks(texts=False)))


def clean(text: str | None) -> str | None:
    """The text without markup: headings begin with '# ', items with '- ', code stands
    between ``` lines, formulas between dollar signs; blocks are separated by empty lines."""
    if not text:
        return text
    form = {"heading": "# {}", "item": "- {}", "code": "```\n{}\n```", "text": "{}"}
    return "\n\n".join(form[p].format(s) for p, _, s in _Reader(text).blocks() if p != "formula")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kinds, contents = [], [], []
        for k, text in enumerate(batch.column(1)):
            for piece, content in pieces(text.as_py()):
                rows.append(k)
                kinds.append(piece)
                contents.append(content)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(contents, pa.string())], names=["id", "piece", "content"])


def structured_pieces(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """``id``, ``piece``, ``content``: the distinct headings, list items, code blocks and
    formulas of each record (see ``pieces``).

    Null, empty and blank texts and redirects have none; pieces without content are
    left out. Records with the same id, also a null one, give the union of their
    pieces once. Texts are read where they are; only pieces are shuffled.
    """
    kind = df.schema[id].dataType.simpleString()
    out = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), text).mapInArrow(_pieces, f"id {kind}, piece string, content string")
    return out.distinct().withColumnRenamed("id", id)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [clean(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def clean_texts(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """``id`` and ``text``, each text in the clean form of ``clean``; null stays null, rows keep their number."""
    kind = df.schema[id].dataType.simpleString()
    out = df.select(F.col(id).alias("id"), text).mapInArrow(_clean, f"id {kind}, text string")
    return out.withColumnsRenamed({"id": id, "text": text})
