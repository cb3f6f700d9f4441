"""Kernels of the text operators, without Spark."""

import collections
import os
import random

import pytest

from graphloom.llm import bpe, leaks, markup, truncation, wrappers

HAVE = os.path.exists(bpe.vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.skipif(not HAVE, reason="vocabulary files are not here")
def test_bpe_equals_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    own = bpe.Encoder(bpe.load_ranks(bpe.vocabulary_path()))
    rng = random.Random(5)
    alphabet = "aaabcdeé ß日本語🙂👩‍🚀\n\t\r  '’.,<|>endoftext0123½ﬁ​﻿"
    texts = ["", " ", "a", "<|endoftext|> <s>", "a" * 5000, "ab" * 3000 + " " * 700, "don't I'll we've", "\r\n\r\n x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    for t in texts:
        assert own(t) == lib.encode(t, add_special_tokens=False).ids
    assert own(None) == [] and own("") == []


def brute_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_equals_brute_force_on_a_small_vocabulary():
    rng = random.Random(1)
    tokens = [bytes([b]) for b in b"abc"]
    while len(tokens) < 40:
        t = rng.choice(tokens) + rng.choice(tokens)
        if t not in tokens:
            tokens.append(t)
    ranks = {t: i for i, t in enumerate(tokens)}
    for n in range(1, 60):
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(n))
            if piece not in ranks:
                assert bpe.merge(piece, ranks) == brute_merge(piece, ranks)


def test_leak_windows_equal_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]) for i in range(40)]
    p = leaks.Passages(items, 4)
    for _ in range(200):
        doc = [rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(0, 30))]
        want = set()
        for i, w in items:
            n = min(4, len(w))
            if any(doc[a : a + n] == w[b : b + n] for a in range(len(doc) - n + 1) for b in range(len(w) - n + 1)):
                want.add(i)
        assert {i for _, _, found in p.spans(" ".join(doc)) for i in found} == want
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    assert {(k, i) for k, _, _, i in p.scan(texts)} == {(k, i) for k, t in enumerate(texts) for _, _, found in p.spans(t) for i in found}


def test_leak_table_is_small(monkeypatch):
    rng = random.Random(9)
    items = [(i, [f"{rng.randrange(10**6)}" for _ in range(500)]) for i in range(100)]
    p = leaks.Passages(items, 12)
    held = len(p.text) + p.offsets.nbytes + p.ends.nbytes + p.items.nbytes + sum(x.nbytes for t in p.tables for x in t)
    assert held < 50 * 100 * 500
    monkeypatch.setattr(leaks, "SCAN_WORDS", 40)
    texts = [" ".join(w[i : i + 12]) for i, w in items] + [" ".join(w[:11]) for _, w in items]
    assert {(k, i) for k, _, _, i in p.scan(texts)} == {(k, k) for k in range(100)}


def test_leak_normalisation_and_removal():
    p = leaks.Passages([(1, leaks.words("Alpha beta, GAMMA"))], 12)
    assert p.spans("x ＡＬＰＨＡ be­ta—gam​ma y")
    assert not p.spans("alpha beta y gamma")
    assert leaks.cut_spans("Say alpha — beta, gamma. Then more.", [(1, 4)]) == "Say Then more."
    assert not leaks.Passages([(1, leaks.words("!!"))], 12).spans("!! a")


WIKI = """'''A''' belongs to [[B]].{{cite note|page=4}}<!--
## no
* no
-->
=== Foo<!-- c --> [[bar]]s<ref name="n">Note</ref> &amp; caf&eacute; ===\r
#One [[a page|Two]] ''three''<ref name=z />
:** deep &lt;5
<syntaxhighlight lang=java>
== x ==
a   && b
</syntaxhighlight>
{| class="wikitable"
! a !! b
|-
| * c || d
|}
<h2>
Html <b>head</b>
</h2>
<ol>
<li>outer<ul><li>inner</li></ul></li>
<li>open
</ol>
<nowiki>== [[no]] ==</nowiki> <math display="block">a <  b</math>"""

MARKDOWN = """**A** is `*next*` to [B](/p/x).

[Set][1] *text* \\& more
=====

## Atx __two__ ##

+ a_b `c_d`
  - inner \\*x\\*
2. num <!-- gone -->

~~~py
## no
- no
~~~

Old: $$
x_1 < 2
$$ , $y$ or $2 to $35.

| - a | b |
|---|---|

[1]: /p/q"""

LATEX = r"""\textbf{A} is here~\cite{k}. % \item no
\subsection*{One {\bf two} \& 5\%}
\begin{itemize}
  \item \href{/p}{Nar\emph{row}} x\footnote{gone}
  \begin{enumerate}
    \item a\_b
  \end{enumerate}
\end{itemize}
\begin{verbatim}
\item no % kept
\end{verbatim}
$a < b$ and $$c$$ and \(d\) and \[ e \] and \begin{equation}
f
\end{equation}
\begin{tabular}{ll}
g & h \\
\end{tabular}"""


def test_markup_pieces():
    assert markup.pieces(WIKI) == [
        ("heading", "Foo bars & café"), ("item", "One Two three"), ("item", "deep <5"), ("code", "== x == a && b"), ("heading", "Html head"),
        ("item", "outer"), ("item", "inner"), ("item", "open"), ("formula", "a < b"),
    ]
    assert markup.pieces(MARKDOWN) == [
        ("heading", "Set text & more"), ("heading", "Atx two"), ("item", "a_b c_d"), ("item", "inner *x*"), ("item", "num"), ("code", "## no - no"),
        ("formula", "x_1 < 2"), ("formula", "y"),
    ]
    assert markup.pieces(LATEX) == [
        ("heading", "One two & 5%"), ("item", "Narrow x"), ("item", "a_b"), ("code", r"\item no % kept"),
        *[("formula", c) for c in "a < b|c|d|e|f".split("|")],
    ]


def test_markup_edges():
    assert markup.pieces(None) == markup.pieces("") == markup.pieces(" \n") == []
    assert markup.pieces("#REDIRECT [[X]]") == []
    assert markup.pieces("Lot # 3 sold for $2 to $5.\n53 < x and x > 18, a_1_b") == []
    assert markup.clean(None) is None and markup.clean("") == ""
    assert markup.clean("'''A'''\n== B ==\n* c\n<pre>\nd\n  e\n</pre>") == "A\n\n# B\n\n- c\n\n```\nd\n  e\n```"
    long = "'''x''' " + "[[a|b]] {{" * 20000
    assert markup.pieces(long) == []


def test_stops():
    s = truncation.stop
    for whole in ["A b.", "A b, and so on…", 'He said "x."', "A b.</ref>", "x.\n* A b", "x.\n1. A", "x.\n== B ==", "x. --Me", "x.\n--Me 07:18, 18 May 2013 (UTC)", "x.\n[[Category:A b]]", "x\n|}", "```\na b\n```", "有名な村。", 'x (see "Y".)', "* [http://x y]"]:
        assert s(whole) not in truncation.CUT, whole
    for cut in ["The cat sat on", "A b. Mos", "A b [cut]", "A b [...]", "A b...[truncated]", "A b…", "A b >>", "A b<ref na", "A b[[", "di&am", "год�", "A b,", "x.<ref>A b.", "1882年、村が建設さ"]:
        assert s(cut, "Title") in truncation.CUT, cut
    assert s(None) == s("") == s(" \n") == "blank"
    assert s("Some Title", "Some Title") == "title"


def test_alignment_is_the_best_whatever_the_way(monkeypatch):
    rng = random.Random(1)
    some = ["<p>a</p>", "<p>b</p>", "<b>c</b>", "<i><b>d</b>e</i>", "<i>f</i>"]

    def weight(pairs):
        return sum(wrappers.match(x, y) + (not x.whole.isdisjoint(y.whole)) for x, y in pairs if x is not None and y is not None)

    for _ in range(30):
        x, y = (wrappers.parse("".join(rng.choice(some) for _ in range(rng.randint(1, 40)))).kids for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight([(x[i], y[j])]))
        for cells in (wrappers.MOST_CELLS, 4):
            with monkeypatch.context() as m:
                m.setattr(wrappers, "MOST_CELLS", cells)
                assert weight(wrappers.align(x, y)) == best[-1][-1]


PAGE = "<html><body><div class=nav><a>Home</a><a>About</a></div><h1>{0}</h1>{1}<ul>{2}</ul><p>Copyright the town</body></html>"


def test_wrapper_induction():
    pages = [PAGE.format(f"Title {i}", "<p>Body text %d" % i + ("<p>More" if i % 3 == 0 else ""), "".join(f"<li>item {i} {k}" for k in range(i % 4))) for i in range(12)]
    seen = collections.Counter()
    root = wrappers.Node.unpack(wrappers.template(pages[:5]).pack())
    for p in pages:
        seen.update({wrappers.place_hash(*x) for x in wrappers.places(root, wrappers.parse(p))})
    same = {h for h, n in seen.items() if n >= 6}
    assert root.n == 5
    assert wrappers.own_texts(root, wrappers.parse(pages[5]), same) == ["Title 5", "Body text 5", "item 5 0"]
    assert wrappers.own_texts(None, wrappers.parse(pages[1]), set())[0] == "Home"
    assert wrappers.match(wrappers.parse("<p>a<b>c</b>"), wrappers.parse("<p>a<i>x</i><b>d</b>")) == 1 + 1 + 1 + 1 + 1


def test_template_keeps_what_half_of_all_pages_have():
    """The footer is on the first 50 of 96 pages, the note on four of each 16."""
    pages = [f"<p>own {i}</p>" + ("<i>foot</i>" if i < 50 else "") + ("<b>note</b>" if i % 4 == 0 else "") for i in range(96)]
    root = wrappers.template(pages)
    assert root.n == 96 and [k.tag for k in root.kids] == ["p", "i"]
    assert root.kids[1].n >= 50 and wrappers.parse("<i>foot</i>").kids[0].whole <= root.kids[1].whole


def test_running_text_is_not_a_whole_ending():
    s = truncation.stop
    for cut in ["It was open from 1914–19", "The town grew — and th", "The town grew -- and th", "x.\n**Foo** is a town in the nor", "x.\n*Foo* is a town in the nor"]:
        assert s(cut, "Title") in truncation.CUT, cut
    for whole in ["Seen. — Me", "x.\n-- Me", "x.\n*A b", "x.\n** A *b* c"]:
        assert s(whole) not in truncation.CUT, whole
