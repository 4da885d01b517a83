import time

import pytest

from lodequery.llm.markup import clean, clean_heading, clean_passages, families, heading_families, markup_found


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a <b>word</b>", {"html"}), ("x<br/>y", {"html"}), ("<BR />", {"html"}), ("<!-- note -->", {"html"}), ("R &amp; D", {"html"}),
        ("it&#8217;s &#x2014;", {"html"}), ('<a href="u"\n>x</ a>', {"html"}), ("# Title", {"markdown"}), ("Title\n=====", {"markdown"}),
        ("Title\n-----\n", {"markdown"}), ("- item", {"markdown"}), ("1. item", {"markdown"}), ("+ item", {"markdown"}), ("> quoted", {"markdown"}),
        ("a **bold** b", {"markdown"}), ("a *word* b", {"markdown"}), ("a __b c__ d", {"markdown"}), ("~~gone~~", {"markdown"}), ("`x`", {"markdown"}),
        ("[a](http://x.example/y)", {"markdown"}), ("![a](u.png)", {"markdown"}), ("a [b c][ref1] d", {"markdown"}), ("[ref1]: http://x.example", {"markdown"}),
        ("| a | b |\n|---|:--:|\n| c | d |", {"markdown"}), ("```\n# no <b> **x** $x^2$ [[y]]\n```", {"markdown"}), ("~~~sh\necho <b>\n~~~", {"markdown"}),
        ("== Title ==", {"wiki"}), ("[[a|b]]", {"wiki"}), ("{{a|b=c}}", {"wiki"}), ("{{a\n| b = c\n}}", {"wiki"}), ("'''bold'''", {"wiki"}), ("''it''", {"wiki"}),
        ('{| class="w"\n! a\n|-\n| b || c\n|}', {"wiki"}), ("[https://x.example label]", {"wiki"}), ("#REDIRECT [[a]]", {"wiki"}),
        ("\\section{A}", {"latex"}), ("a~\\cite{b}", {"latex"}), ("{\\bf a b}", {"latex"}), ("the $n$-th", {"latex"}), ("$x^2+y_{i}$", {"latex"}), ("\\(a \\le b\\)", {"latex"}),
        ("\\[ a = b \\]", {"latex"}), ("$$\\sum_{i=1}^{n} w_i$$", {"latex"}), ("\\begin{verbatim}\n<b> **x**\n\\end{verbatim}", {"latex"}),
        ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", {"latex"}), ("\\item a", {"latex"}), ("<p>**a b**</p>", {"html", "markdown"}),
    ],
)
def test_families(text, want):
    assert families(text) == want
    assert not families(text) or clean(text) is not None


@pytest.mark.parametrize(
    "text",
    [
        None, "", "plain text.", "From $5 to $9 highway", "It costs $5 for a tunnel and $12 for b.", "R&D wants needle; Q&A wants invoice.", "5 * 3 and 4 * 5 * 6",
        "2**10 and ~30", "a < b and b > 3", "The C# and F# differ.", "See ticket #42", "#3 query", "[sic] and note [3]", "max_packet_count", "Use {candle} here",
        "It is 5'' wide, it is 3 feet.", "Open C:\\orchard\\alpha first.", "path ~/barrel_old/jungle.", "If a == 3 then wait -> b.", "Run a | b in a pipe.",
        "box7@post.example, attn. a & b.", "user (v2) - winter", "a[[1]] = 2", "a >= 7, 😀 as planned", "List<String> and Map<K, V>", "x" * 100_000, "1.5 and 3.14",
    ],
)
def test_signs_of_plain_text_are_no_markup(text):
    assert families(text) == set() and clean(text) == text


def test_structure_is_kept():
    html = "<h2>A title</h2><p>One &amp; two<br>three</p><ul><li>x</li><li>y</li></ul><pre><code>if a &lt; 3:\n  go()</code></pre><table><tr><th>a</th><td>b</td></tr></table>"
    got = clean(html)
    assert "## A title" in got and "One & two\nthree" in got and "- x" in got and "- y" in got and "```\nif a < 3:\n  go()\n```" in got and "a | b" in got
    assert "<" not in got.replace("a < 3", "") and "&amp;" not in got
    latex = clean("\\section{Top}\nText with \\textbf{bold \\emph{deep}} and $x^2$.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}\n\\[ a = b \\]")
    assert "# Top" in latex and "bold deep" in latex and "$x^2$" in latex and "- one" in latex and "a | b" in latex and "$$a = b$$" in latex and "\\" not in latex
    wiki = clean("== Head ==\n'''Bold''' [[page|shown]] [https://x.example there]\n{| class=\"w\"\n! h\n|-\n| c || d\n|}")
    assert "## Head" in wiki and "Bold shown there" in wiki and "c | d" in wiki and "[[" not in wiki and "'''" not in wiki
    md = clean("Title\n=====\n\n* a **b**\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n> said [so](http://u.example)\n\n`code` and ~~gone~~")
    assert md.startswith("# Title") and "- a b" in md and "x | y" in md and "1 | 2" in md and "said so" in md and "`code` and gone" in md and "---" not in md


def test_residue_paths_fall_out_and_prose_stays():
    prose = "A long sentence about the harbor, its ships, and the weather of the day. " * 4
    got = clean(f"{prose}\n\n{{{{nav|a}}}}\n\n{prose}\n\n[ref1]: https://x.example/y\n\n![p](u.png)\n\n**end** of it.")
    assert got.count("harbor") == 8 and "ref1" not in got and "nav" not in got and "end of it." in got


def test_headings():
    assert heading_families("A > ## b > C") == {"markdown"} and clean_heading("A > ## b > C") == "A > b > C"
    assert clean_heading("<b>x</b> y > $5 to $9") == "x y > $5 to $9" and clean_heading(None) is None and clean_heading("") == ""
    assert heading_families("a > b") == set() == heading_families(None)


def test_table(spark):
    rows = [(1, "<b>a</b>", "# x", 0), (1, "<b>a</b>", "# x", 0), (2, None, None, 1), (3, "", "", 1), (None, "<b>", "x", 2), (4, "plain", "a > `b`", 3)]
    df = spark.createDataFrame(rows, "passage_id bigint, text string, heading string, p int")
    out = {r["passage_id"]: r for r in clean_passages(df).collect()}
    assert set(out) == {1, 2, 3, 4} and out[1]["text"] == "a" and out[1]["heading"] == "x" and out[2]["text"] is None and out[4]["text"] == "plain"
    got = {tuple(r) for r in markup_found(clean_passages(df)).collect()}
    assert got == {(1, "text", "html"), (1, "heading", "markdown"), (4, "heading", "markdown")}
    assert markup_found(clean_passages(df.limit(0))).count() == 0


def test_element_paths_leave_out_what_stands_beside_the_content():
    prose = "A long sentence about the harbor, its ships, and the weather of the day. " * 4
    links = "<li><a href='u'>Home</a></li><li><a href='v'>News</a> | <a href='w'>Shop</a></li>"
    page = f"""<style>p {{ color: red }}</style><script>if (a < b) go("x");</script><nav>Menu<ul>{links}</ul></nav><article><h2>Ships</h2>
<p>{prose}<p>See <a href='u'>the harbor
page</a> too<ul><li>tugs</li><li>a <a href='v'>ferry</a></li></ul><blockquote>Short. But said</blockquote></article>
<aside><h3>Related</h3><ul>{links}</ul></aside><footer><div>Imprint</div></footer>"""
    got = clean(page)
    for gone in ("color", "go(", "Menu", "Home", "News", "Shop", "Related", "Imprint"):
        assert gone not in got, gone
    for kept in ("## Ships", "weather", "the harbor\npage too", "- tugs", "- a ferry", "Short. But said"):
        assert kept in got, kept
    assert "Home" not in clean(f"{prose}\n\n- [Home](http://x.example)\n- [News](http://y.example)\n- **kept**\n\n> quoted")
    assert clean("<script> is a tag, <b>bold</b>") == "is a tag, bold"
    assert len(clean("<div>x" * 20_000)) >= 20_000


def test_nested_parts_are_taken_off_at_any_depth():
    prose = "A long sentence about the harbor, its ships, and the weather of the day. " * 4
    assert "{" not in clean(f"{prose}\n\n{{{{a|{{{{b}}}}}}}}\n\n{prose}") and clean("{{a|{{b|{{c}}}}}}") == "a b c"
    assert clean("\\textbf{" * 20 + "deep" + "}" * 20) == "deep"
    assert clean("[[File:a|" * 9 + "x" + "]]" * 9).strip("[]") == "x"


@pytest.mark.parametrize(("opening", "closing", "family"), [("**", "**", "markdown"), ("_", "_", "markdown"), ("~~", "~~", "markdown"), ("`", "`", "markdown"), ("''", "''", "wiki"), ("[[", "]]", "wiki"), ("[http://x.example ", "]", "wiki"), ("[", "][ref]", "markdown")])
def test_stretches_of_any_length(opening, closing, family):
    for n in (1, 4_500, 200_000):
        text = f"see {opening}{'x' * n}{closing} end"
        assert families(text) == {family}
        kept = "`" if opening == "`" else ""
        assert clean(text) == f"see {kept}{'x' * n}{kept} end"


@pytest.mark.parametrize("part", ["* ", "**a ", "_a", "`a ", "~~a ", "''a ", "[[a ", "[http://x y ", "[a][", "$a ", "\\textbf{"])
def test_long_runs_of_open_signs_take_linear_time(part):
    began = time.perf_counter()
    clean(part * (200_000 // len(part)))
    assert time.perf_counter() - began < 20
