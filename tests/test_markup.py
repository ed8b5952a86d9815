import pytest

from docloom.functions import chemistry as C
from docloom.functions import math_text as M
from docloom.functions import reply as R
from docloom.functions.html_markdown import html_to_markdown
from docloom.functions.omml import omml_to_latex


def test_reactions():
    assert C.plain_to_mhchem("Zn(s) + Cu2+(aq) -> Zn2+(aq) + Cu(s)") == "\\ce{Zn(s) + Cu^{2+}(aq) -> Zn^{2+}(aq) + Cu(s)}"
    assert C.plain_to_mhchem("Zn(s) + Cu2+(aq) ® Zn2+(aq) + Cu(s)") == "\\ce{Zn(s) + Cu^{2+}(aq) -> Zn^{2+}(aq) + Cu(s)}"


def test_prose_is_kept():
    text = "To prepare the cell, zinc is placed in a solution where Zn^{2+} and Cu^{2+} ions are found with other metals"
    out = C.plain_to_mhchem(text)
    assert out.startswith("To prepare the cell") and "$\\ce{Zn^{2+}}$" in out and "$\\ce{Cu^{2+}}$" in out and "\\ce{To" not in out


def test_wraps():
    assert C.normalize_markup("salts \\ce{ZnSO_{4} ,CuSO_{4}} are used") == "salts $\\ce{ZnSO_{4}, CuSO_{4}}$ are used"
    assert C.strip_spurious("\\ce{this is only a long piece of prose about metals}") == "this is only a long piece of prose about metals"
    assert C.strip_spurious("see \\ce{Zn(s) + more").startswith("see Zn(s)")
    assert C.wrap_macros("a \\ce {H2O} and \\pu{1 mol}") == "a $\\ce{H2O}$ and $\\pu{1 mol}$"
    assert C.wrap_macros("a $\\ce{H2O}$ \\pu{1 mol}") == "a $\\ce{H2O}$ \\pu{1 mol}"
    assert C.normalize_markup("no markup") == "no markup" and C.normalize_markup("") == ""


@pytest.mark.parametrize("text", ["\\ce{A -> B}\\ce{A -> B}", "$\\ce{A -> B}$$\\ce{A -> B}$", "$\\ce{A -> B}$ \\ce{A -> B} \\ce{A -> B}"])
def test_equal_formulas_become_one(text):
    assert C.dedupe_adjacent(text).count("\\ce{") == 1


def test_detectors():
    assert C.is_formula("H2O") and C.is_formula("ZnSO_{4}, CuSO_{4}") and not C.is_formula("the cat sat on the mat today")
    assert C.looks_like_chemistry("Zn(s) + Cu2+(aq) -> Cu(s)") and not C.looks_like_chemistry("Hello world")
    assert C.confidence("a", "plain") == 0.2 and C.confidence("x ® y", "\\ce{X^{2+} -> Y}") == 1.0
    assert C.extract_ce("so ```latex\n\\ce{H2O}\n```") == "\\ce{H2O}" and C.extract_ce("none") is None
    assert C.normalize_charges("H2 + O2") == "H2 + O2" and C.normalize_charges("Fe3+ Na+") == "Fe^{3+} Na^{+}"
    assert C.normalize_charges("H2 + O2", strict=True).startswith("H^{2+}")


def test_pieces_join_to_the_text():
    for text in ("a $x$ \\ce{b{c}d} e $$y$$ \\pu{open", "", "$", "\\ce{", "plain"):
        assert "".join(x for _, x in C.pieces(text)) == text


def test_math():
    assert M.plain_to_latex("x2 + π") == "$x^{2} + \\pi$" and M.plain_to_latex("1/2") == "$\\frac{1}{2}$" and M.plain_to_latex("a_1 * b") == "$a_{1} \\times b$"
    assert M.plain_to_latex("sqrt(2)") == "$\\sqrt{2}$" and M.plain_to_latex("$x$") == "$x$" and M.wrap("x", True) == "$$x$$"
    assert M.unwrap("\\[x\\]") == "x" and M.looks_like_math("x = 2") and not M.looks_like_math("Just words here")
    assert M.extract_latex("so $$a$$") == "$$a$$" and M.extract_latex("only prose here") is None
    assert M.confidence("a", "") == 0.2 and M.confidence("x^2", "$x^{2}$") > 0.7


def test_omml():
    m = lambda x: omml_to_latex(f"<m:oMath>{x}</m:oMath>")
    r = lambda x: f"<m:r><m:t>{x}</m:t></m:r>"
    assert m(r("x")) == "x" and m(r("𝜇")) == "\\mu " and m(r("a_b")) == "a\\_b"
    assert m(f"<m:f><m:num>{r('1')}</m:num><m:den>{r('2')}</m:den></m:f>") == "\\frac{1}{2}"
    assert m(f"<m:f><m:fPr><m:type m:val='lin'/></m:fPr><m:num>{r('1')}</m:num><m:den>{r('2')}</m:den></m:f>") == "{1}/{2}"
    assert m(f"<m:sSup><m:e>{r('x')}</m:e><m:sup>{r('2')}</m:sup></m:sSup>") == "x^{2}"
    assert m(f"<m:rad><m:deg>{r('3')}</m:deg><m:e>{r('x')}</m:e></m:rad>") == "\\sqrt[3]{x}"
    assert m(f"<m:d><m:e>{r('x')}</m:e></m:d>") == "\\left(x\\right)"
    assert m(f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=''/></m:dPr><m:e>{r('x')}</m:e></m:d>") == "\\left[x\\right."
    assert m(f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{r('i')}</m:sub><m:sup>{r('n')}</m:sup><m:e>{r('x')}</m:e></m:nary>") == "\\sum_{i}^{n}x"
    assert m(f"<m:func><m:fName>{r('sin')}</m:fName><m:e>{r('x')}</m:e></m:func>") == "\\sin(x)"
    assert m(f"<m:limLow><m:e>{r('lim')}</m:e><m:lim>{r('x→0')}</m:lim></m:limLow>") == "\\lim_{x\\to 0}"
    assert m(f"<m:m><m:mr><m:e>{r('a')}</m:e><m:e>{r('b')}</m:e></m:mr><m:mr><m:e>{r('c')}</m:e><m:e>{r('d')}</m:e></m:mr></m:m>") == "\\begin{matrix}a&b\\\\c&d\\end{matrix}"
    assert m(f"<m:acc><m:accPr><m:chr m:val='⃗'/></m:accPr><m:e>{r('v')}</m:e></m:acc>") == "\\vec{v}" and m(f"<m:bar><m:barPr><m:pos m:val='bot'/></m:barPr><m:e>{r('v')}</m:e></m:bar>") == "\\underline{v}"
    assert omml_to_latex("<p>none</p>") == ""


def test_replies():
    text = " ".join(f"Zinc reacts with copper sulfate in solution number {i} of the whole series." for i in range(12))
    short, wide = R.extractive_reply("zinc copper sulfate", [text], 40, 10), R.extractive_reply("zinc copper sulfate", [text], 40, 80)
    assert len(short.split()) <= 12 and len(wide) > len(short)
    assert R.extractive_reply("pythagoras", [text]) is None and R.extractive_reply("of", [text]) is None
    assert R.trim_repetition("One thing. Two things. One thing. Three things.") == "One thing. Two things."
    assert R.drop_incomplete_math("a $\\ce{Zn(s) +") == "a" and R.drop_incomplete_math("x ->") == "x"
    assert R.sentences_keeping_math("A is $x. y$ here. B.") == ["A is $x. y$ here.", "B."]
    assert R.segment_run("zincandcoppersulfate") == "zinc and copper sulfate" and R.segment_run("construction") == "construction"
    assert R.restore_spaces("one.Two(three)four") == "one. Two(three) four"
    assert R.polish("according to passage [1]: zinc dissolves.") == "Zinc dissolves."
    assert R.fallback_reply([]) == R.NO_CONTEXT_REPLY and R.fallback_reply(["This snippet is long enough to be quoted."]) == "This snippet is long enough to be quoted."
    prompt = R.chat_prompt("q" * 300, ["a" * 1000, "b"])
    assert "[1] " + "a" * 900 + "\n[2] b" in prompt and "q" * 201 not in prompt and prompt.endswith("<|im_start|>assistant\n")
    assert "passages" in R.chat_prompt("q", []) and "[1]" not in R.chat_prompt("q", [])


def test_html_output():
    assert R.format_html("a <b> & c") == "A &lt;b&gt; &amp; c" and R.format_html("") == ""
    assert '<span class="math">' in R.format_html("water is $\\ce{H2O}$ here")


def test_render_preparation_leaves_prose():
    prose = "The concentration of the solution is equal when such a device is called electrical"
    assert C.prepare_for_render(prose) == prose and C.prepare_for_render("\\ce{H2O}") == "$\\ce{H2O}$" and C.prepare_for_render("x^{2}") == "$x^{2}$"


def test_html_to_markdown():
    html = "<h1>Title</h1><p>Para <b>bold</b> and <em>it</em> <a href='/x' title='t'>l</a></p><ol start=3><li>one<li>two<ul><li>in</ul></ol><pre><code class='language-py'>x=1\n</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table><blockquote><p>q</p></blockquote><img src='data:x'><img src='i.png' alt='A'><p>a<br>b</p><script>no</script><hr><code>c`d</code>"
    want = '# Title\n\nPara **bold** and _it_ [l](/x "t")\n\n3.  one\n4.  two\n    *   in\n\n```py\nx=1\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n\n> q\n\n[image]![A](i.png)\n\na  \nb\n\n* * *\n\n``c`d``'
    assert html_to_markdown(html) == want
    assert html_to_markdown("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep" and html_to_markdown("") == ""


def test_reactions_with_arrow_glyphs_end():
    """An arrow that only becomes one when it is spelled out, and a reaction that is too long for a formula."""
    assert C.normalize_in_text("Zn→Cu") == "$\\ce{Zn->Cu}$"
    long = " + ".join(["Zn"] * 60) + " → Cu"
    assert C.normalize_in_text(long) == C.plain_to_mhchem(long) == long
