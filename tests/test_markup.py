import pytest

from folioscope.functions import markup as m
from folioscope.functions import render as r

SALT = "<html><body><h1>Salt</h1><p>Salt is a mineral.<p>It is <b>white</b> &amp; common.<h2>Formation</h2><p>Beds form.<h3>Mining</h3><p>Salt mining.<h2>Uses</h2><p>Food.</body></html>"


def test_html_sections():
    got = m.html_sections(SALT)
    assert got == [("_intro", ["Salt is a mineral.", "It is white & common."]), ("Formation", ["Beds form.", "Salt mining."]), ("Mining", ["Salt mining."]), ("Uses", ["Food."])]
    assert m.html_section_content(SALT, " USES ") == "<p>Food.</body></html>"
    assert m.html_section_content(SALT, "none") is None and m.html_section_content(SALT, "") is None


def test_html_paragraphs_skip_and_strict():
    page = '<p>a<table><tr><td><table><p>in</table><p>in</table> b</p>tail<div>no</div><p>c<sup>1</sup><div class="hatnote">see <p>x</div>'
    assert m.html_paragraphs(page) == ["a b", "c"] or m.html_paragraphs(page) == ["a btail", "c"]
    assert m.html_paragraphs(page, strict=True)[0] == "a b"


@pytest.mark.parametrize(("given", "expected"), [("&amp;lt;", "&lt;"), ("&#65;&#x42;", "AB"), ("&#99999999999;", "�"), ("&eacute;", "&eacute;"), ("&#xFFFFFFFFF;", "�")])
def test_simple_unescape(given, expected):
    assert m.simple_unescape(given) == expected


def test_percent_decode():
    assert m.percent_decode("a%20b+c%zz") == "a b+c%zz" and m.percent_decode("%FF%41") == "\ufffdA" and m.percent_decode("%C3%A9") == "é"


MD = "# Zinc\n\n*For other uses, see X.*\n\nZinc is [[Metal|a metal]].\n\n## History\n\nOld.\n\n### India\n\nSmelting.\n\n```\n## no\n```\n\n## **Uses**\n\n- one\n- two\n\nText."


def test_markdown_sections():
    assert m.md_sections(MD) == [("_intro", ["Zinc is a metal."]), ("History", ["Old.", "Smelting."]), ("India", ["Smelting."]), ("Uses", ["- one - two", "Text."])]
    assert m.md_section_content(MD, "uses") == "- one\n- two\n\nText."
    assert m.md_section_content(MD, "no") is None
    assert m.is_blank_article("# A\n\n[[B]]\n") and m.is_blank_article("# A") and not m.is_blank_article(MD)
    assert m.index_text(MD) == "# Zinc\n\nZinc is [[Metal|a metal]]."


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<p>a <b>b</b><br>c</p>", "a **b**\n\nc\n"),
        ("<h1>T</h1><p>x", "# T\n\nx\n"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c\n"),
        ('<ol start="3"><li>a<li value="7">b</ol>', "3. a\n7. b\n"),
        ("<table><tr><th>A<th>B<tr><td>1<td>2|3</table>", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |\n"),
        ('<table><tr><td colspan="2">x</table>', '<table>\n<tr><td colspan="2">x</td></tr>\n</table>\n'),
        ('<p><a href="./New_York">New York</a>, <a href="A%C3%A9">x</a> <a href="https://e.org/a_(b">e</a> <a href="#f">g</a><a href="File:x">y</a></p>', "[[New York]], [[Aé|x]] [e](https://e.org/a_%28b) g\n"),
        ("<dl><dt>t<dd>d<dd>e</dl>", "- **t**: d\n  - e\n"),
        ("<pre>a\n  b</pre><blockquote><p>q</blockquote>", "```\na\n  b\n```\n\n> q\n"),
        ("<p>H<sub>2</sub>O x<sup>2</sup><sup>[1]</sup> 2*3</p><script>x</script>", "H~2~O x^2^ 2\\*3\n"),
        ("<h2>Empty</h2><h2>References</h2><p>r</p><h2>Kept</h2><p>k", "## Kept\n\nk\n"),
        ('<table class="infobox"><tr><th>Born:</th><td>1900</td></tr></table><p>i</p><h2>S</h2><p>s', "i\n\n## Key facts\n\n- **Born**: 1900\n\n## S\n\ns\n"),
        ("", "\n"),
    ],
)
def test_render(source, expected):
    assert r.html_to_md(source) == expected


def test_dropped_sections_follow_the_language():
    page = "<h2>See also</h2><p>a<h2>Family tree</h2><p>b<h2>Works  cited</h2><p>c<h2>Notas</h2><p>d<h2>Bibliographie</h2><p>e<h2>Véase también</h2><p>f"
    assert [line for line in r.html_to_md(page).split("\n") if line.startswith("#")] == ["## See also", "## Notas", "## Bibliographie", "## Véase también"]
    assert "## Notas" not in r.html_to_md(page, lang="spa") and "## Bibliographie" in r.html_to_md(page, lang="es-ES")
    assert "## Bibliographie" not in r.html_to_md(page, lang="fra, eng")


def test_odd_pages_render():
    assert r.html_to_md('<ol start="²"><li value="³">a<li>b</ol>') == "1. a\n2. b\n"
    assert r.html_to_md('<pre class="x lang-py">a</pre>') == "```python\na\n```\n" and r.html_to_md('<pre class="lang-Zig">a</pre>').startswith("```zig")
    deep = r.html_to_md("<div>" * 3000 + "<p>in</p>" + "</div>" * 3000 + "<p>after</p>")
    assert "in" in deep and "after" in deep
    assert "inmost" in r.html_to_md("<b>" * 5000 + "inmost")
    assert r.html_to_md("<dl><dt>t<dd>d<dl><dt>u<dd>e</dl></dl>") == "- **t**: d\n  - **u**: e\n"
    spanish = '<body><div id="mw-content-text"><p>x [edit][editar]</p></div><div id="mw-normal-catlinks"><ul><li>M</li></ul></div>'
    assert r.html_to_md(spanish, lang="spa") == "x \n\n## Categorías\n\n- M\n"
    assert r.html_to_md("<nav><p>a</nav><aside><p>b</aside><p class=ambox>d</p><p class=sidebar>e</p>") == "a\n\nb\n"


def test_language():
    assert [r.language(x) for x in ("fra", "fre", "fr-FR", "fra, eng", "spa", "esp", "es-ES", "eng", "", None)] == ["fr"] * 4 + ["es"] * 3 + ["eng", "", ""]


def test_paragraph_closers():
    assert m.html_paragraphs("<p>a<li>b<p>c<hr>d<p>e<section>f") == ["a", "c", "ef"]


def test_render_wiki_page():
    page = '<body><h1 id="firstHeading">Zinc</h1><div id="mw-content-text"><div class="mw-parser-output"><div class="hatnote">See <i>X</i></div><p>Zinc</p></div></div><div id="mw-normal-catlinks"><ul><li>Metals</li></ul></div>'
    assert r.html_to_md(page, lang="fr") == "# Zinc\n\n*See X*\n\nZinc\n\n## Catégories\n\n- Metals\n"
    assert "Metals" not in r.html_to_md(page, categories=False)
