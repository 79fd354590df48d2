"""HTML by a stack, XML by events, diagram labels and the resumable crawl, on fixtures and against plain versions."""

import re
import uuid
from html import escape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.records import mermaid_cleaned
from docweave.operators import crawl
from docweave.sources import html
from docweave.sources.render import _xml_blocks


def md(page):
    return html.markdown(page, least=0)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<h1>A <a href='/x'>link</a></h1><p>one\n two<p>three <b>bold</b>, <i>it</i> <code>a  b</code>", "# A [link](/x)\n\none two\n\nthree **bold**, *it* `a b`"),
        ("<ul><li>a<li>b<ul><li>c<ol><li>d<li>e</ol><li>f</ul><li>g</ul>", "- a\n- b\n  - c\n    1. d\n    2. e\n  - f\n- g"),
        ("<ol start=3><li><p>x</p><p>y</p></li><li>z</li></ol>", "3. x\n\n   y\n4. z"),
        ("<table><tr><th>k<th>v<tr><td>1<td>a|b<tr><td>2</table>after", "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n\nafter"),
        ("<table><thead><tr><td>h</td></tr></thead><tbody><tr><td><table><tr><td>in</td></tr></table></td></tr></tbody></table>", "| h |\n| --- |\n| \\| in \\| \\| --- \\| |"),
        ("<pre><code class='x language-py'>def f():\n    return 1 &lt; 2\n</code></pre>", "```py\ndef f():\n    return 1 < 2\n```"),
        ("<pre>\n a  b\n\n c</pre>", "```\n a  b\n\n c\n```"),
        ("<p><b>never closed<br><p>next</b> one", "**never closed**\n\nnext one"),
        ("<blockquote><p>a</p><ul><li>b</ul></blockquote>", "> a\n>\n> - b"),
        ("<nav>n</nav><script>var x = '</p>';</script><style>p{}</style><div>d<footer>f</footer></div><!-- c -->", "d"),
        ("<p>a<hr>b<img src=i.png alt='pic'><br/>c", "a\n\n---\n\nb![pic](i.png)\nc"),
        ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n- d1\n- d2"),
        ("</p></div>text</b>", "text"),
        ("&amp;lt; &eacute; &nbsp;x", "&lt; é  x"),
        ("", ""),
        ("a<p", "a<p"),
    ],
)
def test_html_fixtures(page, want):
    assert md(page) == want


def test_short_pages_keep_their_navigation():
    page = "<nav><a href='/a'>menu</a></nav><p>short</p><footer>imprint</footer><script>no</script>"
    assert html.markdown(page) == "[menu](/a)\n\nshort\n\nimprint" and md(page) == "short"
    assert "menu" not in html.markdown(page.replace("short", "long enough " * 20)) and html.markdown(None) is None


_words = st.text(alphabet="abcdefg", min_size=1, max_size=6)
_inline = st.recursive(_words, lambda x: st.tuples(st.sampled_from(["b", "i", "span", "code"]), st.lists(x, min_size=1, max_size=3)), max_leaves=6)
_block = st.recursive(
    st.tuples(st.just("p"), st.lists(_inline, min_size=1, max_size=3)),
    lambda x: st.tuples(st.sampled_from(["div", "ul", "ol", "blockquote", "section", "table"]), st.lists(x, min_size=1, max_size=3)),
    max_leaves=10,
)


def _written(node, close=True):
    """A tree as HTML, end tags that may be left out with or without."""
    if isinstance(node, str):
        return escape(node) + " "
    tag, inner = node
    body = [_written(x, close) for x in inner]
    end = lambda t: f"</{t}>" if close else ""
    if tag in ("ul", "ol"):
        return f"<{tag}>" + "".join(f"<li>{b}{end('li')}" for b in body) + f"</{tag}>"
    if tag == "table":
        return "<table>" + "".join(f"<tr>{end('')}<td>{b}{end('td')}{end('tr')}" if not close else f"<tr><td>{b}</td></tr>" for b in body) + "</table>"
    return f"<{tag}>{''.join(body)}" + ("" if tag == "p" and not close else f"</{tag}>")


def _text(node):
    return node if isinstance(node, str) else "".join(_text(x) for x in node[1])


@settings(max_examples=150, deadline=None)
@given(st.lists(_block, min_size=1, max_size=4))
def test_all_text_comes_out_once_and_in_order(blocks):
    letters = "".join(map(_text, blocks))
    whole, bare = ("".join(_written(b, close) for b in blocks) for close in (True, False))
    assert re.sub("[^a-g]", "", md(whole)) == letters
    assert md(bare) == md(whole)  # ends that are implied change nothing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "</ul>", "<li>", "</li>", "<table>", "<tr>", "<td>", "</table>", "<pre>", "</pre>", "<h2>", "</h2>", "x", " y ", "<a href=u>", "</a>", "<br>"]), max_size=40))
def test_any_tags_give_their_text(parts):
    assert sorted(re.sub("[^xy]", "", md("".join(parts)))) == sorted(c for p in parts for c in p if not p.startswith("<") and c in "xy")


def test_deep_nesting_and_long_pages():
    assert md("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert md("<ul><li>" * 300 + "deep").strip().endswith("deep")
    assert md("<p>word " * 50_000).count("word") == 50_000


def test_html_column(spark):
    df = spark.createDataFrame([("<p>a",), (None,), ("",)], "h string").select(html.tree_markdown(F.col("h")).alias("m"))
    assert [r.m for r in df.collect()] == ["a", None, ""]


# XML and diagrams ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("<book><title>T</title><chapter><title>C</title><section><title>S</title><para>p</para></section></chapter></book>", ["# T", "## C", "## S", "p"]),
        ("<article><para>a <emphasis>b <code>c</code></emphasis> d<xref linkend='x'/> e</para></article>", ["a *b c* d [x] e"]),
        ("<section><itemizedlist><listitem><para>one <code>x</code></para></listitem><listitem>two</listitem></itemizedlist></section>", ["- one x", "- two"]),
        ("<topic><title>T</title>loose text<programlisting> a\n  b </programlisting></topic>", ["# T", "```\na\n  b\n```"]),
        ("<topic><note>text</note><note><para/></note><index><para>no</para></index></topic>", ["text"]),
        ("<d:section xmlns:d='u'><d:title>N</d:title><d:para><d:ulink url='http://h'>l</d:ulink><d:ulink>m</d:ulink></d:para></d:section>", ["## N", "[l](http://h) m"]),
        ("<a>broken <b>text", ["broken text"]),
        ("<glossary><title>only</title></glossary>", ["## only"]),
        ("<part><title>A</title><title>B</title><table><row>x</row><row>y</row></table></part>", ["# A", "xy"]),
    ],
)
def test_xml_fixtures(text, want):
    assert _xml_blocks(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("graph TD\n A[x (1)] --> B", "graph TD\n A[x 1] --> B"),
        ("A -->|go {now}| B([s <t>])", "A -->|go now| B([s t])"),
        ("A -- calls (it) --> B", "A -->|calls it| B"),
        ("A <-.->|\"q\"| B\nlinkStyle 0 stroke:red\nC", "A <-.->|q| B\n\nC"),
        ("A[one [two] three]", "A[one two three]"),
        ("A[open --> B", "A[open --> B"),
        ("A --- B|x|", "A --- B|x|"),
        (None, None),
        ("", ""),
    ],
)
def test_diagram_labels(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(mermaid_cleaned(F.col("t"))).first()[0] == want


# crawl ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url,base,want",
    [
        ("HTTP://Ex.COM:80/a/?utm_source=x&b=1#f", None, "http://ex.com/a?b=1"),
        ("../c", "https://h.org/a/b", "https://h.org/c"),
        ("//other.org/x/", "https://h.org/", "https://other.org/x"),
        ("https://h.org", None, "https://h.org"),
        ("mailto:a@b.c", "https://h.org", None),
        ("x", None, None),
        (None, None, None),
        ("http://h:bad/", None, None),
    ],
)
def test_canonical_urls(url, base, want):
    assert crawl.canonical(url, base) == want


PAGES = {
    "http://s.org": "<a href='/a'>a</a><a href='/b/'>b</a><a href=\"http://away.org/x\">x</a><a href='/gone'>g</a>",
    "http://s.org/a": "<A class=k HREF='b#top'>b</A><a href='/c?utm_medium=y'>c</a><a href='/f.pdf'>f</a>",
    "http://s.org/b": "<a href='/a'>a</a><a href='javascript:x()'>j</a><a href='/d'>d</a>",
    "http://s.org/c": "<a href='/e'>e</a>",
    "http://s.org/d": "<a href='/e'>e</a>",
    "http://s.org/e": "",
    "http://away.org/x": "<a href='http://s.org/e'>e</a>",
}


def web(spark):
    return spark.createDataFrame(list(PAGES.items()), "url string, html string").select(crawl.canonical_url("url").alias("url"), "html")


def test_crawl_stopped_and_resumed(spark, tmp_path):
    starts = spark.createDataFrame([("http://S.org/",), (None,)], "url string")
    want = {"http://s.org": 0, "http://s.org/a": 1, "http://s.org/b": 1, "http://s.org/c": 2, "http://s.org/d": 2, "http://s.org/e": 3}

    def new():
        own = crawl.Crawl(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
        own.start(starts)
        return own

    whole = new()
    assert dict(map(tuple, whole.run(web(spark), max_depth=5).collect())) == want
    everything = sorted(map(tuple, whole.state().collect()))
    assert ("http://s.org/gone", 1, crawl.MISSING) in everything and not any("f.pdf" in u or "away" in u for u, _, _ in everything)
    parts = new()
    for _ in range(8):
        crawl.Crawl(spark, parts.path).run(web(spark), max_depth=5, max_rounds=1)
    assert sorted(map(tuple, parts.state().collect())) == everything
    few = new()
    assert dict(map(tuple, few.run(web(spark), max_depth=5, max_pages=2).collect())) == {"http://s.org": 0, "http://s.org/a": 1}
    assert dict(map(tuple, few.run(web(spark), max_depth=5).collect())) == want  # larger budgets go on
    assert dict(map(tuple, new().run(web(spark), max_depth=1).collect())) == {u: d for u, d in want.items() if d <= 1}
    assert new().run(web(spark), max_seconds=0).collect() == []


def test_a_round_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    own = crawl.Crawl(spark, f"file://{tmp_path}/c")
    own.start(spark.createDataFrame([("http://s.org",)], "url string"))
    own.run(web(spark), max_rounds=1)
    (tmp_path / "c" / "r2").mkdir()  # begun, without the mark of completion
    assert own.rounds() == 1
    assert len(own.run(web(spark), max_depth=5).collect()) == 6
