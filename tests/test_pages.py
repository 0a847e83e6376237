import random
import textwrap

import pytest
from pyspark.sql import functions as F

from eventmill.functions.urls import resolve_url
from eventmill.operators.pages import pages_to_text, wrap_paragraphs
from eventmill.plans.resources import problems_to_text


def convert(spark, html, **options):
    return pages_to_text(spark.createDataFrame([(1, html)], "page_id bigint, html string"), **options).first()["text"]


PAGES = [
    ("", "\n\n"),
    ("<p>a</p>", "a\n\n"),
    ("<h2>T</h2><p>x <b>y</b>  <em>z</em>", "## T\n\nx **y** _z_\n\n"),
    ("a&nbsp;&amp;&lt;&#8217;&copy;&foo;AT&T x", "a &<'(C)&foo;AT&T; x\n\n"),
    ("<ul><li>one<li>two<ol start=3><li>x</li><li>y</li></ol></li></ul>", "  * one\n  * two\n    3. x\n    4. y\n\n"),
    ("<ol><li>a<ol><li>b</ol><li>c</ol>", "  1. a\n    1. b\n  2. c\n\n"),
    ("<li>loose", "* loose\n\n"),
    ("<blockquote>q<blockquote>r</blockquote></blockquote>s", "> q\n\n>\n\n>> r\n\ns\n\n"),
    ("x<pre>a\n  <b>b</b></pre>y", "x\n\n    a\n      **b**\n\ny\n\n"),
    ("<a href='x&amp;y'>l</a> <a href='#z'>no</a> <a>n</a></a>", "[l](x&y) no n\n\n"),
    ('<a href=o>a<a href="#i">b</a>c</a>', "[abc](o)\n\n"),
    ("<img src=i.png alt='A &amp; b'/><img alt=x>", "![A & b](i.png)\n\n"),
    ("a<hr/>b", "a\n\n* * *\n\nb\n\n"),
    ("a<br>b<br/> c", "a\n\nb\n\nc\n\n"),
    ("<code>c</code><pre><code>d</code></pre>", "`c`\n\n    d\n\n"),
    ("<del>x</del> <strike>y</strike>", "<del>x</del> <strike>y</strike>\n\n"),
    ("<dl><dt>t</dt><dd>d</dd></dl>e", "t\n\n    d\ne\n\n"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "a\n\nb\n\nc\n\n"),
    ("<head><title>t</title></head><body>b", "b\n\n"),
    ("<head><title>t<body>b", "b\n\n"),
    ("<script>var t='</p>';</script><style>p{}</style>x<!-- <p> -->y", "xy\n\n"),
    ("</script>never seen", "\n"),
    ("<p>The <abbr title='World Health'>W<b>H</b>O</abbr> x", "The W**H**O x\n\n  *[W**H**O]: World Health\n\n"),
    ("a < b & c", "a < b & c\n\n"),
    ("<p title='a>b'>x</p>", "x\n\n"),
]


@pytest.fixture(scope="module")
def converted(spark):
    frame = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(PAGES)], "page_id bigint, html string")
    return {row.page_id: row.text for row in pages_to_text(frame).collect()}


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_page(converted, number):
    assert converted[number] == PAGES[number][1]


def test_options(spark):
    assert convert(spark, "<ul><li>a</ul>", list_mark="-") == "  - a\n\n"
    assert convert(spark, "<p>" + "word " * 40, width=0) == "word " * 40 + "\n"
    assert problems_to_text(spark.createDataFrame([(1, "<p>café — 中</p>")], "page_id bigint, html string")).first()["text"] == "cafe --\n\n"


def _wrapped(text, width):
    """The wrapping rules with the standard library, a paragraph at a time."""
    out, empty = "", 0
    for line in text.split("\n"):
        if not line:
            out, empty = (out + "\n", empty + 1) if empty < 2 else (out, empty)
        elif line[0] not in " -*":
            out, empty = out + "\n".join(textwrap.wrap(line, width)) + "\n\n", 2
        elif line.strip(" "):
            out, empty = out + line + "\n", 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_wrapping_agrees_with_the_standard_library(spark, seed):
    chance = random.Random(seed)
    parts = ["word", "a", "well-known", "x", "comma,", "(paren)", "é", "12-34", "semi;"] + (["l" * 95, "m" * 180] if seed % 2 else [])

    def line():
        start = chance.choice(["", "", "", "  ", "* ", "-"])
        return start + chance.choice([" ", " ", "  "]).join(chance.choice(parts) for _ in range(chance.randrange(45)))

    made = ["\n".join(line() for _ in range(chance.randrange(1, 12))) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(made)), "id bigint, t string")
    found = frame.select("id", wrap_paragraphs(F.col("t"), 78).alias("w")).orderBy("id").collect()
    different = [(made[row.id], row.w, _wrapped(made[row.id], 78)) for row in found if row.w != _wrapped(made[row.id], 78)]
    assert not different, different[0]


REFERENCES = [
    ("<a href='x'>l</a> <a href='/y' title=T>m</a> <a href='x'>n</a>", "[l][1] [m][2] [n][1]\n\n   [1]: http://h/d/x\n   [2]: http://h/y (T)\n\n"),
    ("<a href='a'>1<a href='b'>2</a>3</a> <img src=i alt=A>", "[1[2][1]3][2] ![A][3]\n\n   [1]: http://h/d/b\n   [2]: http://h/d/a\n   [3]: http://h/d/i\n\n"),
    ("<a href='#z'>no</a>", "no\n\n"),
    ("<a href='../u'>p</a><abbr title=W>v</abbr>", "[p][1]v\n\n   [1]: http://h/u\n\n  *[v]: W\n\n"),
]


def test_reference_links(spark):
    frame = spark.createDataFrame([(i, html, "http://h/d/p") for i, (html, _) in enumerate(REFERENCES)], "page_id bigint, html string, at string")
    found = pages_to_text(frame, inline_links=False, base=F.col("at")).orderBy("page_id").collect()
    assert [r.text.rstrip("\n") for r in found] == [text.rstrip("\n") for _, text in REFERENCES]
    assert convert(spark, "<a href='x'>l</a>", inline_links=False).rstrip("\n").endswith("   [1]: x")


def test_addresses_are_resolved_like_the_standard_library_does(spark):
    from urllib.parse import urljoin

    chance = random.Random(4)

    def address():
        path = "/".join(chance.choice(["", "a", "b.c", ".", "..", "d e", "%20", "é"]) for _ in range(chance.randrange(0, 6)))
        return (
            chance.choice(["", "", "", "http:", "HTTPS:", "mailto:", "ftp:"]) + chance.choice(["", "", "//host", "//h:80"])
            + path + chance.choice(["", "", "?q=1", "?"]) + chance.choice(["", "", "#f", "#"])
        )

    bases = ["http://a/b/c/d?q", "http://a", "https://h/x/", "http://h/x/../y/z", "", "mailto:x@y", "/just/a/path"]
    pairs = [(chance.choice(bases), address()) for _ in range(1500)] + [("http://a/b/c/d?q", u) for u in (
        "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g")]
    rows = spark.createDataFrame(pairs, "b string, u string").select("b", "u", resolve_url(F.col("b"), F.col("u")).alias("r")).collect()
    wrong = [(r.b, r.u, r.r, urljoin(r.b, r.u)) for r in rows if r.r != urljoin(r.b, r.u)]
    assert not wrong, (len(wrong), wrong[:8])
