from pyspark.sql import functions as F

from gleanery.operators.links import page_links
from gleanery.operators.pages import _chrome_repair, chrome_is_regular, page_blocks, page_markdown, strip_chrome

CHROME = [
    # page, without chrome, regular?
    ("<p>a</p>", "<p>a</p>", True),
    ("<header>x</header><p>a</p><FOOTER class='f'>y</FOOTER >", "<p>a</p>", True),
    ("<header>1</header>a<header>2</header>", "a", True),
    ("<header>a<header>b</header>c</header>d", "d", False),
    ("<div><header>a</div>b", "<div></div>b", False),
    ("<div>a<footer>b", "<div>a", False),
    ("a</footer>b", "a</footer>b", False),
    ("<header>a<footer>b</footer>c</header>d", "d", False),
    ("<header>a<header>b</header>c", "", False),
    ("<script>'<header>'</script>a<footer>f</footer>", "<script>'<header>'</script>a", False),
    ("<!-- <footer> -->a<footer>f\nf</footer>b", "<!-- <footer> -->a b".replace(" b", "b"), False),
    ("<header/>a<p>b</p>", "a<p>b</p>", False),
    ("<headers>a</headers><p>b", "<headers>a</headers><p>b", True),
]


def test_strip_chrome_on_regular_and_irregular_pages(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CHROME)], "page_id int, html string")
    flags = [r[0] for r in df.orderBy("page_id").select(chrome_is_regular(F.col("html"))).collect()]
    assert flags == [c[2] for c in CHROME]
    once = strip_chrome(df)
    assert [r.html for r in once.orderBy("page_id").collect()] == [c[1] for c in CHROME]
    assert strip_chrome(once).orderBy("page_id").collect() == once.orderBy("page_id").collect()


def test_both_ways_agree_on_regular_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    pages = pages.withColumn("html", F.concat(F.lit("<header>h</header>"), F.col("html")))
    both = strip_chrome(pages).join(pages.select("page_id", _chrome_repair()("html").alias("other")), "page_id")
    assert both.count() == pages.count()
    assert both.where("html <> other or html like '%<footer%' or html like '%<header%'").count() == 0


def test_null_page_stays_null(spark):
    df = spark.createDataFrame([(1, None)], "page_id int, html string")
    assert strip_chrome(df).first().html is None


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>H</header>
<h2 class="x"> Two </h2><p>Some <b>bold</b>, <em>soft</em> text<br>next
line &amp; more</p><!-- no --><script>var t = "</p>";</script>
<ul><li>one</li><li><a class="l" href='/x?a=1&amp;b=2'>two</a></li><li></li></ul><hr>
<table><tr><th>k<th>v</th></tr><tr><td>a</td>
 <TD class="n">1</TD></tr></table><a>bare</a> <a data-href="/no" href=/yes>q</a> <img src="/i.png" alt="pic"><img src="/j.png"> 1 < 2
<footer>F</footer></body></html>"""


def test_markdown_of_every_tag_kind(spark):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_id bigint, url string, html string")
    expected = [
        ("heading", "## Two"),
        ("text", "Some **bold**, _soft_ text\nnext line & more"),
        ("item", "* one"),
        ("item", "* [two](/x?a=1&b=2)"),
        ("item", "* * *"),
        ("text", "kv"),
        ("text", "a| 1"),
        ("text", "bare [q](/yes) ![pic](/i.png)![](/j.png) 1 < 2"),
    ]
    got = page_blocks(df).orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in got] == expected
    assert [r.block_no for r in got] == list(range(len(expected)))
    assert page_markdown(df).first().markdown == "\n\n".join(text for _, text in expected)


STRUCTURE = [
    (
        "<ol><li>one<ul><li>a<li>b<ol><li>deep</li></ol></li></ul></li><li>two</li></ol><p>end",
        "1. one\n\n  * a\n\n  * b\n\n    1. deep\n\n2. two\n\nend",
    ),
    ('<ol start="5"><li>five</li><li><b>six</b></li></ol><ul><li>x</li></ul>', "5. five\n\n6. **six**\n\n* x"),
    ("<ul><li>a<ul><li>b</li></ul></li></ul></ul><li>stray</li>", "* a\n\n  * b\n\n* stray"),
    ("<ul><li>plain</li><li>list</li></ul>", "* plain\n\n* list"),
    (
        "<p>x  y</p><pre class='c'>\ndef f():\n    return <b>1</b> &lt; 2\n\n\tend  \n</pre><p>z</p>",
        "x y\n\n    def f():\n        return **1** < 2\n    \n        end\n\nz",
    ),
    ("<PRE>word</PRE>after", "    word\n\nafter"),
    (
        "<table><tr><th>name</th><th>price</th></tr><tr><td>a</td><td>1</td></tr></table><table><tr><td>b</td></tr></table>",
        "name| price\n---|---\n\na| 1\n\nb",
    ),
    ("<ol></ol><ol><li></li></ol></ol>", ""),
]


def test_nested_structure(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(STRUCTURE)], "page_id int, url string, html string")
    texts = page_markdown(df, repair=False)
    assert [r.markdown for r in texts.orderBy("page_id").collect()] == [m for _, m in STRUCTURE]
    assert "Python" not in texts._jdf.queryExecution().executedPlan().toString()
    kinds = [r.kind for r in page_blocks(df.where("page_id = 0")).orderBy("block_no").collect()]
    assert kinds == ["item"] * 5 + ["text"]


NAV = """<nav class="menu"><a href="/menu">m</a></nav>
<!-- <nav class="woocommerce-pagination"><a href="/commented">c</a></nav> -->
<nav id=p class='woocommerce-pagination  wide'><a class="x" href="?page=2">2</a><a name="no">n</a>
<a href='../up?a=1&amp;b=2'>u</a><a data-href="/d">d</a><A HREF=/bare>b</A><a href="?page=2">again</a>
<!-- <a href="/hidden">h</a> --><a href="">self</a></nav><nav class="woocommerce-pagination"><a href="/late">l</a></nav>"""


def test_links_of_the_first_nav_with_the_class(spark):
    df = spark.createDataFrame(
        [(1, "http://s.org/a/b/c", NAV), (2, "http://s.org/", '<nav class="woocommerce-paginations"><a href="/x">x</a></nav>')],
        "page_id bigint, url string, html string",
    )
    got = [(r.page_id, r.pos, r.dst_url) for r in page_links(df).orderBy("page_id", "pos").collect()]
    assert got == [
        (1, 0, "http://s.org/a/b/c?page=2"),
        (1, 1, "http://s.org/a/up?a=1&b=2"),
        (1, 2, "http://s.org/bare"),
        (1, 3, "http://s.org/a/b/c"),
    ]
    assert [r.dst_url for r in page_links(df, None).orderBy("page_id").collect()] == ["http://s.org/menu", "http://s.org/x"]
