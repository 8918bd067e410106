"""Column functions against stated results and, where there is one, a standard-library model."""

import urllib.robotparser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from crawlframe.functions import html as H
from crawlframe.functions import jsondoc as J
from crawlframe.functions import robots as R
from crawlframe.functions import text as X
from crawlframe.functions import urls as U

URLS = [
    ("https://e.com", "https://e.com"), ("https://e.com/", "https://e.com/"), ("http://h:8080//", "http://h:8080"),
    ("example.com/a/", "http://example.com/a"), ("localhost:8080/x", "http://localhost:8080/x"),
    ("//cdn.x.com/a", "http://cdn.x.com/a"), ("/rel", "http:///rel"), ("", "http://"),
    ("http://h/a;p=1?z=~*", "http://h/a?z=~%2A"), ("http://h:80/?q=a%20b&q=a+a&e", "http://h/?e=&q=a+a&q=a+b"),
    ("http://h/p?a=1;b=2&&c", "http://h/p?a=1%3Bb%3D2&c="), ("http://h/p?b=%zz", "http://h/p?b=%25zz"),
    ("HTTPS://U@H.com:443/A?b=%41%zz#f", "https://u@h.com/A?b=A%25zz"), ("http://[::1]:80/x", "http://[::1]/x"),
    ("  http://h/a b  ", "http://h/a b"),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_normalize(spark):
    df = spark.createDataFrame(URLS, "u string, want string").select(
        "u", "want", U.normalize_url("u").alias("got"), U.normalize_url(U.normalize_url(F.col("u"))).alias("twice"))
    for u, want, got, twice in rows(df):
        assert got == want, u
        assert twice == want or "///" in want, u


def test_resolve_like_standard_library(spark):
    bases = ["http://a/b/c/d;p?q", "https://e.com", "https://e.com/x/"]
    hrefs = ("g:h g ./g g/ /g //g ?y g?y #s g#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g "
             "/./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y http:g a//b //h2 http://z/a/../b "
             "/a//b/../c").split() + [""]
    cases = [(b, h, urljoin(b, h)) for b in bases for h in hrefs]
    df = spark.createDataFrame(cases, "b string, h string, want string")
    df = df.select("b", "h", U.normalize_url("want").alias("want"), U.normalize_url(U.resolve_url(F.col("b"), F.col("h"))).alias("got"))
    assert [r for r in rows(df) if r[2] != r[3]] == []


def test_domains(spark):
    df = spark.createDataFrame([("https://user:pw@www.example.com:8080/path",), ("https://notexample.com/",)], "u string")
    host = U.domain_of(F.col("u"))
    allowed = F.array(F.lit("example.com"))
    assert rows(df.select(host, U.domain_allowed(host, allowed), U.host_suffixes(host))) == [
        ("www.example.com", True, ["www.example.com", "example.com", "com"]),
        ("notexample.com", False, ["notexample.com", "com"]),
    ]


PAGE = """<!DOCTYPE html><html lang='en'><head><title> A &amp; B &#233;&#x4e2d; </title>
<meta name=Description content="  d1 &lt;x&gt; "><meta property="og:title" content="og1"><meta property="og:title" content="og2">
<meta name="k" content="v1"><meta name="k" content="v2"><meta name="og:title" content="plain"><meta name="empty" content="">
<link rel="nofollow next" href="/p?page=3"><link rel='prev' href='?page=1'>
<script type="application/ld+json">{"@type":"Article","x":[1]}</script>
<script type="application/ld+json">[{"@type":["A","B"]},{"@type":"Article"},5]</script>
<script type="application/ld+json">{bad</script><!-- <script type="application/ld+json">{"@type":"No"}</script> -->
</head><body class="x infinite-scroll"><noscript>hid <a href="/ns">ns</a></noscript><a href="/a#f" title="x > y href=q">one</a> text
<b>bold</b>text&nbsp;<a href=/b>2</a><a href='mailto:x'>m</a><a href="/a">10</a><a href="//o.com/z?b=1&amp;a=2"> <i>3</i> </a>
<a name=x>7</a> 5 < 6 &unknown; &amp;lt; &#38;amp;<script>var a="<a href='/s'>"</script></body></html>"""


def test_page_fields(spark):
    m, base = F.col("m"), F.col("url")
    df = spark.createDataFrame([(PAGE, "https://e.com/dir/page")], "html string, url string").withColumn("m", H.visible_markup(F.col("html")))
    meta = H.meta_records(m)
    ld = H.json_ld(F.col("html"))
    got = df.select(
        H.title(m).alias("title"), H.language(m).alias("lang"), H.description(meta).alias("description"), H.open_graph(meta).alias("og"),
        H.meta_tags(meta).alias("tags"), H.flat_metadata(H.open_graph(meta), H.meta_tags(meta)).alias("flat"), F.size(ld).alias("ld"),
        H.schema_types(ld).alias("types"), H.page_links(m, base).alias("links"), H.rel_links(m, base).alias("rel"),
        H.page_numbers(m).alias("numbers"), H.infinite_scroll(m).alias("scroll"), H.snippet(m).alias("snippet"),
    ).first().asDict()
    assert got == {
        "title": "A & B é中", "lang": "en", "description": "d1 <x>", "og": {"og:title": "og2"},
        "tags": {"Description": "d1 <x>", "k": "v2", "og:title": "plain"},
        "flat": {"Description": "d1 <x>", "k": "v2", "og:title": "plain"}, "ld": 3, "types": ["Article", "A", "B"],
        "links": ["https://e.com/ns", "https://e.com/a", "https://e.com/b", "https://o.com/z?a=2&b=1"],
        "rel": ["https://e.com/p?page=3", "https://e.com/dir/page?page=1"], "numbers": ["2", "3", "10"], "scroll": True,
        "snippet": "A & B é中 one text bold text 2 m 10 3 7 5 < 6 &unknown; &lt; &amp;",
    }


def test_references_and_open_markup(spark):
    text = "&copy 2024 &Scaron;&alpha;&rsaquo; &#150;&#x41 &#0; &#xD800; &#99999999999; &notit; &nope; &amp;lt; &amp &"
    pages = [(f"<p title='{t}'>{t}</p>",) for t in (text, "a &copy=1 b")]
    pages += [("x <script>var a=1; lost?",), ("y <style>p {",), ("z <!-- open",), ("<a title=\"a'b>7",),
              ("".join(f"<a href=x>{n}</a>" for n in ("99999999999999999999", "7", "007", "0", "12")),)]
    m = H.visible_markup(F.col("html"))
    df = spark.createDataFrame(pages, "html string")
    got = [r[0] for r in df.select(H.text_content(m)).collect()]
    want = "© 2024 Šα› –A \ufffd \ufffd \ufffd ¬it; &nope; &lt; & &"
    assert got[:6] == [want, "a ©=1 b", "x", "y", "z", "7"]
    title = H.attribute(H.attributes(F.get(H.tags(m, "p"), F.lit(0))), "title")
    assert [r[0] for r in df.select(title).collect()][:2] == [want.replace("¬it;", "&notit;"), "a &copy=1 b"]
    assert df.select(H.page_numbers(m)).collect()[6][0] == ["0", "7", "12", "99999999999999999999"]


def test_empty_fields(spark):
    pages = [("<html><title></title><meta name='description' content=''><meta property='og:description' content=' o '></html>",), ("plain",), ("",)]
    m = F.col("m")
    df = spark.createDataFrame(pages, "html string").withColumn("m", H.visible_markup(F.col("html")))
    got = rows(df.select(H.title(m), H.description(H.meta_records(m)), H.language(m), H.snippet(m), H.infinite_scroll(m)))
    assert got == [("", "o", None, None, False), (None, None, None, "plain", False), (None, None, None, None, False)]


def test_json_documents(spark):
    docs = [
        ('{"title":"T","description":5,"url":"http://a","next":"https://n","items":[],"results":[{"url":"http://r1"},{"href":"ftp://x","link":"http://a"},3]}',),
        ('[{"url":"http://l"},{"name":"x"}]',), ('{"name":"N","title":7,"description":"D"}',), ("{bad",), ("{}",),
    ]
    v = F.col("v")
    df = spark.createDataFrame(docs, "b string").withColumn("v", F.try_parse_json("b"))
    got = rows(df.select(J.document_title(v), J.document_description(v), J.document_links(v), J.document_snippet(F.col("b")).isNull()))
    assert got == [
        ("T", None, ["http://a", "https://n", "http://r1"], False), (None, None, ["http://l"], False), ("N", "D", [], False),
        (None, None, [], False), (None, None, [], True),
    ]


def test_robots_like_standard_library(spark):
    texts = [
        "User-agent: *\nDisallow: /private\n", "",
        "User-agent: a\nUser-agent: craw\nAllow: /x/y\nDisallow: /x\n# c\nDisallow: /z z?q\n\nUser-agent: *\nDisallow: /",
        "User-agent: other\nDisallow: /\n\n\nUser-Agent: *\nCrawl-delay: 3\nDisallow:\n",
        "User-agent: *\nDisallow: /%7Ejoe/\nAllow: /\nUser-agent: crawlframe\nDisallow: /q?a=b*",
        "Disallow: /lost\nUser-agent: crawlframe\n\nDisallow: /alone\nUser-agent: *\nDisallow: /x # note\r\nAllow: /",
    ]
    urls = ["http://h/private/1", "http://h/public", "http://h", "http://h/x/y/1", "http://h/x/q", "http://h/z%20z?q=1",
            "http://h/~joe/a", "http://h/q?a=b%2A1", "http://h/lost"]
    cases = []
    for t in texts:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(t.splitlines())
        cases += [(t, u, parser.can_fetch("crawlframe/1.0", u)) for u in urls]
    verdict = R.allowed_by(R.rules_for(F.col("t"), "crawlframe/1.0"), R.request_target(F.col("u")))
    df = spark.createDataFrame(cases, "t string, u string, want boolean").withColumn("got", verdict)
    assert [r for r in rows(df) if r[2] != r[3]] == []


def test_trigrams_and_text(spark):
    df = spark.createDataFrame([("Hello, wörld!  x", "word"), ("", "?!"), ("abc", "ABC")], "a string, b string")
    a, b = X.trigrams(F.col("a")), X.trigrams(F.col("b"))
    got = rows(df.select(F.size(a), X.similarity(a, b), X.similarity(b, a)))
    assert [g[0] for g in got] == [14, 0, 4]
    assert all(x == y and 0 <= x <= 1 for _, x, y in got)
    assert got[1][1] == 0.0 and got[2][1] == 1.0
    clean = spark.range(1).select(X.collapse(F.lit(" a   b c "), 4), X.collapse(F.lit(" \n "), 9))
    assert rows(clean) == [("a b ", None)]


def test_trace(spark):
    ids = [("0123456789abcdef-01",), ("short",), ("0123456789abcdeg",), (None,)]
    t = X.trace_context(F.col("t"))
    got = rows(spark.createDataFrame(ids, "t string").select(t["trace"], t["span"]))
    assert got == [("0123456789abcdef0100000000000000", "0100000000000000"), (None, None), (None, None), (None, None)]
