import base64
import hashlib

from netgrid.llm.files import opened
from netgrid.llm import html
from netgrid.llm.html import extract_text, main_text
from netgrid.llm.warc import members, parse, read_warc, warc_round_trip, write_warc
from netgrid.plans.storage import fresh_path

PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body class="has-sidebar"><div id="cookieBanner">We use</div>
<header><h1>Site</h1></header><nav><ul><li>a</ul></nav><main><div class="breadcrumbs">x &gt; y</div><article><h1>T &amp; x</h1><p>One<br>two &nbsp; three<p>Four <b>bold</b>!
<ul><li>x<li>y</ul><section id="comments"><p>nice</p></section><form>send</form></article></main><aside>z</aside><div class="ad">buy</div><footer>&copy;</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "T & x\n\nOne two three\n\nFour bold!\n\nx\n\ny"
    assert main_text(None) == main_text("") == main_text("<nav>only</nav>") == ""
    assert main_text("plain a < b") == "plain a < b"
    assert main_text("<p>" + "a " * 100000).count("a") == 100000


def test_site_template(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><div><span>Our shop</span></div><div><p>text {i}</p></div></body>") for i in range(20)]
    rows += [(20, "https://b.example/", "<body><div><span>Our shop</span></div><div><p>other</p></div></body>"), (21, None, None)]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "text 3" and got[3].n_chars == 6
    assert got[20].text == "Our shop\n\nother" and got[21].text == ""
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_of_a_large_host(spark, monkeypatch):
    def page(i):
        notice = f"<div class='zq7'>Offer {i % 40}</div><section>Widget {i % 40}</section>" if i < 400 else ""
        return f"<body>{notice}<div><p>text {i} <b>often</b> and then some more words of its own</p><p>Thanks</p></div></body>"

    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(2000)] + [(2000, "https://a.example/x", "<body><div>Once</div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (200_000, 0):
        monkeypatch.setattr(html, "MOST_SENT", most)
        got = {r.page_id: r.text for r in extract_text(pages).collect()}
        assert len(got) == 2001 and got[2000] == "Once"
        assert all("Offer" not in t and "Widget" not in t for t in got.values())
        assert got[7].startswith("text 7")


def test_equal_pages_are_one(spark):
    own = "<h1>Title</h1><p>All of its own text</p><div>More of it</div>"
    rows = [(i, "https://a.example/", f"<body>{own}</body>") for i in range(12)]
    rows += [(20 + i, "https://a.example/", f"<body><article>{own}</article></body>") for i in range(12)]
    # copies that differ in an advert: the subtree with most of the text stays
    rows += [(40 + i, "https://b.example/", f"<body><div>ad {i}</div><div><p>{'long text ' * 9}</p><p>and more</p></div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == got[23] == "Title\n\nAll of its own text\n\nMore of it"
    assert "long text" in got[45] and "and more" in got[45]


def odd_pages(spark):
    long = "x" * 300_000
    rows = [(1, "http://a/\r\nb", "p" * 1000), (5, "http://e", "p" * 1000), (3, None, "p" * 1000), (2, "u", None), (4, "v", "short"), (6, "w", "short"), (7, "z", long), (8, "y", "é" * 500), (9, "y2", "é" * 500), (9, "y2", "é" * 500)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, sha1 string, shard int")


def test_warc(spark):
    got, manifest = warc_round_trip(odd_pages(spark), shard_bytes=2000.0, roll_bytes=200)
    rows = {(r.page_id, r.record_type, r.refers_to) for r in got.collect()}
    assert {(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (8, "revisit", 9), (9, "response", None), (4, "response", None), (6, "response", None), (2, "response", None)} <= rows
    for r in got.collect():
        html = next(x for i, _, x in [(q.page_id, q.url, q.html) for q in odd_pages(spark).collect()] if i == r.page_id) or ""
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest() and r.payload_bytes == len(html.encode())
    assert manifest.count() > 1
    for m in manifest.collect():
        with opened(m.uri) as f:
            heads = [parse(x)[0] for x in members(f)]
        assert heads[0]["warc-type"] == "warcinfo" and len(heads) == m.records + 1
        assert all(len(base64.b32decode(h["warc-payload-digest"][5:])) == 20 for h in heads[1:])


def test_warc_is_deterministic(spark):
    def whole():
        m = write_warc(odd_pages(spark), fresh_path(spark, "warc"), shard_bytes=2000.0)
        return [opened(r.uri).read() for r in m.orderBy("uri").collect()]

    assert whole() == whole()
    assert read_warc(write_warc(odd_pages(spark).limit(0), fresh_path(spark, "warc"))).count() == 0


def test_sibling_articles_and_names():
    page = "<body><nav>menu</nav><article><h2>One</h2><p>first part</p></article><article><h2>Two</h2><p>second part</p></article><div class='related-posts'>more</div></body>"
    assert main_text(page) == "One\n\nfirst part\n\nTwo\n\nsecond part"
    inner = "<article><p>intro</p><section class='related-work'><p>others did so</p></section><section id='legalHistory'><p>in court</p></section><div class='alert'>cookies</div><div class='search box'>find</div></article>"
    assert main_text(inner) == "intro\n\nothers did so\n\nin court"
    assert main_text("<main><p>a b</p></main><p>outside</p><div role='main'>c</div>") == "a b\n\nc"
    assert main_text("<main><p>long enough text of the page</p><article>x</article></main>") == "long enough text of the page\n\nx"


def test_pages_with_odd_columns_and_repeats(spark):
    page = "<article><p>words of one</p></article><div>shared words here</div>"
    rows = [(i, f"http://h.example/{i}", page.replace("one", f"page {i}"), "x", 1) for i in range(40)] + [(3, "http://h.example/3", page.replace("one", "page 3"), "x", 1)] * 30
    rows += [(100, None, None, "x", 1), (101, "not a url", "", "x", 1), (None, "http://h.example/n", "<p>free</p>", "x", 1)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, h int")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "words of page 3" and text[39] == "words of page 39" and text[100] == text[101] == "" and text[None] == "free"
    assert all(r.n_chars == len(r.text) for r in got)
