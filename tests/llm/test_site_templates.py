import re
from html import unescape
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from quillvec.llm import site_templates as s

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Title &amp; x</h1></header>
<p>One <b>two</b>&nbsp;three<br>four<p>Five a &lt; b <ul><li>x<li>y</ul><div class="share-box">Share</div>
<table><tr><td>c1<td>c2</table><aside>side</aside>tail <!-- c --> text<form><input>go</form></article>
<section id="comments"><article class="comment">nice</article></section></main><footer>f</footer>
<script>var a="</p>"</script></body>"""


def text(html):
    """What names and the article alone leave of a page."""
    page = s.parse(html)
    stays = s.kept(len(page.blocks), s.without_counts(page)[0], [], [])
    return [b for b, stay in zip(page.blocks, stays) if stay]


def test_article_without_boilerplate():
    assert text(PAGE) == ["Title & x", "One two three four", "Five a < b", "x", "y", "c1", "c2", "tail text"]


def test_odd_markup():
    assert text("") == []
    assert text("plain  text\n only") == ["plain text only"]
    assert text("<p>unclosed <b>x") == ["unclosed x"]
    assert text("<p><b>one<br><p>two</b> three") == ["one", "two three"]
    assert text("<div>a</div><div>b") == ["a", "b"]
    assert text("</p></div>x<") == ["x<"]
    assert text("a < b and c > d") == ["a < b and c > d"]
    assert text("<article></article>rest") == []
    assert text("<a href=\"x>y\">l</a>") == ["l"]
    assert text("<p title='a>b'>q") == ["q"]
    assert text("<script>x") == [] and text("<!-- open") == []
    assert text("<P>UP</P><BR>&#65;&eacute;&amp;lt;") == ["UP", "Aé&lt;"]
    assert len(text("<p>x y</p>" * 20_000)) == 20_000
    assert len(text("<div>" * 3000 + "deep")) == 1


def test_names_that_only_begin_like_an_advert_stay():
    for name in ("ad-hoc-report", "comment-on-law", "notice-of-intent", "related-work", "share-price", "news-banner",
                 "menu-engineering", "widget-theory", "reply-all", "post-respond"):
        assert text(f'<div class="{name}"><p>Real article text.</p></div>') == ["Real article text."]
    for name in ("ad", "ads-box", "comment-list", "cookie_notice", "share-buttons", "sidebar2 x"):
        assert text(f'<div class="{name}"><p>Gone.</p></div><p>y</p>') == ["y"]


def test_main_beside_an_article_stays():
    teaser = '<main><h1>T</h1><p>Long body one.</p><p>Long body two.</p><article class="teaser">See also</article></main>'
    assert text(teaser) == ["T", "Long body one.", "Long body two.", "See also"]
    assert text("<div><p>A body that is long</p></div><article>See</article>") == ["A body that is long", "See"]


def test_templates_are_deleted_by_host(spark):
    def page(i, extra=""):
        return f"<body><div class='x1'>Join our club today</div><p>Unique text {i}</p><div><p>Always said</p></div>{extra}</body>"

    rows = [(i, f"http://h.example/{i}", page(i), "host") for i in range(8)]
    rows += [(20 + i, f"http://other.example/{i}", page(7 * i), "host") for i in range(3)]
    # Copies of one page on a host of their own are no template.
    rows += [(40 + i, f"http://copies.example/{i}", page(1), "host") for i in range(9)]
    rows += [(99, None, None, None), (100, "http://h.example/c", "", "x"), (None, "http://[bad", "<p>z</p>", "x"), rows[3]]
    # An article's paragraph that many articles have stays.
    rows += [(200 + i, f"http://a.example/{i}", f"<article><p>Said by all</p><p>own {i}</p></article>", "x") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    found = sorted((repr(r["page_id"]), r["text"], r["n_chars"]) for r in s.main_text(pages).collect())
    whole = "Join our club today\nUnique text {}\nAlways said"
    expected = [(i, f"Unique text {i}") for i in [*range(8), 3]] + [(20 + i, whole.format(7 * i)) for i in range(3)]
    expected += [(40 + i, whole.format(1)) for i in range(9)] + [(99, ""), (100, ""), (None, "z")]
    expected += [(200 + i, f"Said by all\nown {i}") for i in range(8)]
    assert found == sorted((repr(i), t, len(t)) for i, t in expected)
    assert s.main_text(pages.limit(0)).count() == 0


def test_templates_of_sections_and_bare_notices_are_deleted(spark):
    """Four designs of a host, each on a quarter of its pages, and a bare paragraph on all of them."""
    def page(i):
        design = f"<div><div>Menu {i % 4}</div><ul><li>Entry {i % 4}</li></ul></div>"
        return f"<body>{design}<div><p>Own text {i}</p><p>Said twice {i // 2}</p></div><p>Notice to all</p><table><tr><td>Cell {i}</table></body>"

    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(40)]
    # Inside an article the share of the pages counts as before.
    inside = "<article><div>Box {}</div><p>Quote {}</p><p>own {}</p></article>"
    rows += [(100 + i, f"http://articles.example/{i}", inside.format(i % 4, i % 4, i)) for i in range(40)]
    rows += [(200 + i, f"http://one.example/{i}", inside.format(0, 0, i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in s.main_text(pages).collect()}
    assert found == (
        {i: f"Own text {i}\nSaid twice {i // 2}\nCell {i}" for i in range(40)}
        | {100 + i: f"Box {i % 4}\nQuote {i % 4}\nown {i}" for i in range(40)}
        | {200 + i: f"Quote 0\nown {i}" for i in range(40)}
    )


def test_places_are_counted(spark):
    """On given pages whose words all differ, the counts take the adverts away, and without counts they stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in pages.collect()}
    whole = {r["page_id"]: r["text"] for r in s.main_text(pages).collect()}
    blind = {r["page_id"]: r["text"] for r in s.main_text(pages, least_pages=10**9).collect()}
    unnamed = pages.withColumn("html", F.replace("html", F.lit('class="ad"'), F.lit('class="x7"')))
    assert {r["page_id"]: r["text"] for r in s.main_text(unnamed).collect()} == whole
    # The counting written out: places of five different pages of a host.
    different = {}
    for r in rows.values():
        different.setdefault(urlsplit(r["url"]).hostname, set()).add(whole[r["page_id"]])
    known = [i for i, r in rows.items() if len(different[urlsplit(r["url"]).hostname]) >= 5]
    assert len(known) > len(rows) / 2
    for i, r in rows.items():
        advert = " ".join(unescape(re.search('(?s)<div class="ad">(.*?)</div>', r["html"])[1]).split())
        assert blind[i] == (f"{advert}\n{whole[i]}" if i in set(known) else whole[i])


def test_a_place_with_much_text_is_no_template(spark):
    def page(i):
        long = f"A report that goes on and on about the matter {i} " * 5
        links = "".join(f"<li><a href='/{k}'>link {k * i}</a></li>" for k in range(5))
        return f"<body><div class='promo'><p>{long}</p></div><div class='z'><p>Buy {i}</p></div><div><ul>{links}</ul></div><article><p>{long}own {i}</p></article></body>"

    rows = [(i, f"http://n.example/{i}", page(i)) for i in range(6)] + [(9, "http://few.example/", page(9))]
    found = {r["page_id"]: r["text"] for r in s.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        long = (f"A report that goes on and on about the matter {i} " * 5).strip()
        assert found[i] == f"{long}\n{long} own {i}"
    assert found[9] == ("A report that goes on and on about the matter 9 " * 5).strip() + " own 9"
