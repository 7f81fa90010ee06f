"""Pages and feeds by the selectors of their source's profile."""

import datetime

import pytest
from pyspark.sql import functions as F

from tanik.functions.ids import utf16_slice
from tanik.plans import crawl
from tanik.sources import dom, html

PAGE = """<!doctype html><html><head><title>Own</title><link rel="canonical" href="/news/1#x"><meta property="og:title" content="Graph"></head><body>
<header><h1>Site</h1></header><div class="story big" id="main"><h2 class="head"> A  title <i>here</i></h2><span class="when">12 Ocak 2024 10:30</span>
<p>First \U0001f600 paragraph of a story that is long enough.<p>Second one, <b>bold<p>Third</b> one.</p><div aria-hidden="true"><p>hidden</p></div><script>"<p>no</p>"</script>
<ul><li>one<li>two <a href="files/a.pdf#p">file</a></ul><section>loose text<table><tr><th>k<td rowspan=2>v</table></section></div>
<a class="more" href="?page=2">next</a></body></html>"""
PROFILE = "source_id string, title string, article string, body_selector string, publication string, listing string, next string, pattern string, hosts array<string>, most int, attachments string, leading_date string"


def profiles(spark, **settings):
    names = [f.split()[0] for f in PROFILE.split(", ")]
    return spark.createDataFrame([tuple({"source_id": "s", **settings}.get(n) for n in names)], PROFILE)


def pages(spark, *bodies, url="https://x.gov.tr/news/one?q=1"):
    rows = [(n, "s", url, body, datetime.datetime(2024, 1, 2)) for n, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, source_id string, url string, body string, checked_at timestamp").withColumn("title", F.lit("own column"))


@pytest.mark.parametrize(
    "selector, found",
    [("div.story > p", 3), (".big#main li", 2), ("li + li, h2", 2), ("h2 ~ p", 3), ("[href$='.pdf#p']", 1), ("a[class~=more]", 1), ("p:nth-child(3)", 1), ("div p:not([hidden]):first-child", 1), ("*[rowspan]", 1), ("td, th", 2), ("body h2.none", 0)],
)
def test_selectors(selector, found):
    assert len(list(dom.select(dom.parsed(PAGE), selector))) == found


def test_wrong_selectors_are_errors():
    for wrong in ("", "a >", "p:hover", "a[", "> a", "a,,b"):
        with pytest.raises(ValueError):
            dom.compiled(wrong)


def test_deep_and_broken_pages():
    tree = dom.parsed("<div>" * 5000 + "x" + "</b></p>" + "<li>y")
    assert tree.text() == "xy" and sum(1 for _ in tree.descendants()) == 5001
    assert dom.parsed(None).text() == "" and dom.parsed("<![CDATA[a<b]]>", xml=True).text() == "a<b"


def test_blocks(spark):
    found = html.parse_blocks(pages(spark, PAGE, "<h2 class=head>t</h2><div class=story>short</div>", None), profiles(spark, title="h2.head", body_selector=".story", publication=".when")).orderBy("page_id")
    place = F.transform("blocks", lambda b: utf16_slice(F.col("raw_text"), b["start"], b["end"]) == b["text"])
    one, short, none = found.withColumn("placed", place).collect()
    assert [(b.kind, b.text) for b in one.blocks] == [("heading", "A title here"), ("paragraph", "12 Ocak 2024 10:30"), ("paragraph", "First \U0001f600 paragraph of a story that is long enough."), ("paragraph", "Second one, bold"), ("paragraph", "Third one."), ("list_item", "one"), ("list_item", "two file"), ("paragraph", "loose text"), ("table_row", "k | v")]
    assert all(one.placed) and one.raw_text == "\n".join(b.text for b in one.blocks) and {b.heading for b in one.blocks} == {"A title here"}
    assert one.blocks[3].selector == ".story > p:nth-child(4)" and one.warnings == ["complex_table_requires_review"]
    assert [tuple(a) for a in one.attachments] == [("https://x.gov.tr/news/files/a.pdf#p", "application/pdf", "a.pdf")] and [a.text for a in one.official_links] == ["file"]
    assert one.published_at == datetime.datetime(2024, 1, 12, 7, 30) and one.publication_date == "12 Ocak 2024 10:30"
    assert (short.problem, short.raw_text, short.blocks, none.problem) == ("parser_drift", None, [], "parser_drift")
    dated = pages(spark, "<h1>t</h1><body><div>DUYURU (3 Mart 2024) and then some more text that follows it</div></body>")
    assert html.parse_blocks(dated, profiles(spark, leading_date=r"DUYURU\s*\(([^)]+)\)")).first().published_at == datetime.datetime(2024, 3, 2, 21, 0)


def test_articles(spark):
    body = PAGE.replace("</head>", '<meta property="article:modified_time" content="2024-02-03T04:05:06Z"></head>')
    rows = pages(spark, body, body.replace("</body>", '<script>{"isAccessibleForFree": "False"}</script></body>'), body.replace('"/news/1#x"', '"https://other.org/a"'), "<h2 class=head>t</h2>", "<h2 class=head>t</h2><div class=story>" + "plain text without any paragraph " * 40 + "</div>")
    found = html.parse_articles(rows.withColumn("url", F.concat("url", "page_id")), profiles=profiles(spark, title="h2.head", article="div.story", publication=".when", hosts=["x.gov.tr"], most=900)).orderBy("url").collect()
    assert [r.problem for r in found] == [None, "source_access_control", "source_url_restricted", "article_parser_drift", "article_text_limit"]
    assert found[0].canonical_url == "https://x.gov.tr/news/1" and found[0].title == "A title here" and found[0].text == "First \U0001f600 paragraph of a story that is long enough.\nSecond one, bold\nThird one."
    assert found[0].published_at == datetime.datetime(2024, 1, 12, 7, 30) and found[0].modified_at == datetime.datetime(2024, 2, 3, 4, 5, 6)
    plain = html.parse_articles(pages(spark, PAGE)).first()
    assert plain.title == "Site" and plain.problem is None and html.parse_articles(pages(spark).limit(0)).count() == 0


def test_listing(spark):
    page = '<a class=duyuru href="/d/1">a</a><a class="duyuru" href="/d/1">b</a><a href="/d/2">c</a><a class=duyuru href="/e/1">d</a><a class=on href="?p=2">n</a>'
    rows = pages(spark, page)
    found = html.parse_listing(rows, "^/d/", profiles(spark, listing="a.duyuru", next="a.on")).collect()
    assert [(r.url, r.next) for r in found] == [("https://x.gov.tr/d/1", "https://x.gov.tr/news/one?p=2")]
    assert html.parse_listing(rows, "^/d/", profiles(spark, listing="a.none", next="")).first()[1:] == (None, None)
    assert {r.url for r in html.parse_listing(rows, "^/d/").collect()} == {"https://x.gov.tr/d/1", "https://x.gov.tr/d/2"}


def test_listings_of_one_url_stay_apart(spark):
    rows = pages(spark, '<a href="/d/1">a</a><a href="/d/1#x">a</a>', '<a href="/d/1">a</a><a href="/d/2">b</a>', "nothing", "nothing")
    found = [r.url for r in html.parse_listing(rows, "^/d/").collect()]
    assert sorted(found, key=lambda u: u or "") == [None, None, "https://x.gov.tr/d/1", "https://x.gov.tr/d/1", "https://x.gov.tr/d/2"]


def test_feeds_of_allowed_hosts(spark):
    feed = '<rss><channel><link>https://x.gov.tr/</link><item><link>https://x.gov.tr/a</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item><item><link>https://evil.org/a</link></item></channel></rss>'
    rows = spark.createDataFrame([("s", "https://x.gov.tr/feed", "rss", feed), ("s", "https://x.gov.tr/sub", "sitemap", "<sitemapindex><sitemap><loc>/more.xml</loc></sitemap></sitemapindex>"), ("s", "https://x.gov.tr/bad", "atom", "<feed><entry><link href='http://x.gov.tr/b'/></entry></feed>")], "source_id string, url string, kind string, body string")
    found = {(r.feed_url[17:], r.role, r.url) for r in html.parse_feeds(rows, profiles(spark, hosts=["x.gov.tr"])).collect()}
    assert found == {("feed", "item", "https://x.gov.tr/a"), ("sub", "feed", "https://x.gov.tr/more.xml"), ("bad", "parser_drift", None)}


def test_entities_that_are_cut_off(spark, tmp_path):
    body = "<article><h1>a&amp;b &copy; c&amp</h1><p>some text that is long enough to be an article &lt;here&gt; &amp</p></article>"
    spark.createDataFrame([(1, "https://x.org/a", body)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert crawl.a8_parse_articles(spark, tmp_path).first().title == "a&b \u00a9 c&amp"
    found = crawl.a9_parse_blocks(spark, tmp_path).first()
    assert found.title == "a&b \u00a9 c&amp" and "article <here> &amp\nplain bold" in found.raw_text
    assert dom.parsed("<h1>c&amp</h1>").text() == "c&"  # as the HTML standard asks
