"""Column functions and readers on small fixtures of our own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from digestflow.functions import dates, text, urls
from digestflow.operators import ingest
from digestflow.sources import feeds, pages


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_canonicalize_url(spark):
    given = {
        "HTTPS://Shop.Sample.TEST:443/goods//7/?utm_medium=mail&size=xl&colour=r%C3%A9d#more": "https://shop.sample.test/goods/7?colour=r%C3%A9d&size=xl", "http://SAMPLE.test:80/one/./two/../three/?q=&yclid=9": "http://sample.test/one/three?q=",
        "http://a.b": "http://a.b/", "http://a.b:8080/../x": "http://a.b:8080/x", "http://[::1]/a": "http://[::1]/a", "ftp://a/b": None, "http://u:p@a/b": None, "/x": None, "http://a:99999/": None,
    }
    assert column(spark, [*given, None], urls.canonicalize_url) == [*given.values(), None]


def test_locators(spark):
    given = ["@Some_Channel", "https://t.me/s/SomeChan/12", "https://www.telegram.me/SomeChan", "@bad", "https://x.test/feed.rss", "https://x.test/feeds/1", "https://x.test/a", "x"]
    assert column(spark, given, urls.normalize_locator) == ["@some_channel", "@somechan", "@somechan", None, "https://x.test/feed.rss", "https://x.test/feeds/1", "https://x.test/a", None]
    assert column(spark, given, urls.infer_collector) == ["web_preview"] * 3 + [None, "native_rss", "native_rss", "universal_scraper", None]
    assert column(spark, ["https://www.x.test/a", "https://t.me/s/Chan/1", "https://t.me/", "plain"], urls.link_label) == ["x.test", "t.me/Chan", "t.me", "plain"]


def test_absolute_url(spark):
    given = ["/a//b/?q=1#x", "HTTP://Y.test", "c d", "", "mailto:x@y"]
    got = column(spark, given, lambda v: urls.absolute_url(F.lit("https://X.test/dir/page"), v))
    assert got == ["https://x.test/a/b/?q=1", "http://y.test/", "https://x.test/dir/c d", "https://x.test/dir/page", "mailto:x@y"]


def test_texts(spark):
    assert column(spark, ["  A  b\n\n c ", " ", None, "ﬁ"], text.display_text) == ["A b\n\nc", None, None, "fi"]
    assert column(spark, ["Straße  X", None], text.canonical_text) == ["strasse x", None]
    assert column(spark, ["\n  first \nsecond", "", None, "x" * 300], text.first_line) == ["first", None, None, "x" * 239 + "…"]
    assert column(spark, [" abcdef "], lambda v: text.truncated(v, 4)) == ["abc…"]
    assert column(spark, ["A b", None], lambda v: text.join_distinct(F.array(v, F.lit("a  B"), F.lit("c"), F.lit(" ")))) == ["A b\n\nc", "a  B\n\nc"]
    assert column(spark, ["b"], lambda v: text.cluster_id(F.array(v, F.lit("a")))) == column(spark, ["a"], lambda v: text.cluster_id(F.array(v, F.lit("b"))))


def test_metadata(spark):
    df = spark.createDataFrame([({"a": "1"}, (2, ["x"])), ({}, None)], "m map<string,string>, e struct<n:int,errors:array<string>>")
    got = [r[0] for r in df.select(text.merge_metadata(F.col("m"), F.col("e"))).collect()]
    assert got == ['{"a":"1","extraction":{"errors":["x"],"n":2}}', "{}"]


def test_dates(spark):
    given = {
        "2026-09-02 01:00": (9, 1, 22, 0), "2026-09-02T01:00:00+03:00": (9, 1, 22, 0), "2026-09-02T01:00:00Z": (9, 2, 1, 0), "Wed, 02 Sep 2026 10:00:00 +0300": (9, 2, 7, 0),
        "02 Sep 2026 10:00:00 GMT": (9, 2, 10, 0), "опубликовано 2 сентября 2026 01:00": (9, 1, 22, 0), "2 сентября 2026": (9, 1, 21, 0), "2 smarch 2026": None, "": None, "02/09/2026": (9, 1, 21, 0),
    }
    got = column(spark, [*given, None], lambda v: dates.parse_datetime(v, ("dd/MM/yyyy",)))
    assert [None if t is None else (t.month, t.day, t.hour, t.minute) for t in got] == [*given.values(), None]


def test_sizes(spark):
    assert column(spark, ["2.5 MB", "1,5 КБ", "12 B", "big", None, "3 Mbit"], pages.size_to_bytes) == [2621440, 1536, 12, None, None, None]


PAGE = """<html><head><title>t</title><meta property="og:title" content="Shared"><meta property="article:published_time" content="2026-01-02T03:04:05Z">
<script type="application/ld+json">[{"@graph": [{"datePublished": "2025-05-05"}]}, {"datePublished": "2025-06-06"}, 3]</script><script>var a = "<p>no</p>";</script></head>
<body><nav><a href="/n">Nav</a></nav><main><h1>Head <b>line</b></h1><p>Text &amp; more<br>line</p><a href="/a?x=1#f">A</a><a href="/a?x=1">A long title</a><a href="mailto:x">m</a></main><footer>f</footer></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://x.test/list", PAGE), (2, "https://x.test/2", None), (3, "https://x.test/3", "<h1> </h1><p>only")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.clean_pages(df).collect()}
    assert got[1].text == "t\nHead\nline\nText & more\nline\nA\nA long title\nm" and got[1].title == "Head line"
    assert got[1].dates == ["2026-01-02T03:04:05Z", "2025-06-06", "2025-05-05"] and got[2].text is None and got[3].text == "only"
    links = {(r.url, r.title, r.pos) for r in pages.discover_links(df, include="x.test", exclude="/n$").collect()}
    assert links == {("https://x.test/a?x=1", "A long title", 1)}
    found = spark.createDataFrame([("s", "https://x.test/list", "Listed", 0), ("s", "https://x.test/3", "Three", 1), ("s", "https://x.test/none", None, 2)], "source_id string, url string, title string, pos int")
    items, errors = pages.pages_to_raw_items(found, df)
    assert [(r.original_url, r.title, r.published_at) for r in items.collect()] == [("https://x.test/list", "Head line", dt.datetime(2026, 1, 2, 3, 4, 5))]
    assert {(r.code, r.retryable) for r in errors.collect()} == {("article_date_missing", False), ("article_missing", True)}
    # the last fetched page of a URL, places by date, the listing page
    page = lambda d: f'<h1>{d}</h1><time datetime="{d}T00:00:00Z">x</time>'
    landed = spark.createDataFrame([("https://x.test/a", page("2026-03-03"), 1), ("https://x.test/a", page("2026-02-02"), 2), ("https://x.test/b", page("2026-01-01"), 1)], "url string, html string, t int")
    found = spark.createDataFrame([("s", "https://x.test/a", None, 0, "https://x.test/list"), ("s", "https://x.test/b", None, 1, "https://x.test/list")], "source_id string, url string, title string, pos int, listing_url string")
    items, _ = pages.pages_to_raw_items(found, landed.withColumn("fetched_at", F.timestamp_seconds("t")))
    assert sorted((r.batch_pos, r.title) for r in items.collect()) == [(1, "2026-01-01"), (2, "2026-02-02")]
    assert {r.metadata for r in items.collect()} == {'{"collector":"universal_scraper","listing_url":"https://x.test/list"}'}


CARDS = """<div class="w" data-post="chan/7"><div class="tgme_widget_message_text">Hello<br>world</div><a class="tgme_widget_message_document_wrap"><div class="tgme_widget_message_document_title">a.pdf</div>
<div class="tgme_widget_message_document_extra">2.5 MB</div></a><a class="tgme_widget_message_date" href="https://t.me/chan/7"><time datetime="2026-01-02T03:04:05+00:00">x</time></a></div>
<div data-post="chan/x"><time datetime="2026-01-02T03:04:05+00:00"></time></div><div data-post="chan/8"><time datetime="2026-01-03T00:00:00+03:00"></time></div>"""


def test_message_cards(spark):
    items, errors = pages.explode_message_cards(spark.createDataFrame([("s", CARDS), ("e", "<p>x</p>")], "source_id string, html string"))
    got = {r.external_id: r for r in items.collect()}
    assert set(got) == {"7", "8"} and got["7"].raw_text == "Hello\nworld" and got["7"].title == "Hello" and got["8"].original_url == "https://t.me/chan/8"
    assert [(a.name, a.size) for a in got["7"].attachments] == [("a.pdf", 2621440)] and got["8"].published_at == dt.datetime(2026, 1, 2, 21)
    assert {(r.source_id, r.code) for r in errors.collect()} == {("s", "card_invalid"), ("e", "preview_layout_changed")}
    assert got["7"].raw_html == '<div class="tgme_widget_message_text">Hello<br>world</div>' and got["7"].attachments[0].mime_type == "application/pdf" and got["8"].raw_html is None
    assert got["7"].metadata == '{"collector":"web_preview","telegram_post":"chan/7"}' and (got["7"].batch_pos, got["8"].batch_pos) == (1, 2)
    # older cards after newer ones, equal dates by number; a text that nothing closes
    card = lambda n, day, text: f'<div data-post="chan/{n}"><time datetime="2026-01-{day:02}T00:00:00Z"></time>\n{text}</div>'
    body = '<p class="tgme_widget_message_text">a'
    shuffled = "".join([card(10, 2, ""), card(9, 2, ""), card(30, 1, body), card(2, 5, "")])
    rows = {r.external_id: r for r in pages.explode_message_cards(spark.createDataFrame([("s", shuffled)], "source_id string, html string"))[0].collect()}
    assert sorted(rows, key=lambda k: rows[k].batch_pos) == ["30", "9", "10", "2"] and rows["30"].raw_html == body


def test_messages(spark):
    ddl = "source_id string, handle string, message_id long, date timestamp, message string, views long, forwards long, grouped_id long, file struct<name:string,mime_type:string,size:long,ref:string>"
    when = dt.datetime(2026, 1, 1)
    rows = pages.messages_to_raw_items(spark.createDataFrame([("s", "chan", 5, when, " Hi\nthere ", 1, None, None, (None, "application/pdf", 9, "/tmp/x")), ("s", "chan", 6, when, None, 1, 2, 3, None)], ddl))
    got = {r.external_id: r for r in rows.collect()}
    assert got["5"].title == "Hi" and got["5"].attachments[0].name == "document.pdf" and got["6"].attachments == [] and got["6"].raw_text is None and got["6"].batch_pos == 2


RSS = """<?xml version="1.0"?><rss><channel><title>c</title>
<item><guid isPermaLink="false">g2</guid><title>Two</title><link>https://x.test/2</link><pubDate>Wed, 02 Sep 2026 10:00:00 +0300</pubDate><description><![CDATA[<p>Two</p>]]></description>
<enclosure url="https://x.test/f/a.pdf" type="application/pdf" length="12"/></item>
<item><title>One</title><link>https://x.test/1</link><pubDate>Tue, 01 Sep 2026 10:00:00 +0300</pubDate></item>
<item><title>Bad</title><link>/rel</link><pubDate>Tue, 01 Sep 2026 10:00:00 +0300</pubDate></item><item><title>No date</title><link>https://x.test/3</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>M</title><author><name>Ann</name><email>a@x.test</email></author><id>urn:x/9</id><link href="https://t.me/chan/77"/><updated>2026-09-02T10:00:00Z</updated><content type="html">body</content></entry>
<entry><title>N</title><id>urn:x</id><link href="https://t.me/chan/none"/><updated>2026-09-02T10:00:00Z</updated></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "rss").mkdir()
    (tmp_path / "atom").mkdir()
    (tmp_path / "rss/a.xml").write_text(RSS)
    (tmp_path / "rss/empty.xml").write_text("<rss><channel></channel></rss>")
    (tmp_path / "atom/b.xml").write_text(ATOM)
    entries = feeds.read_feed(spark, str(tmp_path / "rss"), "rss").withColumns({"source_id": F.lit("s"), "batch_pos": F.monotonically_increasing_id()})
    items, errors = feeds.feed_to_raw_items(entries)
    got = {r.title: r for r in items.collect()}
    assert set(got) == {"One", "Two"} and got["Two"].external_id == "g2" and len(got["One"].external_id) == 64 and got["Two"].raw_html == "<p>Two</p>"
    assert got["Two"].published_at == dt.datetime(2026, 9, 2, 7) and [tuple(a) for a in got["Two"].attachments] == [("document", "a.pdf", 12, "https://x.test/f/a.pdf", "application/pdf")]
    assert sorted(r.message for r in errors.collect()) == ["no absolute link", "no published or updated date"]
    assert [r.message.rsplit("/", 1)[-1] for r in feeds.feed_errors(spark, str(tmp_path / "rss"), "rss").collect()] == ["empty.xml"]
    atom = feeds.read_feed(spark, str(tmp_path / "atom"), "atom").withColumns({"source_id": F.lit("s"), "batch_pos": F.lit(0), "base_url": F.lit("https://x.test/feed")})
    items, errors = feeds.feed_to_raw_items(atom, channel=True)
    said = json.loads(items.first().metadata)
    assert said == {"collector": "native_rss", "feed_url": "https://x.test/feed", "author": "Ann (a@x.test)", "entry_id": "urn:x/9", "updated": "2026-09-02T10:00:00Z"}
    assert [(r.external_id, r.raw_html) for r in items.collect()] == [("77", "body")] and [r.message for r in errors.collect()] == ["no numeric message id"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nb")
    (tmp_path / "b.txt").write_text(" \n")
    good, bad = feeds.read_text_documents(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["# A\n\nb"] and [r.code for r in bad.collect()] == ["document_blank"]


def test_extraction(spark):
    attachment = "array<struct<kind:string,name:string,size:bigint,download_ref:string,mime_type:string>>"
    rows = [("s", "1", "text", "<p>html</p>", ["doc", "TEXT"], []), ("s", "2", None, "<p>html</p><script>x</script>", None, []), ("s", "3", None, None, None, [("document", "f", 1, None, None)]),
            ("s", "4", "", None, None, []), ("s", "5", "t", None, None, [("document", "r", 1, "https://x", None), ("image", "i", 1, None, None)])]
    items = spark.createDataFrame(rows, f"source_id string, external_id string, raw_text string, raw_html string, documents array<string>, attachments {attachment}")
    good, bad = ingest.extract_items(items)
    got = {r.external_id: r for r in good.collect()}
    assert got["1"].extracted_text == "text\n\ndoc" and got["2"].extracted_text == "html" and got["5"].attachment_errors == ["r: not a local file"]
    assert {(r.external_id, r.code) for r in bad.collect()} == {("3", "attachment_unavailable"), ("4", "empty_content")}


def test_normalize_rejects(spark):
    when = dt.datetime(2026, 1, 1)
    rows = [("s", "1", "https://X.test/a/", when, "T", " a  b ", 0), ("s", "2", "ftp://x", when, None, "x", 1), ("s", "3", "https://x.test", when, None, " ", 2), ("s", "4", "https://x.test", None, " ", "first\nsecond", 3)]
    items = spark.createDataFrame(rows, "source_id string, external_id string, original_url string, published_at timestamp, title string, extracted_text string, batch_pos long")
    good, bad = ingest.normalize_materials(items, F.lit(when))
    assert [(r.external_id, r.title, r.text, r.original_url) for r in good.collect()] == [("1", "T", "a b", "https://x.test/a")]
    assert {(r.external_id, r.message) for r in bad.collect()} == {("2", "no absolute http(s) URL"), ("3", "blank text"), ("4", "no date")}


def test_load_context(spark):
    sources = spark.createDataFrame([("b", "telegram", "@b", True), ("a", "website", "z", True), ("c", "website", "y", False)], "id string, kind string, normalized_locator string, enabled boolean")
    profiles = spark.createDataFrame([("p", True), ("q", False)], "id string, enabled boolean")
    kept, profile = ingest.load_context(sources, profiles, "p")
    assert [r.id for r in kept.collect()] == ["a", "b"] and profile.count() == 1
    assert [r.id for r in ingest.load_context(sources, profiles, "p", include_disabled=True)[0].collect()] == ["c", "a", "b"]
    for missing in ("q", "none"):
        with pytest.raises(LookupError):
            ingest.load_context(sources, profiles, missing)
