"""Feeds as they are found: namespaces, entities, nested CDATA, broken ends, pages that are no feeds."""

import pytest

from lakepress.sources import feeds


def one(xml, most=200):
    found, error = feeds.entries(xml, most)
    assert error is None
    return found


def test_namespaces_entities_and_nested_cdata():
    xml = """<?xml version="1.0" encoding="windows-1252"?><!DOCTYPE rss><rss xmlns:c="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title>
    <item><title>A &amp; B &nbsp;caf&eacute; &#8211; R&D &unknown;</title><link>https://a.example/x?a=1&b=2</link><dc:date>2024-01-15</dc:date><description>short</description>
    <c:encoded><![CDATA[<p>one ]]]]><![CDATA[> two &nbsp;</p>]]></c:encoded><source url="https://pub.example/rss">Pub</source></item></channel></rss>"""
    (e,) = one(xml)
    assert e == {"title": "A & B \xa0café – R&D &unknown;", "link": "https://a.example/x?a=1&b=2", "body": "<p>one ]]> two &nbsp;</p>", "date": "2024-01-15", "origin": "https://pub.example/rss"}


def test_atom_links_and_markup():
    xml = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">&lt;b&gt;T&lt;/b&gt;</title><link rel="self" href="https://a/self"/><link href="https://a/page"/><updated>2024-01-02T03:04:05Z</updated>
    <content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>in</p></div></content></entry><entry><title/></entry></feed>"""
    first, second = one(xml)
    assert first["link"] == "https://a/page" and "in" in first["body"] and first["date"] == "2024-01-02T03:04:05Z"
    assert second == {"title": None, "link": None, "body": None, "date": None, "origin": None}


def test_rdf_empty_feeds_and_the_first_entries():
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">' + "".join(f"<item><title>t{i}</title><link>l{i}</link></item>" for i in range(9)) + "</rdf:RDF>"
    assert [e["title"] for e in one(rdf, 4)] == ["t0", "t1", "t2", "t3"]
    assert one("<rss><channel/></rss>") == []
    broken = "<rss><channel><item><title>a</title><link>b</link></item><item><title>c</title><li"
    assert [e["title"] for e in one(broken)] == ["a"]


@pytest.mark.parametrize("xml", [None, "", "no feed", "<html><body><p>blocked</p></body></html>", "<!DOCTYPE html><html><br><item><title>a</title></item></html>", "<rss><channel><ite", '{"json": 1}'])
def test_what_is_no_feed_is_rejected(xml):
    found, error = feeds.entries(xml, 5)
    assert found == [] and error.startswith("not a feed")


def test_items_and_rejects(spark):
    rss = "<rss><channel><item><title>Storm - Pub</title><link>https://news.example/x</link><description>Storm</description><source url='https://www.pub.example/'>Pub</source><pubDate>Mon, 15 Jan 2024 10:00:00 +0100</pubDate></item><item><title>no link</title></item></channel></rss>"
    df = spark.createDataFrame([("search", "google_news", rss), ("wire", "rss", rss), ("dead", "rss", "<html>"), ("none", "rss", None)], "source string, kind string, xml string")
    got = {r.source: r for r in feeds.parse_feeds(df).collect()}
    assert set(got) == {"search", "wire"}
    assert (got["search"].text, got["search"].source_domain) == ("", "pub.example") and (got["wire"].text, got["wire"].source_domain) == ("Storm", "news.example")
    assert got["wire"].published_at == "2024-01-15T09:00:00Z" and got["wire"].pos == 0
    assert {r.source for r in feeds.rejected_feeds(df).collect()} == {"dead", "none"}
