"""Feeds, sitemaps and their indexes."""

from pressgrain.sources.feeds import feed_rows, xml_entries

ATOM = '''<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>
<entry><title>One &amp; <![CDATA[<two>]]></title><link rel="self" href="https://x/self"/><link href="https://x/1"/><updated>2024-01-02</updated><published>2024-01-01</published></entry>
<entry><link href="https://x/2"/><author><name>n</name></author></entry></feed>'''


def test_atom_takes_the_alternate_link_and_the_first_date_name():
    assert xml_entries(ATOM, "feed") == [("One & <two>", "https://x/1", "2024-01-01"), (None, "https://x/2", None)]


def test_undeclared_prefixes_broken_documents_and_entities():
    assert xml_entries("<urlset><url><loc>https://x/1</loc><news:news><news:title>t</news:title></news:news></url></urlset>", "sitemap") == [("t", "https://x/1", None)]
    assert xml_entries("<rss><item><title>a</title><link>u</link></item><item><title>b</oops>", "feed") == [("a", "u", None)]
    assert xml_entries('<!DOCTYPE r [<!ENTITY a "b">]><rss><item><title>&a;</title></item></rss>', "feed") == []
    assert xml_entries(None, "feed") == xml_entries("", "feed") == xml_entries("plain text", "feed") == []


def test_index_files_lead_to_sitemaps(spark):
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://x/a.xml</loc><lastmod>2024-02-03</lastmod></sitemap><sitemap><loc>https://x/b.xml</loc></sitemap></sitemapindex>'
    site = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x/1</loc></url></urlset>'
    docs = spark.createDataFrame([(1, index, "https://x/index.xml"), (2, site, "https://x/a.xml"), (3, None, "https://x/b.xml")], "page_id long, html string, url string")
    named = feed_rows(docs, "index").select("url", "published")
    assert sorted(named.collect(), key=str) == [("https://x/a.xml", "2024-02-03"), ("https://x/b.xml", None)]
    below = feed_rows(docs.join(named.select("url"), "url"), "sitemap").collect()
    assert [(r["page_id"], r["position"], r["url"]) for r in below] == [(2, 0, "https://x/1")]
