"""Listings by path selectors: XPath per site, over pages of any markup."""

import random
import time
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from newsdigest.sources import extract as X
from newsdigest.sources.html import PLACE, events, xml

SITES = "site_name string, main_xpath string, title_xpath string, text_xpath string, city_xpath string, date_xpath string, href_xpath string"


def _items(spark, sites, pages):
    s = spark.createDataFrame(sites, SITES)
    p = spark.createDataFrame([(site, i, html) for i, (site, html) in enumerate(pages)], "site_name string, page_id long, html string")
    rows = X.listing_by_paths(p, s).collect()
    return {(r.page_id, r.item_no): (r.title, r.text, r.city, r.date_str, r.href, r.href2) for r in rows}


def test_xml_keeps_every_element_and_text():
    rng = random.Random(3)
    pieces = ["p", "div", "li class='a b'", "ul", "b", "br", "/p", "/div", "/li", "/ul", "/b", "/x", "o:p xmlns='u' x:y=1 _at=5 1=2", "html lang=en", "/html"]
    for _ in range(200):
        page = events("".join(rng.choice(["a & é \x01 ", "<!-- c -->", f"<{rng.choice(pieces)}>"]) for _ in range(40)))
        text, begins, sizes = xml(page)
        root = ET.fromstring(text)
        found = {int(e.get(PLACE)): e for e in root.iter() if e.get(PLACE)}
        assert sorted(found) == [e["at"] for e in page if e["tag"]]
        if root.get(PLACE) is None:  # nothing is moved into a root of the page's own
            assert "".join(root.itertext()).replace("\ufffd", "\x01") == "".join(e["text"] for e in page if e["tag"] is None)
        for e in page:
            if e["tag"]:
                own = text[begins[e["at"] - 1] - 1:begins[e["at"] - 1] - 1 + sizes[e["at"] - 1]]
                assert ET.fromstring(own).get(PLACE) == str(e["at"])
            else:
                assert begins[e["at"] - 1] == sizes[e["at"] - 1] == 0


def test_paths_attributes_positions_and_unions(spark):
    page = ("<html><body><div class='news top'><p>x</p><h3><a href='/a'>One <b>bold</b></a></h3><span class='d'>01.02.2024</span><i>Here</i><i>There</i></div>"
            "<div class='other'><a href='/no'>No</a></div>"
            "<div class='news'><h3><a>Two</a> http://x.example.org/2 </h3><em class=d>02.02.2024</em><i>Only</i></div></body></html>")
    sites = [("s", "//div[contains(@class, 'news')]", "h3/a", "p | em", "i[2]", ".//*[@class='d']", ".//a")]
    assert _items(spark, sites, [("s", page), ("none", page), ("s", None), ("s", "")]) == {
        (0, 0): ("One", "x", "There", "01.02.2024", "/a", ""),
        (0, 1): ("Two", "02.02.2024", "", "02.02.2024", "", "http://x.example.org/2")}


def test_children_are_not_descendants_and_absolute_paths_see_the_page(spark):
    page = "<ul><li><p><a href='/deep'>deep</a></p><ul><li><a href='/in'>in</a></li></ul></li></ul><h1>Page</h1>"
    sites = [("a", "//ul/li", "a", "//h1", None, "  ", "a"), ("b", "body/ul/li", ".//a", None, None, None, ".//a"), ("c", "", "a", None, None, None, "a")]
    got = _items(spark, sites, [("a", page), ("b", page), ("c", page)])
    assert got == {(0, 0): ("", "Page", "", "", "", ""), (0, 1): ("in", "Page", "", "", "/in", ""), (1, 0): ("deep", "", "", "", "/deep", "")}


def test_no_sites_and_paths_that_are_refused(spark):
    assert _items(spark, [], [("a", "<p>x</p>")]) == {}
    with pytest.raises(ValueError):
        _items(spark, [("a", "//p", "a | //b", None, None, None, None)], [("a", "<p>x</p>")])
    with pytest.raises(ValueError):
        _items(spark, [("a", "//p", "(.//a)[1]", None, None, None, None)], [("a", "<p>x</p>")])


def test_long_and_deep_pages(spark):
    n = 20_000
    page = "<html><body><nav>" + "".join(f"<li><a href='/x/{i}'>title {i} &amp;</a></li>" for i in range(n)) + "</nav></body></html>"
    deep = "<div>" * 2000 + "<li><a href='/z'>z</a></li>"
    s = spark.createDataFrame([("s", "//li", "a", None, None, None, "a")], SITES)
    p = spark.createDataFrame([("s", 1, page), ("s", 2, deep)], "site_name string, page_id long, html string")
    begun = time.time()
    got = X.listing_by_paths(p, s).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("title", "href"), "item_no").alias("last")).collect()
    assert {r.page_id: (r.n, tuple(r["last"])) for r in got} == {1: (n, (f"title {n - 1} &", f"/x/{n - 1}")), 2: (1, ("z", "/z"))}
    assert time.time() - begun < 90
