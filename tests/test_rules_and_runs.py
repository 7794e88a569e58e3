"""Rule documents (S11, P17) and a whole ingest run (M7) on small inputs."""

import json

from newsdigest.config import latin_config
from newsdigest.plans import ingest as I
from newsdigest.sources import extract as X
from newsdigest.sources import scans as S

CFG = latin_config()
CAPTURES = "url string, attempt long, status int, error string, body binary"
SITE = "site_name string, site_pos long, rss boolean, encoding string, main_xpath string, title_xpath string, text_xpath string, href_xpath string, city_xpath string, date_xpath string"


def test_rule_documents_and_the_path_attribute(spark):
    docs = {"div_map": {"vz.ru": [["article", {"class": "x"}], ["p"]], "a.org": [["div"]]}, "extract_map": {"a.org": [["nav"]], "no.org": [["p"]]},
            "collect_all": ["a.org", "a.org"], "ignore_header": ["vz.ru"], "endswith": ["vz.ru", "z.ru"], "sub_p": None}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("lower_ssl_security", None)]
    rules, suffixes = S.load_rules(spark.createDataFrame(rows, "name string, value string"))
    got = {r.netloc: r for r in rules.collect()}
    assert set(got) == {"vz.ru", "a.org"}
    assert [(d.tag, d.attrs) for d in got["vz.ru"].divs] == [("article", {"class": "x"}), ("p", {})]
    assert (got["vz.ru"].drop_divs, got["vz.ru"].ignore_header, got["vz.ru"].collect_all, got["vz.ru"].attr_from_path) == (None, True, False, "data-url")
    assert ([d.tag for d in got["a.org"].drop_divs], got["a.org"].collect_all, got["a.org"].sub_p, got["a.org"].attr_from_path) == (["nav"], True, False, None)
    assert sorted((r.ord, r.template) for r in suffixes.collect()) == [(0, "vz.ru"), (1, "z.ru")]
    page = "<article class='x' data-url='/o'>other</article><article class='x' data-url='/me'>mine</article><p>p</p>"
    pages = spark.createDataFrame([(1, "https://www.vz.ru/me?x=1", page), (2, "https://vz.ru/none", page), (3, "https://b.org/", page)],
                                  "page_id long, url string, html string")
    assert {r.page_id: r.text for r in X.extract_articles(pages, rules, suffixes).collect()} == {1: "mine\np\n", 2: "p\n", 3: "\n"}


def test_no_rule_documents(spark):
    rules, suffixes = S.load_rules(spark.createDataFrame([], "name string, value string"))
    assert rules.count() == 0 and suffixes.count() == 0


def test_a_run_over_feeds_listings_and_state(spark):
    sites = spark.createDataFrame([("feed", 1, True, None, None, None, None, None, None, None), ("list", 2, False, "cp1251", "//li", "a", "p", "a", "i", "b"),
                                   ("empty", 3, False, "", "//li", "a", "", "a", "", "")], SITE)
    word = "удар"
    broken = word.encode().decode("cp1251")
    lists = (f"<ul><li><a href='/1'>Strike {broken}</a><i>{broken}</i></li><li><a href='/2'>calm</a><p>a strike</p></li><li><a href='/3'>strike</a><b>2001-01-01</b></li>"
             "<li><a href='/4'>strike known</a></li><li><a href='/1'>Strike again</a></li></ul>")
    rss = "<rss><channel><link>https://f.org/</link><item><title>strike</title><link>https://f.org/x</link></item><item><title>no</title></item></channel></rss>"
    lines = spark.createDataFrame([("feed", 0, " https://f.org/rss "), ("feed", 1, ""), ("list", 0, "https://l.org/news"), ("list", 1, "https://l.org/gone"),
                                   ("list", 2, "bad line"), ("list", 3, None), ("other", 0, "https://l.org/news")], "site_name string, line_no long, value string")
    captures = spark.createDataFrame([
        ("https://f.org/rss", 1, 200, None, bytearray(rss.encode())), ("https://l.org/news", 1, 500, None, bytearray(b"<li><a href='/down'>strike</a>")),
        ("https://l.org/news", 2, 200, None, bytearray(lists.encode())), ("https://l.org/gone", 1, None, "timeout", None)], CAPTURES)
    prior = spark.createDataFrame([("list", "https://l.org/4", "old", "d", "", 1, (0, 0))],
                                  "site_name string, href2 string, title string, date string, city string, run_no int, pos struct<line_no: bigint, item_no: int>")
    state, report = I.ingest_sites(sites, lines, captures, CFG, ["strike"], prior, run_no=2)
    assert {(r.site_name, r.href2): (r.title, r.city) for r in state.collect()} == {
        ("feed", "https://f.org/x"): ("strike", ""), ("list", "https://l.org/1"): ("Strike again", ""), ("list", "https://l.org/2"): ("calm", ""),
        ("list", "https://l.org/4"): ("old", "")}
    assert sorted((r.site_pos, r.row_no, r.href2) for r in report.collect()) == [
        (1, 1, "https://f.org/x"), (2, 1, "https://l.org/1"), (2, 2, "https://l.org/2"), (2, 3, "https://l.org/4"), (3, 0, None)]
    first = I.site_items(sites, lines, captures).filter("site_name = 'list' and item_no = 0").first()
    assert (first.title, first.city) == (f"Strike {word}", word)
