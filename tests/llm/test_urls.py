"""URL filter (op5)."""

import duckdb

from newsdigest.llm import url_filter

from .conftest import rows

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [None, "", "no scheme", "http://", "://a.com/x", "HTTP://WWW.Example.COM/en/1?q", "http://blog.example.com/en/2", "http://example.com/EN/", "http://example.com",
        "http://xexample.com/en/", "http://a.net/es/1#f", "https://a.net/es?x", "x://b.net/fr/", "x\n://c.org/p?://d.com/", "http://\u00c9.org/a", "http://com/z",
        "http://one", "http://a://b.com/"] + [f"http://bad.example.org/{i}" for i in range(40)] + [f"http://good.example.org/{i}" for i in range(40)]


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def tables(spark):
    pages = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], None), (3, URLS[3], "h")]
    outcomes = [(i, 1) for i, u in enumerate(URLS) if u and "bad." in u] + [(i, 0) for i, u in enumerate(URLS) if u and "good." in u] + [(2, None), (None, 1), (7, 0), (7, 1), (9999, 1)]
    return pages, spark.createDataFrame(pages, "page_id long, url string, host string"), outcomes, spark.createDataFrame(outcomes, "page_id long, bad int")


def test_parts_rules_and_reputation(spark):
    pages, df, _, outcomes = tables(spark)
    found = rows(url_filter.judge(df, outcomes))
    assert len(found) == len(pages)
    by_url = {i: u for i, u, _ in pages}
    for r in found:
        host, path = parts(URLS[5] if r["page_id"] is None else by_url[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = brute_rule(host, path)
        assert r["rule"] == rule
        assert r["verdict"] == (verdict or ("block" if host == "bad.example.org" else "allow"))
        if host in ("bad.example.org", "good.example.org"):
            assert (r["labelled"], r["labelled_bad"]) == (40, 40 if host.startswith("bad") else 0)


def test_sql_twin_on_odd_urls(spark):
    pages, df, outcomes, out = tables(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    con.execute("CREATE TABLE labels(doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, 0)", [(i, None if b is None else 1 - b) for i, b in outcomes])
    got = url_filter.judge(df, out)
    want = con.sql(url_filter.OP5_SQL)
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda found: sorted(tuple("~" if x is None else str(x) for x in r) for r in found)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_a_few_bad_pages_do_not_block_a_host(spark):
    """The prior holds back what little evidence says."""
    pages = [(i, f"http://h{i % 50}.example.org/{i}") for i in range(1000)] + [(5000, "http://new.example.org/")]
    outcomes = [(i, 0) for i in range(1000)] + [(5000, 1)]
    found = rows(url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")))
    assert {r["verdict"] for r in found} == {"allow"}


def test_empty_tables(spark):
    pages, df, _, outcomes = tables(spark)
    assert url_filter.judge(df.limit(0), outcomes).count() == 0
    assert url_filter.judge(df, outcomes.limit(0)).count() == len(pages)
