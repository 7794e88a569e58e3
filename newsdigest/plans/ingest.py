"""Ingest (M7) and article resolution (M6) compositions.

Ingest: listing pages -> items (S5) -> item dates (P7) -> today (F3) -> keywords (F2)
-> link resolution with the page origin (P2, Q17) -> new against today's state (J1) ->
upsert, last write wins (A2) -> report rows per configured site (K1, J6). ``ingest_sites`` starts earlier:
site configuration (S2), URL lists (S3), captures (S14), bodies (P11), feeds (S4) and listings by path selectors (S5, P6).

Resolution: rule routing and extraction (J4, J5, F6, S6-S8, F12) -> fallback to the
feed text (P13) -> boilerplate removed (P12) -> blank rows dropped (F7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dates import with_day
from ..functions.text import has_text, strip_boilerplate, text_fallback
from ..functions.urls import netloc, origin, resolve_link, strip_ws
from ..operators import filters, state
from ..sources import scans
from ..sources.extract import extract_articles, extract_listing, listing_by_paths


def listing_items(pages: DataFrame, dates: DataFrame | None, cfg: Config, keywords: list[str],
                  main_tag="li", main_attrs=None, title_tag="a", href_tag="a", text_tag=None, city_tag=None,
                  date_tag=None) -> DataFrame:
    """Today's keyword-matching items of the listing pages: (site_name, href2, title,
    date, city, pos). ``dates``: (page_id, date_str), missing -> undated (today). Selectors may be columns
    of ``pages`` (per-site configuration)."""
    items = extract_listing(pages, main_tag, main_attrs, title_tag, href_tag, text_tag, city_tag, date_tag)
    pg = pages.select("page_id", netloc(F.col("url")).alias("site_name"), origin(F.col("url")).alias("base_url"))
    x = items.join(pg, "page_id")
    page_date = F.lit(None).cast("string")
    if dates is not None:
        x = x.join(dates.select("page_id", F.col("date_str").alias("page_date")), "page_id", "left")
        page_date = F.col("page_date")
    own = F.nullif(F.col("date_str"), F.lit(""))  # an item's own date comes before its page's
    x = with_day(x.withColumn("date_str", F.coalesce(own, page_date, F.lit(""))), "date_str", "day", cfg)
    x = filters.today_filter(x, cfg.run_day)
    x = filters.keyword_filter(x, keywords, "title", "text", cfg.filter_by_keywords)
    return x.select("site_name",
                    resolve_link(F.col("href2"), F.col("href"), F.col("base_url")).alias("href2"),
                    "title", F.date_format("day", "yyyy-MM-dd").alias("date"), "city",
                    F.struct("page_id", "item_no").alias("pos"))


def ingest(pages: DataFrame, dates: DataFrame | None, sites: DataFrame, cfg: Config, keywords: list[str],
           prior_state: DataFrame | None = None, run_no: int = 1) -> tuple[DataFrame, DataFrame]:
    """M7: returns (new state, report rows)."""
    items = listing_items(pages, dates, cfg, keywords).withColumn("run_no", F.lit(run_no))
    if prior_state is not None:
        new = state.new_items(items, prior_state)
        st = state.upsert(prior_state, new)
    else:
        st = state.upsert(None, items)
    return st, state.report_rows(sites, st)


def site_items(sites: DataFrame, url_lines: DataFrame, captures: DataFrame) -> DataFrame:
    """Every item of the configured sites: (site_name, line_no, item_no, title, text, city, date_str, href, href2, base_url).

    sites (S2): site_name, rss, encoding and the selectors of :func:`listing_by_paths`; url_lines (S3): (site_name, line_no,
    value), a line_no once a site; captures (S14): (url, attempt, status, error, body). Lines that are no URL, URLs without a
    usable capture and lines of no site give nothing. Sites with ``rss`` are read as feeds (S4, P4), others as listings (S5) whose
    title, text and city are repaired with the site's charset, if it has one (P6)."""
    urls = scans.url_list(url_lines).select("site_name", "line_no", "url", "base_url")
    got = urls.join(scans.select_listing_capture(captures), "url").join(sites.select("site_name", "rss", "encoding"), "site_name")
    got = got.withColumn("doc", scans.decode_body(F.col("body")))
    is_feed = F.coalesce(F.col("rss"), F.lit(False))
    feeds = got.filter(is_feed).select("site_name", "line_no", "base_url", F.col("doc").alias("xml"))
    entries = scans.feed_items(feeds).select(
        "site_name", "line_no", F.col("entry_no").alias("item_no"), "title", F.col("summary").alias("text"), F.lit("").alias("city"),
        F.col("published").alias("date_str"), F.lit("").alias("href"), F.col("link").alias("href2"), "base_url")
    pages = got.filter(~is_feed).select("site_name", F.col("line_no").alias("page_id"), F.col("doc").alias("html"))
    listed = (listing_by_paths(pages, sites).withColumnRenamed("page_id", "line_no")
              .join(urls.select("site_name", "line_no", "base_url"), ["site_name", "line_no"])
              .join(sites.select("site_name", "encoding"), "site_name"))
    for c in ("title", "text", "city"):
        listed = listed.withColumn(c, strip_ws(scans.repair_mojibake(F.col(c), F.col("encoding"))))
    return entries.unionByName(listed.drop("encoding"))


def ingest_sites(sites: DataFrame, url_lines: DataFrame, captures: DataFrame, cfg: Config, keywords: list[str],
                 prior_state: DataFrame | None = None, run_no: int = 1) -> tuple[DataFrame, DataFrame]:
    """M7 from what a run reads: site configuration, URL lists, captures and the day's state so far. Items of today (P7,
    F3) with a keyword (F1, F2) and a resolved link (P2) that the state lacks (J1) are added to it (A2). Returns
    (new state, report rows)."""
    x = with_day(site_items(sites, url_lines, captures), "date_str", "day", cfg)
    x = filters.keyword_filter(filters.today_filter(x, cfg.run_day), keywords, "title", "text", cfg.filter_by_keywords)
    items = x.select("site_name", resolve_link(F.col("href2"), F.col("href"), F.col("base_url")).alias("href2"), "title",
                     F.date_format("day", "yyyy-MM-dd").alias("date"), "city", F.lit(run_no).alias("run_no"),
                     F.struct("line_no", "item_no").alias("pos"))
    new = items if prior_state is None else state.new_items(items, prior_state)
    st = state.upsert(prior_state, new)
    return st, state.report_rows(sites, st)


def resolve_texts(pages: DataFrame, feed_text: DataFrame, rules: DataFrame, suffixes: DataFrame,
                  boilerplate) -> DataFrame:
    """M6: (page_id, url, text) for every page that yields text."""
    art = extract_articles(pages, rules, suffixes).filter(~F.col("skipped"))
    x = art.join(feed_text, "page_id", "left")
    text = strip_boilerplate(text_fallback(F.col("text"), F.col("feed_text")), boilerplate)
    out = x.select("page_id", "url", text.alias("text"))
    return out.filter(has_text(F.col("text")))
