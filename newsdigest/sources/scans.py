"""Scans of line files, feeds and captures.

Line files (word list, stop words, URL list, history) are read with
``spark.read.text``; the functions here take the resulting ``value`` column so the
same code runs on files and on derived tables.
"""

from __future__ import annotations

import gzip
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FEED_AGGREGATOR, PATH_ATTRIBUTES
from ..functions.urls import is_valid_url, netloc, origin, strip_ws

#: RSS channels and Atom feeds in one: what a document does not have is null
FEED_SCHEMA = ("channel struct<link string, item array<struct<title string, link string, "
               "description string, pubDate string>>>, "
               "entry array<struct<title string, link array<struct<_href string>>, summary string, published string, updated string>>")


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path)


def word_list(lines: DataFrame, value_col: str = "value", lower: bool = True) -> DataFrame:
    """S1 (+ Q5): strip every line, drop blank ones, lower case."""
    w = strip_ws(F.col(value_col))
    if lower:
        w = F.lower(w)
    return lines.withColumn("word", w).filter(F.col("word") != "")


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """A missing keyword list is an error (checked with one tiny action)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def stop_words(lines: DataFrame, negation: str, value_col: str = "value") -> DataFrame:
    """Stripped lines as a set, minus the negation word."""
    return (lines.select(strip_ws(F.col(value_col)).alias("word"))
            .filter(F.col("word") != F.lit(negation)).distinct())


def url_list(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """S3 + F5: stripped, non-blank, valid URLs with their origin ``scheme://netloc``."""
    u = strip_ws(F.col(value_col))
    return (lines.withColumn("url", u)
            .filter(F.col("url") != "")
            .filter(is_valid_url(F.col("url")))
            .withColumn("base_url", origin(F.col("url"))))


def feed_items(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """S4 + P4: one row per RSS item or Atom entry (title, link, summary stripped, published; '' when
    absent). For the aggregator's channel the link is the first quoted string after
    'href' in the description, when there is one."""
    parsed = feeds.withColumn("_f", F.from_xml(F.col(xml_col), FEED_SCHEMA))
    atom = F.transform(F.col("_f.entry"), lambda e: F.struct(
        e["title"].alias("title"), F.try_element_at(e["link"], F.lit(1))["_href"].alias("link"), e["summary"].alias("description"),
        F.coalesce(e["published"], e["updated"]).alias("pubDate")))
    items = parsed.select(*[c for c in feeds.columns if c != xml_col],
                          F.col("_f.channel.link").alias("channel_link"),
                          F.posexplode(F.coalesce(F.col("_f.channel.item"), atom)).alias("entry_no", "_i"))
    link = F.coalesce(F.col("_i.link"), F.lit(""))
    desc = F.coalesce(F.col("_i.description"), F.lit(""))
    override = F.regexp_extract(desc, 'href[^"]*"([^"]*)"', 1)
    is_agg = F.coalesce(F.col("channel_link").contains(FEED_AGGREGATOR), F.lit(False))
    return items.select(
        *[c for c in feeds.columns if c != xml_col], "entry_no",
        F.coalesce(F.col("_i.title"), F.lit("")).alias("title"),
        F.when(is_agg & (override != ""), override).otherwise(link).alias("link"),
        strip_ws(desc).alias("summary"),
        F.coalesce(F.col("_i.pubDate"), F.lit("")).alias("published"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# --- rule documents (S11) ------------------------------------------------------------

_SELECTORS = "map<string, array<array<string>>>"
RULE_DOCUMENTS = {"div_map": _SELECTORS, "extract_map": _SELECTORS, "collect_all": "array<string>", "sub_p": "array<string>",
                  "ignore_header": "array<string>", "endswith": "array<string>", "lower_ssl_security": "array<string>"}


def load_rules(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents``, (name, value) with the JSON text of the seven rule documents, as the tables of rules (one
    row a host of ``div_map``, for ``extract_articles``, with ``lower_ssl_security`` as well) and suffix templates (ord, template).

    ``div_map`` and ``extract_map`` give each host its selectors, ``[tag]`` or ``[tag, {attribute: value}]``; the others list
    hosts. Attribute values are taken as strings. A document that is missing, null or no JSON counts as empty; hosts that
    are not in ``div_map`` have no rule."""
    def document(name: str) -> DataFrame:
        return documents.filter(F.col("name") == name).select(F.from_json("value", RULE_DOCUMENTS[name]).alias("v"))

    def selectors(name: str, column: str) -> DataFrame:
        one = lambda d: F.struct(d[0].alias("tag"), F.coalesce(
            F.from_json(F.try_element_at(d, F.lit(2)), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("attrs"))
        return (document(name).select(F.explode("v").alias("netloc", "d"))
                .groupBy("netloc").agg(F.max_by("d", F.size("d")).alias("d")).select("netloc", F.transform("d", one).alias(column)))

    rules = selectors("div_map", "divs").join(selectors("extract_map", "drop_divs"), "netloc", "left")
    for name in ("collect_all", "sub_p", "ignore_header", "lower_ssl_security"):
        hosts = document(name).select(F.explode("v").alias("netloc")).distinct().withColumn(name, F.lit(True))
        rules = rules.join(hosts, "netloc", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    paths = F.create_map(*[F.lit(x) for kv in PATH_ATTRIBUTES.items() for x in kv])
    suffixes = document("endswith").select(F.posexplode("v").alias("ord", "template"))
    return rules.withColumn("attr_from_path", F.try_element_at(paths, F.col("netloc"))), suffixes


# --- captures (S14, S15) ----------------------------------------------------------

def select_listing_capture(captures: DataFrame) -> DataFrame:
    """Per URL, the first attempt with status 200; else the last attempt; dropped
    when the chosen attempt errored (a non-200 body is still used). Partial aggregates
    only (``min_by`` skips null orderings)."""
    att = F.struct("attempt", "status", "error", "body")
    ok_order = F.when((F.col("status") == 200) & F.col("error").isNull(), F.col("attempt"))
    chosen = (captures.groupBy("url")
              .agg(F.coalesce(F.min_by(att, ok_order), F.max_by(att, F.col("attempt"))).alias("c")))
    return (chosen.filter(F.col("c.error").isNull())
            .select("url", "c.attempt", "c.status", "c.body"))


def select_article_capture(captures: DataFrame) -> DataFrame:
    """Per URL, the first attempt with no error and status < 400; null body when
    none (every URL stays)."""
    good = captures.filter(F.col("error").isNull() & (F.col("status") < 400))
    first = good.groupBy("url").agg(F.min_by(F.struct("attempt", "body"), F.col("attempt")).alias("c"))
    urls = captures.select("url").distinct()
    return urls.join(first, "url", "left").select("url", F.col("c.attempt").alias("attempt"),
                                                  F.col("c.body").alias("body"))


# --- bytes to text (P11), mojibake (P6) -------------------------------------------

@F.pandas_udf(T.BinaryType())
def _gunzip(b: pd.Series) -> pd.Series:
    def one(v):
        try:
            return None if v is None else gzip.decompress(bytes(v))
        except (OSError, EOFError, zlib.error):
            return None
    return b.map(one)


def decode_body(body: Column) -> Column:
    """UTF-8 text when the bytes are valid UTF-8; else the unzipped bytes, when they unzip, read the
    same way; what is no UTF-8 then is read as ISO-8859-1 (a parser's fallback). The gzip branch is the
    only Python step and sees only bodies that are not valid UTF-8."""
    as_text = F.try_validate_utf8(body.cast("string"))
    inner = _gunzip(F.when(as_text.isNull(), body))
    return F.coalesce(as_text, F.try_validate_utf8(inner.cast("string")), F.decode(F.coalesce(inner, body), "ISO-8859-1"))


@F.udf(T.StringType(), useArrow=False)  # a few rows at a time: texts may be long
def _repaired(text, charset):
    if text is None or not charset:
        return text
    try:
        return unicodedata.normalize("NFC", text).encode(charset).decode("utf-8", "ignore")
    except UnicodeError:
        return ""


def repair_mojibake(text: Column, charset: str | Column) -> Column:
    """Text that was UTF-8 bytes decoded with ``charset`` is composed (NFC), encoded with the charset
    again and decoded as UTF-8, without the bytes that are none. Text that the charset cannot encode
    becomes empty. The charset may be a column (per-site configuration); text without one stays as it is."""
    return _repaired(text, F.lit(charset) if isinstance(charset, str) else charset)


def host_of(url: Column) -> Column:
    return netloc(url)
