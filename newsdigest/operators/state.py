"""Day-scoped state: new items (J1), not-yet-sent URLs (J2), state upsert (A2), the
daily report (K1, J6), history write/load (K2, S10) and report reload (S9).

State is a table partitioned by ``run_date``: a run reads only its day's partition
(partition pruning) and rewrites only that partition (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import strip_ws
from ..session import cut_to_parquet
from ..config import (HISTORY_DATE_FORMAT, REPORT_DATE_HEADER, REPORT_HEAD, REPORT_LINK_HEADER, REPORT_NOTHING_FOUND,
                      REPORT_TABLE_END, REPORT_TIME_FORMAT, REPORT_TITLE_HEADER)


def new_items(items: DataFrame, state: DataFrame, keys=("site_name", "href2")) -> DataFrame:
    """Run items whose (site, link) is not in today's state; duplicates inside the
    run are kept."""
    return items.join(state.select(*keys).distinct(), list(keys), "left_anti")


def unsent(found: DataFrame, history: DataFrame | None, order_col: str = "text", tie_col: str | None = None) -> DataFrame:
    """Drop URLs already in today's history (none: the first run of the day), then
    a URL is kept once (first by ``order_col``, then ``tie_col``)."""
    rest = found if history is None else found.join(history.select("url").distinct(), "url", "left_anti")
    # first wins as a partial aggregate (a URL repeated in a third of all rows is
    # combined map-side), not a window partitioned by URL
    cols = [c for c in rest.columns if c != "url"]
    first = rest.groupBy("url").agg(F.min_by(F.struct(*cols), F.struct(order_col, *([tie_col] if tie_col else []))).alias("_f"))
    return first.select("url", *[F.col(f"_f.{c}").alias(c) for c in cols])


def upsert(state: DataFrame | None, items: DataFrame, keys=("site_name", "href2"),
           run_col: str = "run_no", pos_col: str = "pos") -> DataFrame:
    """A2: union of the old state and the new rows, last write wins per key (largest
    ``(run_no, pos)``). ``max_by`` is a partial aggregate, so a hot key is combined
    map-side."""
    cols = [c for c in items.columns if c not in keys]
    allrows = items if state is None else state.unionByName(items, allowMissingColumns=True)
    order = F.struct(F.col(run_col), F.col(pos_col))
    agg = allrows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


def write_day(df: DataFrame, path: str, day_col: str = "run_date") -> None:
    """Rewrite only the partitions present in ``df`` (dynamic partition overwrite)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    df.write.mode("overwrite").partitionBy(day_col).parquet(path)


def read_day(spark, path: str, run_date, day_col: str = "run_date") -> DataFrame:
    """One day's partition (pruned at the scan)."""
    return spark.read.parquet(path).where(F.col(day_col) == F.lit(run_date))


def report_rows(sites: DataFrame, state: DataFrame) -> DataFrame:
    """K1 + J6: every configured site in config order with its items sorted by link; a
    'nothing found' row for a site without items. Returns (site_pos, site_name, row_no,
    date, title, href2, cell_html) where row_no orders items inside a site."""
    from .ordering import rank_within_group
    st = state.select("site_name", "href2", "date", "title")
    items = rank_within_group(st, "site_name", [F.col("href2")], "row_no")
    j = sites.select("site_pos", "site_name").join(items, "site_name", "left")
    row = F.coalesce(F.col("row_no"), F.lit(0))
    cell = F.when(
        F.col("href2").isNull(),
        F.lit(f"<th>{REPORT_NOTHING_FOUND}</th><th></th></tr>"),
    ).otherwise(F.format_string('<th>%s</th><th>%s</th><th><a href="%s">%s</a></th></tr>',
                                F.coalesce(F.col("date"), F.lit("")), F.coalesce(F.col("title"), F.lit("")),
                                F.col("href2"), F.col("href2")))
    return j.select("site_pos", "site_name", row.alias("row_no"), "date", "title", "href2",
                    cell.alias("cell_html"))


def report_header(site_name) -> F.Column:
    return F.format_string(
        "<h2>%s</h2><table class=\"table\"><tr><th>%s</th><th>%s</th><th>%s</th></tr>",
        site_name, F.lit(REPORT_DATE_HEADER), F.lit(REPORT_TITLE_HEADER), F.lit(REPORT_LINK_HEADER))


def history_lines(history: DataFrame, run_date) -> DataFrame:
    """K2: header line with the date, then ``prob url`` by probability desc; ties keep
    insertion order (``pos``). Returns (line_no_key, line) sort keys without a global
    window: (0, header) then (1, -prob, pos)."""
    body = history.select(F.lit(1).alias("part"), (-F.col("prob")).alias("k"), F.col("pos"),
                          F.concat(F.col("prob").cast("string"), F.lit(" "), F.col("url")).alias("line"))
    head = history.sparkSession.range(1).select(
        F.lit(0).alias("part"), F.lit(None).cast("double").alias("k"), F.lit(None).cast("long").alias("pos"),
        F.date_format(F.lit(run_date), HISTORY_DATE_FORMAT).alias("line"))
    return head.unionByName(body)


def parse_history(lines: DataFrame, run_date, value_col: str = "value") -> DataFrame:
    """First line is the ``dd/MM/yyyy`` date; later lines ``prob url``. Rows are
    kept only when the file's date is the run date. ``lines``: (file, line_no, value)."""
    first = (lines.filter(F.col("line_no") == 0)
             .select("file", F.try_to_date(strip_ws(F.col(value_col)), HISTORY_DATE_FORMAT).alias("run_date")))
    body = lines.filter(F.col("line_no") > 0).select(
        "file", "line_no", F.split(strip_ws(F.col(value_col)), "\\s+").alias("_p"))
    parsed = body.select("file", "line_no",
                         F.element_at("_p", 2).alias("url"),
                         F.col("_p")[0].try_cast("double").alias("prob"))
    return (parsed.join(first, "file")
            .filter(F.col("run_date") == F.lit(run_date))
            .filter(F.col("url").isNotNull()))


def write_report(report: DataFrame, sites_header: DataFrame, path: str, run_date, run_time: str | None = None) -> None:
    """K1 sink: the day's report as text lines under ``run_date=<day>``: the page's head and the run's time
    (``run_time`` as ``dd-MM-yyyy HH:mm``; the day at midnight without one), then one header line
    per configured site, its cells and the end of its table, in site order then link order. The sort is a
    range sort (no single-partition step); part files are written in order."""
    spark = report.sparkSession
    heads = sites_header.select(F.lit(1).alias("part"), "site_pos", F.lit(-1).cast("long").alias("row_no"), report_header(F.col("site_name")).alias("value"))
    ends = sites_header.select(F.lit(1).alias("part"), "site_pos", F.lit(2**63 - 1).alias("row_no"), F.lit(REPORT_TABLE_END).alias("value"))
    cells = report.select(F.lit(1).alias("part"), "site_pos", F.col("row_no").cast("long").alias("row_no"), F.col("cell_html").alias("value"))
    at = F.lit(run_time) if run_time else F.date_format(F.lit(run_date).cast("timestamp"), REPORT_TIME_FORMAT)
    top = spark.range(2).select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("site_pos"), F.col("id").alias("row_no"),
                                F.when(F.col("id") == 0, F.lit(REPORT_HEAD)).otherwise(F.format_string("<h2>%s</h2>", at)).alias("value"))
    lines = top.unionByName(heads).unionByName(cells).unionByName(ends).withColumn("run_date", F.lit(run_date))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (lines.orderBy("part", "site_pos", "row_no").select("run_date", "value")
     .write.mode("overwrite").partitionBy("run_date").text(path))


def write_history(history: DataFrame, path: str, run_date) -> None:
    """K2 sink: today's history as text lines (date header, then ``prob url`` by
    probability desc, insertion order on ties), rewriting only today's partition."""
    spark = history.sparkSession
    lines = history_lines(history, run_date).withColumn("run_date", F.lit(run_date))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (lines.orderBy("part", F.col("k").asc_nulls_first(), F.col("pos").asc_nulls_first())
     .select("run_date", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("run_date").text(path))


def read_history(spark, path: str, run_date) -> DataFrame:
    """S10 for the K2 sink: (url, prob) of the run day's partition; the date header and other lines that are
    no ``prob url`` are skipped."""
    parts = F.split(strip_ws(F.col("value")), "\\s+")
    return (spark.read.text(path).where(F.col("run_date") == F.lit(run_date))
            .select(F.try_element_at(parts, F.lit(2)).alias("url"), parts[0].try_cast("double").alias("prob"))
            .filter(F.col("url").isNotNull() & F.col("prob").isNotNull()))


def read_report(spark, path: str, run_date) -> DataFrame:
    """S9 + J8 for the K1 sink: (site_name, href2, date, title) of the run day's report. A cell belongs to the last
    site header before it. Files are read line by line in splits, so a report may be of any size: a line's place is
    its file, its split's first byte and its turn there. Inside a split the last header is carried forward; a split that
    begins in a site's cells goes on with the last header of the splits before, of which one row each is enough. The page's first
    header is the run's time, not a site."""
    lines = spark.read.text(path).where(F.col("run_date") == F.lit(run_date)).select(
        "run_date", "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("turn"))
    lines = lines.withColumn("site", F.when(F.col("value").startswith("<h2>"), F.regexp_extract("value", "<h2>(.*?)</h2>", 1)))
    split = ["file", "start"]
    lines = cut_to_parquet(lines.filter(F.col("site").isNotNull() | F.col("value").contains('<a href="')), "report")
    headers = F.when(F.col("site").isNotNull(), F.col("turn"))
    last = lines.groupBy("run_date", *split).agg(F.max_by("site", headers).alias("last"))
    earlier = Window.partitionBy("run_date").orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    last = last.select(*split, F.last("last", ignorenulls=True).over(earlier).alias("before"))
    in_split = Window.partitionBy(*split).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.regexp_extract_all("value", F.lit("<th>(.*?)</th>"), 1)
    return (lines.withColumn("in_split", F.last("site", ignorenulls=True).over(in_split)).join(last, split)
            .filter(F.col("value").contains('<a href="'))
            .select(F.coalesce("in_split", "before").alias("site_name"), F.regexp_extract("value", '<a href="([^"]*)"', 1).alias("href2"),
                    F.element_at(cells, 1).alias("date"), F.element_at(cells, 2).alias("title")))
