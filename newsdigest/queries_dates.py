"""Date queries over ``events.ts`` formatted to strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .config import latin_config
from .functions import dates as D
from .session import read_table

CFG = latin_config()

# Russian genitive month names, used only to format test strings from timestamps
RU_GENITIVE = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября",
               "октября", "ноября", "декабря"]


def date_strings(spark, sf):
    """One date string per event, its shape chosen by the event type."""
    e = read_table(spark, sf, "events")
    ts = F.col("ts")
    ru = F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "),
                  F.element_at(F.array(*[F.lit(m) for m in RU_GENITIVE]), F.month(ts)),
                  F.lit(" "), F.year(ts).cast("string"))
    en = F.concat(F.element_at(F.array(*[F.lit(m.capitalize()) for m in D.MONTHS]), F.month(ts)), F.lit(" "),
                  F.dayofmonth(ts).cast("string"), F.lit(", "), F.year(ts).cast("string"))
    s = (F.when(F.col("event_type") == "signup", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
         .when(F.col("event_type") == "error", F.date_format(ts, "dd.MM.yyyy"))
         .when(F.col("event_type") == "view", ru)
         .when(F.col("event_type") == "purchase", F.date_format(ts, "HH:mm"))
         .otherwise(en))
    return e.select("event_id", s.alias("date_str"))


def date_strings_sql() -> str:
    ru = O.sql_list(RU_GENITIVE)
    en = O.sql_list([m.capitalize() for m in D.MONTHS])
    return f"""SELECT event_id, CASE
  WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN event_type = 'error' THEN strftime(ts, '%d.%m.%Y')
  WHEN event_type = 'view' THEN CAST(day(ts) AS VARCHAR) || ' ' || {ru}[month(ts)] || ' ' || CAST(year(ts) AS VARCHAR)
  WHEN event_type = 'purchase' THEN strftime(ts, '%H:%M')
  ELSE {en}[month(ts)] || ' ' || CAST(day(ts) AS VARCHAR) || ', ' || CAST(year(ts) AS VARCHAR) END AS date_str
FROM events"""


def _norm_sql(s: str) -> str:
    x = f"lower(coalesce({s}, ''))"
    for stem, eng in D.month_stems(CFG):
        x = f"replace({x}, {O.q(stem)}, {O.q(eng)})"
    x = f"regexp_replace({x}, '[^\\x00-\\x{{24F}}\\x{{1E00}}-\\x{{1EFF}}]', '', 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _month_sql(name: str) -> str:
    full = O.sql_list(D.MONTHS)
    abbr = O.sql_list(D.MONTHS_ABBR)
    return (f"CASE WHEN list_position({full}, {name}) > 0 THEN list_position({full}, {name}) "
            f"WHEN list_position({abbr}, {name}) > 0 THEN list_position({abbr}, {name}) END")


def _ymd_sql(y, m, d) -> str:
    return (f"CAST(try_strptime(printf('%04d-%02d-%02d', CAST({y} AS INTEGER), CAST({m} AS INTEGER), "
            f"CAST({d} AS INTEGER)), '%Y-%m-%d') AS DATE)")


def parse_day_sql(x: str) -> str:
    run = CFG.run_day
    g = lambda pat, i: f"regexp_extract({x}, {O.q(pat)}, {i})"
    shape = f"regexp_replace(regexp_replace({x}, '[a-z]+', 'a', 'g'), '[0-9]', 'd', 'g')"
    nums = f"regexp_extract_all({x}, '[0-9]+')"
    words = f"regexp_extract_all({x}, '[a-z]+')"
    n1, n2, n3 = (f"{nums}[{i}]" for i in (1, 2, 3))
    mon = _month_sql(f"{words}[1]")
    iso = _ymd_sql(g(D.ISO_RE, 1), g(D.ISO_RE, 2), g(D.ISO_RE, 3))
    a, b = f"CAST({n1} AS INTEGER)", f"CAST({n2} AS INTEGER)"
    dotted = f"CASE WHEN {a} > 12 THEN {_ymd_sql(n3, b, a)} ELSE {_ymd_sql(n3, a, b)} END"
    first = _ymd_sql(n1, mon, 1)
    my = f"CAST({first} + (least({run.day}, day(last_day({first}))) - 1) * INTERVAL 1 DAY AS DATE)"
    m = lambda pat: f"regexp_matches({shape}, {O.q(pat.replace(chr(92) * 2, chr(92)))})"
    return f"""coalesce(CASE
  WHEN {x} = '' THEN DATE '{run}'
  WHEN {m(D.TIME_SHAPE)} THEN DATE '{run}'
  WHEN regexp_matches({x}, {O.q(D.ISO_RE)}) THEN {iso}
  WHEN {m(D.DOTTED_SHAPE)} THEN {dotted}
  WHEN {m(D.DMY_SHAPE)} AND {mon} IS NOT NULL THEN {_ymd_sql(n2, mon, n1)}
  WHEN {m(D.MDY_SHAPE)} AND {mon} IS NOT NULL THEN {_ymd_sql(n2, mon, n1)}
  WHEN {m(D.DM_SHAPE)} AND {mon} IS NOT NULL THEN {_ymd_sql(run.year, mon, n1)}
  WHEN {m(D.MY_SHAPE)} AND {mon} IS NOT NULL THEN {my}
END, DATE '{run}')"""


def q_parse_date(spark, sf):
    s = date_strings(spark, sf)
    return D.with_day(s, "date_str", "day", CFG).select("event_id", "date_str", "day")


def sql_parse_date():
    return f"SELECT event_id, date_str, {parse_day_sql('n')} AS day FROM (SELECT event_id, date_str, {_norm_sql('date_str')} AS n FROM ({date_strings_sql()}))"


def q_today_filter(spark, sf):
    s = q_parse_date(spark, sf)
    return s.filter(F.col("day") == F.lit(CFG.run_day)).select("event_id", "date_str")


def sql_today_filter():
    return f"SELECT event_id, date_str FROM ({sql_parse_date()}) WHERE day = DATE '{CFG.run_day}'"


QUERIES = {
    "parse_date": (q_parse_date, sql_parse_date),
    "today_filter": (q_today_filter, sql_today_filter),
}
