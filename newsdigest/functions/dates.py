"""Free-form date parsing to a calendar day.

Semantics of the monitored job: lower-case, map month stems to English, drop
characters of other alphabets, parse free-form with missing parts taken from the run
time, and fall back to the run time when parsing fails. Only the calendar day is used,
in the source's own offset (no time-zone shift).

Spark-first: a cascade of built-in regex extractions covers the common shapes (ISO,
dotted, day-month-year, month-day-year, day-month, month-year, time only, empty). Only
the residue goes to one Arrow-batched pandas UDF running the free-form parser; rows
that the cascade handles pass a null to it, so the UDF does no parsing for them.
"""

from __future__ import annotations

import datetime as _dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MONTH_STEMS, Config

# English month names (full and three-letter), the parser's vocabulary
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]
MONTHS_ABBR = [m[:3] for m in MONTHS]
# characters kept before parsing: Latin blocks (Basic, Latin-1, Extended-A/B, Additional)
NON_LATIN = "[^\\u0000-\\u024F\\u1E00-\\u1EFF]"

ISO_RE = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})([t ].*)?$"
DOTTED_RE = "^([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})$"
DMY_RE = "^([0-9]{1,2}) ([a-z]+),? ([0-9]{4})$"
MDY_RE = "^([a-z]+) ([0-9]{1,2}),? ([0-9]{4})$"
DM_RE = "^([0-9]{1,2}) ([a-z]+)$"
MY_RE = "^([a-z]+) ([0-9]{4})$"
TIME_RE = "^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"


def month_stems(cfg: Config) -> list[tuple[str, str]]:
    stems = list(MONTH_STEMS)
    if cfg.fix_may_stem:
        # Q4: the capitalised key never matches lowered input; map the lower-case form
        stems = [("май", eng) if stem == "маЙ" else (stem, eng) for stem, eng in stems]
    return stems


def normalise(s, cfg: Config) -> Column:
    x = F.lower(F.coalesce(s if isinstance(s, Column) else F.col(s), F.lit("")))
    for stem, eng in month_stems(cfg):
        x = F.replace(x, F.lit(stem), F.lit(eng))
    x = F.regexp_replace(x, NON_LATIN, "")
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


_ABBR_STRING = "".join(MONTHS_ABBR)
_FULL_STRING = "|" + "|".join(MONTHS) + "|"


def _month_no(name: Column) -> Column:
    """Month number of a full English month name or its three-letter abbreviation,
    else null (string lookups keep the generated code small)."""
    pos = F.instr(F.lit(_ABBR_STRING), F.substring(name, 1, 3))
    is_name = ((F.length(name) == 3) | (F.instr(F.lit(_FULL_STRING), F.concat(F.lit("|"), name, F.lit("|"))) > 0))
    ok = is_name & (pos > 0) & (((pos - 1) % 3) == 0)
    return F.when(ok, ((pos - 1) / 3 + 1).cast("int"))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")),
                         "yyyy-MM-dd")


def _g(x: Column, pat: str, i: int) -> Column:
    return F.regexp_extract(x, pat, i)


# shapes of the normalised string: letter runs -> 'a', each digit -> 'd'
TIME_SHAPE = "^dd?:dd(:dd)?$"
DOTTED_SHAPE = "^dd?\\.dd?\\.dddd$"
DMY_SHAPE = "^dd? a,? dddd$"
MDY_SHAPE = "^a dd?,? dddd$"
DM_SHAPE = "^dd? a$"
MY_SHAPE = "^a dddd$"


def shape_of(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[a-z]+", "a"), "[0-9]", "d")


def cascade_day(x: Column, cfg: Config, shape: Column | None = None, nums: Column | None = None,
                words: Column | None = None) -> tuple[Column, Column]:
    """(day or null, handled flag) from the normalised string ``x``. The string is
    reduced once to its shape, its digit runs and its letter runs; each case is a match
    on the short shape plus array lookups (ISO keeps its own prefix regex)."""
    run = cfg.run_day
    ry, rd = F.lit(run.year), F.lit(run.day)
    shape = shape if shape is not None else shape_of(x)
    nums = nums if nums is not None else F.regexp_extract_all(x, F.lit("[0-9]+"), 0)
    words = words if words is not None else F.regexp_extract_all(x, F.lit("[a-z]+"), 0)
    n1, n2, n3 = (F.try_element_at(nums, F.lit(i)) for i in (1, 2, 3))
    mon = _month_no(F.try_element_at(words, F.lit(1)))

    iso = _ymd(_g(x, ISO_RE, 1), _g(x, ISO_RE, 2), _g(x, ISO_RE, 3))
    a, b, y = n1.cast("int"), n2.cast("int"), n3
    if cfg.dayfirst:
        dotted = F.when(b > 12, _ymd(y, a, b)).otherwise(_ymd(y, b, a))
    else:
        # Q3: month first unless the first number cannot be a month
        dotted = F.when(a > 12, _ymd(y, b, a)).otherwise(_ymd(y, a, b))
    first = _ymd(n1, mon, F.lit(1))
    cases = [
        (x == F.lit(""), F.lit(run)),
        (shape.rlike(TIME_SHAPE), F.lit(run)),
        (x.rlike(ISO_RE), iso),
        (shape.rlike(DOTTED_SHAPE), dotted),
        (shape.rlike(DMY_SHAPE) & mon.isNotNull(), _ymd(n2, mon, n1)),
        (shape.rlike(MDY_SHAPE) & mon.isNotNull(), _ymd(n2, mon, n1)),
        (shape.rlike(DM_SHAPE) & mon.isNotNull(), _ymd(ry, mon, n1)),
        (shape.rlike(MY_SHAPE) & mon.isNotNull(), F.date_add(first, F.least(rd, F.dayofmonth(F.last_day(first))) - 1)),
    ]
    expr = None
    handled = F.lit(False)
    for cond, val in cases:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        handled = handled | cond
    return expr, handled


def _residue_parser(run_ts: _dt.datetime, dayfirst: bool):
    @F.pandas_udf(T.DateType())
    def parse_residue(s: pd.Series) -> pd.Series:
        from dateutil import parser as du

        def one(v):
            if v is None or (isinstance(v, float) and pd.isna(v)):
                return None
            try:
                return du.parse(v, default=run_ts, dayfirst=dayfirst).date()
            except (ValueError, OverflowError, TypeError):
                return None
        return s.map(one)
    # marked non-deterministic only to keep Catalyst from copying the whole cascade into
    # a filter on the parsed day (predicate pushdown through the projection); the filter
    # then reads the computed column and the generated code stays small
    return parse_residue.asNondeterministic()


def with_day(df, src_col: str, out_col: str, cfg: Config, residue: bool = True):
    """P7 as a DataFrame step: the normalised string is projected once (it feeds about
    twenty regex extractions; keeping it a separate projection keeps the generated code
    of the cascade small enough to compile)."""
    nx, sh, nu, wo = (f"_{k}_{out_col}" for k in ("nx", "shape", "nums", "words"))
    x = df.withColumn(nx, normalise(F.col(src_col), cfg))
    x = x.withColumn(sh, shape_of(F.col(nx))) \
        .withColumn(nu, F.regexp_extract_all(F.col(nx), F.lit("[0-9]+"), 0)) \
        .withColumn(wo, F.regexp_extract_all(F.col(nx), F.lit("[a-z]+"), 0))
    day, handled = cascade_day(F.col(nx), cfg, F.col(sh), F.col(nu), F.col(wo))
    parts = [day]
    if residue:
        udf = _residue_parser(cfg.run_ts, cfg.dayfirst)
        parts.append(udf(F.when(~handled, F.col(nx))))
    parts.append(F.lit(cfg.run_day))
    return x.withColumn(out_col, F.coalesce(*parts)).drop(nx, sh, nu, wo)


def parse_day(s, cfg: Config, residue: bool = True) -> Column:
    """The calendar day of a free-form date string; the run day when it cannot be
    parsed (so undated items count as today, Q2)."""
    x = normalise(s, cfg)
    day, handled = cascade_day(x, cfg)
    parts = [day]
    if residue:
        udf = _residue_parser(cfg.run_ts, cfg.dayfirst)
        parts.append(udf(F.when(~handled, x)))
    parts.append(F.lit(cfg.run_day))
    return F.coalesce(*parts)
