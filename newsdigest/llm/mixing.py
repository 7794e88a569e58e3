"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose words are to be taken ``r`` times is copied ``floor(r)`` times, plus
once with probability ``p = r - floor(r)``. The fractional masses (``p`` times the words) are
rounded dependently: two documents meet, a random share of mass moves from one to the other
until one is empty or whole, and the other goes on. Mass is kept at each meeting, so a source
misses its target by half a document at most, and each document but the last keeps its probability.

Meetings run as a distributed reduction tree: documents of a source are dealt by hash into
blocks of about ``FAN_IN``, each block folds its documents with a higher-order function and
keeps one residual, and ``FAN_IN`` blocks make a block of the next level. A source of a third
of all rows is only more blocks. All randomness is a hash of seed and ids, so reruns agree.

Defined results: a null text has no words; a document without words is taken for 0 words; a null
source is a source, last in order; repeated rows are documents of their own, numbered, and each
is drawn by its number; texts of any length are one document; columns of any name are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from newsdigest.operators.ordering import rank_within_group

from .common import SPACE, cut, numbered, table

#: Documents, then residuals, that one fold takes on average.
FAN_IN = 64
#: No document and no source is taken more often than this.
MOST = 3
SEED = 20240907
WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame) -> DataFrame:
    """docs with ``size``, its number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, n (documents with words).

    Weights go to the sources in code-point order, null last, repeating. A target stops at
    ``most`` times the source's size; what is above is shared again by weight. That ends where
    ``target = min(most * size, level * weight)`` adds up to all words; sources are ordered by
    size / weight, and the first one that its cap does not stop sets the level. The windows run
    over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    by_code_point = W.Window.orderBy(F.col("source").isNull(), "source")
    array = F.array(*[F.lit(w) for w in weights])
    w = per.withColumn("rank", F.row_number().over(by_code_point)).withColumn(
        "weight", F.element_at(array, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by_ratio = W.Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after, everything = (by_ratio.rowsBetween(W.Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.Window.unboundedFollowing),
                                 by_ratio.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))
    cap = F.col("source_size") * most
    w = (w.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("capped_before", F.coalesce(F.sum(cap).over(before), F.lit(0)))
         .withColumn("weight_left", F.sum("weight").over(after))
         .withColumn("level_here", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
         .withColumn("free", cap >= F.col("level_here") * F.col("weight"))
         .withColumn("level", F.first(F.when(F.col("free"), F.col("level_here")), ignorenulls=True).over(everything)))
    return w.select("source", "source_size",
                    F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"), "n")


def _uniform(*parts: str) -> str:
    return f"(pmod(xxhash64({', '.join(parts)}, {SEED}L), 9007199254740992L) / 9007199254740992D)"


#: One document in a fold: h is its order, m the words of it that are still undecided, copies
#: what it has so far.
_ITEM = "struct<h:bigint,doc_id:bigint,tag:bigint,nth:bigint,size:bigint,copies:int,m:double>"


def _with(i: str, m: str, copies: str = "") -> str:
    return f"named_struct('h', {i}.h, 'doc_id', {i}.doc_id, 'tag', {i}.tag, 'nth', {i}.nth, 'size', {i}.size, 'copies', {i}.copies{copies}, 'm', {m})"


def _fold() -> str:
    """SQL of the fold over ``items``. State: c, the undecided document, and out, the decided.

    A meeting of i = s.c and x: up is the mass that can move from x to i, down from i to x; the
    way is drawn so that neither gains on average. ``least`` picks the bound that is met, and
    that document's mass is set to exactly nothing or its whole size."""
    meet = f"""
      transform(array(named_struct('i', s.c, 'x', x, 'up', least(s.c.size - s.c.m, x.m), 'down', least(s.c.m, x.size - x.m))), p ->
        if({_uniform('p.i.h', 'p.i.doc_id', 'p.x.h', 'p.x.doc_id')} * (p.up + p.down) < p.down,
          if(p.i.size - p.i.m <= p.x.m,
             named_struct('i', {_with('p.i', 'double(p.i.size)')}, 'x', {_with('p.x', 'p.x.m - (p.i.size - p.i.m)')}),
             named_struct('i', {_with('p.i', 'p.i.m + p.x.m')}, 'x', {_with('p.x', '0D')})),
          if(p.i.m <= p.x.size - p.x.m,
             named_struct('i', {_with('p.i', '0D')}, 'x', {_with('p.x', 'p.x.m + p.i.m')}),
             named_struct('i', {_with('p.i', 'p.i.m - (p.x.size - p.x.m)')}, 'x', {_with('p.x', 'double(p.x.size)')}))))[0]"""
    is_open = lambda v: f"({v}.m > 0 AND {v}.m < {v}.size)"
    settle = f"""
      transform(array({meet}), q -> named_struct(
        'c', if({is_open('q.i')}, q.i, if({is_open('q.x')}, q.x, cast(null as {_ITEM}))),
        'out', concat(s.out, filter(array(q.i, q.x), v -> NOT {is_open('v')}))))[0]"""
    return f"""aggregate(items, named_struct('c', cast(null as {_ITEM}), 'out', cast(array() as array<{_ITEM}>)),
      (s, x) -> if(NOT {is_open('x')}, named_struct('c', s.c, 'out', array_append(s.out, x)),
                if(s.c IS NULL, named_struct('c', x, 'out', s.out), {settle})))"""


def round_copies(docs: DataFrame, plan: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """docs (doc_id, tag, source, size, nth) with ``copies``. plan is what ``targets`` gives.

    ``tag`` tells apart rows that share a doc_id, ``nth`` those that are equal. Every row comes back once."""
    # a small table, one row per source; the driver needs only the largest count for the depth
    most = plan.agg(F.max("n")).first()[0] or 0
    key = lambda d: d.select("*", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")).drop("source")
    rows = key(docs).join(key(plan), ["no_source", "source_key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in))
    h = F.xxhash64("doc_id", "tag", "nth", F.lit(SEED))
    source = ["source_key", "no_source"]
    rows = rows.select(*source, F.pmod(h, blocks).alias("block"),
                       F.struct(h.alias("h"), "doc_id", "tag", "nth", "size", F.floor(rate).cast("int").alias("copies"),
                                ((rate - F.floor(rate)) * F.col("size")).alias("m")).alias("item"))
    done = [rows.filter("item.size <= 0").select(*source, "item")]
    level, left = rows.filter("item.size > 0"), max(1, -(-most // fan_in))
    while True:
        folded = cut(level.groupBy(*source, "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
                     .select(*source, "block", F.expr(_fold()).alias("f"))
                     .select(*source, "block", "f.c", "f.out"), "mix-level")
        done.append(folded.select(*source, F.explode("out").alias("item")))
        level = folded.filter("c IS NOT NULL").select(*source, F.floor(F.col("block") / fan_in).alias("block"), F.col("c").alias("item"))
        if left <= 1:
            break
        left = -(-left // fan_in)
    # one residual per source is left: to the nearer end, so a source misses by half a document at most
    last = F.expr(f"if(2 * item.m >= item.size, {_with('item', 'double(item.size)')}, {_with('item', '0D')})")
    done.append(level.select(*source, last.alias("item")))
    out = reduce(DataFrame.unionByName, done)
    whole = F.when((F.col("item.size") > 0) & (F.col("item.m") >= F.col("item.size")), 1).otherwise(0)
    return out.select(F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "item.doc_id", "item.tag", "item.nth", "item.size",
                      (F.col("item.copies") + whole).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, tag, nth of every row of docs."""
    narrow = cut(numbered(sized(docs.select("doc_id", "source", "text")).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "source", "size")), "mix-sizes")
    plan = cut(targets(narrow), "mix-targets")
    copies = round_copies(narrow, plan)
    return (copies.join(plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "tag", "nth"))


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as many times as it was drawn, with its own columns.
    Rows that share id, text and source are numbered, and each gets the copies of its number."""
    drawn = cut(mix(docs).select(F.col("doc_id").alias("mix_id"), F.col("tag").alias("mix_tag"), F.col("source").alias("mix_source"),
                                 F.col("nth").alias("mix_nth"), F.col("copies").alias("mix_copies")), "mix-drawn")
    of = ["mix_id", "mix_tag", "mix_source"]
    repeated = cut(drawn.filter("mix_nth = 2").select(*of), "mix-repeated")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"))
    row = {"mix_id": F.col("mix_row.doc_id"), "mix_tag": F.xxhash64(F.coalesce("mix_row.text", F.lit(""))), "mix_source": F.col("mix_row.source")}

    def taken(rows: DataFrame, with_copies: DataFrame, *also: Column) -> DataFrame:
        hit = reduce(lambda x, y: x & y, [row[c].eqNullSafe(F.col(c)) for c in of], F.lit(True))
        return (rows.join(with_copies.filter("mix_copies > 0"), reduce(lambda x, y: x & y, also, hit))
                .select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("mix_row.*"))

    if repeated.isEmpty():
        return taken(own, drawn)
    same = [row[c].eqNullSafe(F.col(c)) for c in of]
    hit = same[0] & same[1] & same[2]
    single = drawn.join(repeated.select(*[F.col(c).alias(f"r_{c}") for c in of]),
                        reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in of]), "left_anti")
    ranked = rank_within_group(own.join(repeated, hit, "left_semi").select(F.struct(*[row[c].alias(c) for c in of]).alias("mix_of"), "mix_row"),
                               "mix_of", [F.xxhash64("mix_row")], "mix_rank")
    return taken(own, single).unionByName(taken(ranked, drawn, F.col("mix_rank") == F.col("mix_nth")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("tag", "nth")
