"""Exact-text distinct (A1), cosine pair join (J9), greedy leader clustering (A5),
duplicate groups and statistics (A3, A4, A6).

Cosine pairs use an exact prefix filter (all-pairs similarity search): terms of a
unit vector are ordered rarest first (global order: ``df``, then term) and a term is
indexed while the squared norm of the rest of the vector, this term included, exceeds
``ksim^2``. Two vectors with ``cos > ksim`` must share an indexed term on both sides,
so the candidate join touches only short posting lists. A vector is one row (:func:`packed`), and what the index needs of it
comes from that row alone (:func:`profiles`). Where two rows meet, the norms of both
rests and the sketches of both vectors bound the cosine before anything is
shuffled by pair; every candidate left is then verified with the full dot product. No pair is capped or sampled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_to_parquet

_EPS = 1e-9


def distinct_texts(df: DataFrame, text_col: str = "text", url_col: str = "url",
                   pos_col: str = "pos") -> DataFrame:
    """A1: one row per distinct text, keeping the URL (and pos) of its first row.
    ``min_by`` is a partial aggregate: a text repeated in a third of all rows is combined
    map-side before the shuffle."""
    return (df.groupBy(text_col)
            .agg(F.min_by(F.struct(F.col(pos_col).alias("pos"), F.col(url_col).alias("url")),
                          F.col(pos_col)).alias("_first"))
            .select(F.col(text_col), F.col("_first.url").alias(url_col), F.col("_first.pos").alias(pos_col)))


#: Buckets of a sketch, in words of 64 bits.
SKETCH_WORDS = 8

#: Steps from ``ksim^2`` to 1 of the squared norm that a sketch tells apart.
MASS_STEPS = 8

#: Signatures of a vector, each of two least term hashes, that lead it to a pivot.
SIGNATURES = 4

#: Rows whose bucket masses are held at once.
PROFILED_ROWS = 1024

#: What sums and products of rounded norms may lack.
_SLACK = 1e-6


def packed(vectors: DataFrame) -> DataFrame:
    """(id, terms, raws, norm), one row per id, of vectors (id, term, df, w), or of rows that are packed already. Terms stand in a
    global order (``df``, then term) and ``raws / norm`` are their weights. ``df`` only orders the terms: it may come from a
    stored model, so it does not tell which terms are shared here."""
    if "terms" in vectors.columns:
        return vectors.select("id", "terms", "raws", "norm")
    rows = vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "term", "w"))).alias("e"))
    return rows.select("id", F.col("e.term").alias("terms"), F.col("e.w").alias("raws"), F.lit(1.0).alias("norm"))


def unit_weights() -> Column:
    """The weights of a packed row."""
    return F.transform("raws", lambda r: r / F.col("norm"))


def profiles(vectors: DataFrame, ksim: float) -> DataFrame:
    """(id, bits, needs, sigs, terms, ws, reach, rest) of every packed row, without a shuffle.

    Sketch: the terms are hashed to buckets, ``bits`` says which of them hold a term, and
    ``needs[j]`` is the least number of buckets that hold more than ``ksim^(2 - 2j / MASS_STEPS)`` of the squared norm. The cosine of two
    unit vectors is at most the product of the norms of what the two have in their common buckets (Cauchy-Schwarz), and the number
    of these bounds both norms (:func:`steps_met`).

    Indexed prefix: ``terms`` with their weights ``ws``, as long as the norm ``reach`` of the vector from there on is more than
    ``ksim``; ``rest`` is the norm after the term. These three are floats.

    ``sigs``: vectors with most of their terms in common share one of them most likely."""
    made = vectors.withColumn("ws", unit_weights()).withColumn("p", _profile(ksim)(F.transform("terms", lambda t: F.xxhash64(t)), F.col("ws")))
    indexed = lambda c: F.slice(c, F.lit(1), F.size("p.reach"))
    return made.select("id", "p.bits", "p.needs", "p.sigs", indexed("terms").alias("terms"),
                       indexed("ws").cast("array<float>").alias("ws"), "p.reach", "p.rest")


def _profile(ksim: float):
    @F.pandas_udf("bits array<long>, needs array<short>, reach array<float>, rest array<float>, sigs array<long>")
    def profile(hashes: pd.Series, ws: pd.Series) -> pd.DataFrame:
        parts = [_profiled(hashes[i:i + PROFILED_ROWS], ws[i:i + PROFILED_ROWS], ksim) for i in range(0, len(ws), PROFILED_ROWS)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["bits", "needs", "reach", "rest", "sigs"])
    return profile


def _profiled(hashes: pd.Series, ws: pd.Series, ksim: float) -> pd.DataFrame:
    n = [len(w) for w in ws]
    ends = np.cumsum(n)
    starts = ends - n
    row = np.repeat(np.arange(len(n)), n)
    keys = np.concatenate(hashes.to_list()).astype(np.int64).view(np.uint64)
    sq = np.concatenate(ws.to_list()).astype(float) ** 2
    buckets = 64 * SKETCH_WORDS
    masses = np.zeros((len(n), buckets))
    np.add.at(masses, (row, (keys % np.uint64(buckets)).astype(np.int64)), sq)
    bits = np.packbits(masses > 0, axis=1, bitorder="little").view("<i8")
    held = np.cumsum(-np.sort(-masses, axis=1), axis=1)
    levels = ksim ** (2 - 2 * np.arange(MASS_STEPS) / MASS_STEPS) - _EPS
    needs = np.stack([(held <= level).sum(axis=1) + 1 for level in levels], axis=1).astype(np.int16)
    run = np.cumsum(sq)
    run -= np.repeat(run[starts] - sq[starts], n)
    after = np.maximum(np.repeat(run[ends - 1], n) - run, 0.0)
    size = np.add.reduceat(after + sq > ksim * ksim - _EPS, starts, dtype=np.int64)
    reach, rest = np.sqrt(after + sq).astype(np.float32), np.sqrt(after).astype(np.float32)
    cut = lambda x: [x[s:s + k] for s, k in zip(starts, size, strict=True)]
    least = [np.minimum.reduceat(_mixed(keys, j), starts) for j in range(2 * SIGNATURES)]
    sigs = np.stack([_mixed(least[2 * j] + _mixed(least[2 * j + 1], j), j) for j in range(SIGNATURES)], axis=1).view(np.int64)
    return pd.DataFrame({"bits": list(bits), "needs": list(needs), "reach": cut(reach), "rest": cut(rest), "sigs": list(sigs)})


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of hashes for each seed."""
    x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def common_buckets(bits_a: Column, bits_b: Column) -> Column:
    return sum((F.bit_count(bits_a[j].bitwiseAND(bits_b[j])) for j in range(SKETCH_WORDS)), F.lit(0))


def steps_met(common: Column, needs_a: Column, needs_b: Column) -> Column:
    """How many of two vectors' ``needs`` a number of common buckets meets. With ``j`` of its own met, a vector has at most
    ``ksim^(2 - 2j / MASS_STEPS)`` of its squared norm there, so two vectors with ``cos > ksim`` meet more than ``MASS_STEPS``."""
    return sum(((n[j] <= common).cast("int") for n in (needs_a, needs_b) for j in range(MASS_STEPS)), F.lit(0))


def cosine_pairs(vectors: DataFrame, ksim: float) -> DataFrame:
    """All pairs ``a < b`` with ``cos(a, b) > ksim`` -> (a, b, cos).

    ``vectors``: (id, term, df, w), unit-norm per id, ``df`` a global term order, or the rows of :func:`packed`.

    Candidates come from the prefix join. The first term that two vectors share bounds their cosine by the product of what is left
    of both from there on (``reach``), so rows of the join whose product is no more than ``ksim`` go: they are the last ones of a
    pair, or all of them. What is left of a pair is every shared term up to some ``t*``, so its sum is the partial dot
    product ``S`` over them; the rest is at most ``rest_a(t*) * rest_b(t*)``
    (Cauchy-Schwarz). Candidates with ``S + rest_a * rest_b <= ksim`` are pruned, and the others are verified with the
    full dot product."""
    vectors = _stored(vectors)
    profiled = cut_to_parquet(profiles(vectors, ksim), "profiles")
    return similar_pairs(vectors, profiled, profiled, ksim)


def _stored(vectors: DataFrame) -> DataFrame:
    return packed(vectors) if "terms" in vectors.columns else cut_to_parquet(packed(vectors), "packed")


def similar_pairs(vectors: DataFrame, left: DataFrame, right: DataFrame, ksim: float, among: DataFrame | None = None) -> DataFrame:
    """The pairs ``a < b`` with ``cos(a, b) > ksim`` whose ``a`` is in ``left`` and whose ``b`` is in ``right``, both of them
    rows of :func:`profiles`. ``among``, for a smaller ``right``: the distinct ids that ``a`` may have; only terms that
    ``right`` may have are shuffled."""
    lefts, rights = _postings(left, "a"), _postings(right, "b")
    if among is not None:
        # an inner join: a semi join would be moved below the choice of terms
        lefts = _possible(lefts, rights).join(among.select(F.col("id").alias("a")), "a")
    common = common_buckets(F.col("bitsa"), F.col("bitsb"))
    met = lefts.join(rights, "term").where(
        (F.col("a") < F.col("b")) & (F.col("reacha") * F.col("reachb") > F.lit(ksim - _SLACK))
        & (common >= F.greatest(F.col("needsa")[0], F.col("needsb")[0])))
    # the rests shrink along the order: their least product is that of the last shared term; all steps are counted for what has
    # passed the first one
    cand = (met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"), F.min(F.col("resta") * F.col("restb")).alias("tail"),
                                      F.max(steps_met(common, F.col("needsa"), F.col("needsb"))).alias("steps"))
            .filter((F.col("s") + F.col("tail") > F.lit(ksim - _SLACK)) & (F.col("steps") > MASS_STEPS)))
    return dot_products(cut_to_parquet(cand.select("a", "b"), "candidates"), vectors).filter(F.col("cos") > F.lit(ksim))


def _postings(rows: DataFrame, n: str) -> DataFrame:
    """A row for each indexed term of ``rows``, its columns but the term named for the side ``n``."""
    entry = F.arrays_zip(F.col("terms").alias("term"), "ws", "reach", "rest")
    # named after the arrays are opened: both sides of a join with itself are one shuffle
    return rows.select("id", "needs", "bits", F.inline(entry)).select(
        "term", F.col("id").alias(n), F.col("ws").alias(f"w{n}"), *[F.col(c).alias(c + n) for c in ("reach", "rest", "needs", "bits")])


#: Words of 64 bits of the set of terms that is sent to every task, at most.
TERM_WORDS = 1 << 20


def _possible(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows but for some whose term none of ``others`` has, by a set of hashes whose size is bounded."""
    key = F.pmod(F.xxhash64("term"), F.lit(64 * TERM_WORDS))
    at = lambda d: d.withColumn("word", F.expr("shiftright(key, 6)")).withColumn("bit", F.expr("cast(key % 64 as int)"))
    words = at(others.select(key.alias("key"))).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))
    words = cut_to_parquet(words, "terms")
    return at(rows.withColumn("key", key)).join(F.broadcast(words), "word").filter(F.expr("bit_get(set, bit) = 1")).select(*rows.columns)


#: Pairs that are verified together, about.
CELL_PAIRS = 4096


def dot_products(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cos) of distinct pairs (a, b), verified in cells of pairs. A vector goes once to every cell that has a pair of it, not
    once to every pair: m similar rows have up to m * m pairs. So pairs of one family are put together: a row's family
    is named by its smallest neighbour, and pairs of the same two families make a cell, or, if they are many, a square of cells
    that rows are dealt to by their ids. Small cells share a task's group."""
    cells = max(1, math.ceil(pairs.count() / CELL_PAIRS))
    family = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("family"))
    named = pairs.join(family.select(F.col("id").alias("a"), F.col("family").alias("fa")), "a", "left").join(
        family.select(F.col("id").alias("b"), F.col("family").alias("fb")), "b").withColumn("fa", F.coalesce("fa", "a"))
    named = cut_to_parquet(named, "families")
    # at most one row for each CELL_PAIRS pairs
    large = named.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_PAIRS)
    sides = F.coalesce(F.ceil(F.sqrt(F.col("n") / CELL_PAIRS)), F.lit(1).cast("long"))
    dealt = lambda c: F.pmod(F.xxhash64(c), sides)
    celled = cut_to_parquet(named.join(F.broadcast(large), ["fa", "fb"], "left").select(
        F.pmod(F.xxhash64("fa", "fb", dealt("a"), dealt("b")), F.lit(cells)).alias("cell"), "a", "b"), "cells")
    wanted = cut_to_parquet(celled.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    ids = cut_to_parquet(wanted.select("id").distinct(), "wanted")
    rows = packed(vectors).join(ids, "id", "left_semi").select("id", "terms", unit_weights().alias("ws"))
    rows = rows.join(wanted, "id").select(F.col("cell").alias("of"), "id", "terms", "ws")
    return celled.groupBy("cell").cogroup(rows.groupBy("of")).applyInPandas(_cell_dots, "a long, b long, cos double")


def _cell_dots(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if pairs.empty or rows.empty:
        return pd.DataFrame({"a": [], "b": [], "cos": []}).astype({"a": "int64", "b": "int64", "cos": "float64"})
    ends = np.cumsum([len(t) for t in rows["terms"]])
    codes, known = pd.factorize(np.concatenate(rows["terms"].to_list()))
    vector = dict(zip(rows["id"], zip(np.split(codes, ends[:-1]), rows["ws"], strict=True), strict=True))
    pairs = pairs[pairs["a"].isin(vector) & pairs["b"].isin(vector)].sort_values("a")
    dense, cos, spread = np.zeros(len(known)), [], None
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        if a != spread:
            dense[:] = 0.0
            np.add.at(dense, *vector[a])
            spread = a
        at, w = vector[b]
        cos.append(float(dense[at] @ w))
    return pairs[["a", "b"]].assign(cos=np.asarray(cos, dtype="float64"))


def pivot_links(vectors: DataFrame, ksim: float, profiled: DataFrame) -> DataFrame:
    """(a, b) of rows ``b`` that are similar to the smallest row with one of their signatures: a family of near copies mostly meets its
    first row here, a pair for each signature. Which rows are found is chance; nothing but the cost depends on it."""
    signed = profiled.select("id", F.explode("sigs").alias("sig"))
    first = signed.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").drop("last")
    pairs = signed.join(first, "sig").filter("a < id").select("a", F.col("id").alias("b")).distinct()
    for n in "ab":
        pairs = pairs.join(profiled.select(F.col("id").alias(n), F.col("bits").alias(f"bits{n}"), F.col("needs").alias(f"needs{n}")), n)
    steps = steps_met(common_buckets(F.col("bitsa"), F.col("bitsb")), F.col("needsa"), F.col("needsb"))
    pairs = pairs.filter(steps > MASS_STEPS).select("a", "b")
    return dot_products(cut_to_parquet(pairs, "near"), vectors).filter(F.col("cos") > F.lit(ksim)).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def greedy_leaders(vectors: DataFrame, ksim: float) -> DataFrame:
    """A5 from vectors as :func:`cosine_pairs` takes them: (id, leader) of every row, as :func:`leader_clusters` over all pairs gives it, but
    without all pairs.

    A row leads unless it is similar to a smaller row that leads. Rows that :func:`pivot_links` finds similar to a
    pivot need no other pair as long as the pivot leads; only the others are paired with all smaller rows.
    What that settles (:func:`_settle`) leaves rows whose pivot follows another row, and rows that
    depend on these; they are paired with the smaller rows that may lead, and settled. Rows that follow a
    pivot are then paired with the leaders before it. So a family of m near copies costs about m pairs with its
    leader, not m * m."""
    vectors = _stored(vectors)
    pref = cut_to_parquet(profiles(vectors, ksim), "profiles")
    ids = pref.select("id")
    linked = cut_to_parquet(pivot_links(vectors, ksim, pref), "pivots")
    whole = similar_pairs(vectors, pref, pref.join(linked.select(F.col("b").alias("id")), "id", "left_anti"), ksim)
    edges = cut_to_parquet(whole.select("a", "b", F.lit(True).alias("complete")).unionByName(linked.withColumn("complete", F.lit(False))), "edges")
    state = _settle(ids, edges)
    open_rows = state.filter("leads IS NULL").select("id")
    if not open_rows.isEmpty():
        may_lead = state.filter("leads IS DISTINCT FROM false")
        again = cut_to_parquet(open_rows.join(linked.select(F.col("b").alias("id")), "id", "left_semi"), "again")
        more = similar_pairs(vectors, pref, pref.join(again, "id", "left_semi"), ksim, may_lead).select("a", "b", F.lit(True).alias("complete"))
        edges = cut_to_parquet(edges.join(again.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "complete").unionByName(more), "edges")
        state = _settle(ids, edges, state)
    leads = state.filter("leads").select(F.col("id").alias("a"))
    by_edge = edges.join(leads, "a", "left_semi")
    # a pivot that leads need not be the first leader that is similar
    pivoted = cut_to_parquet(by_edge.filter("NOT complete").select("a", "b"), "pivoted")
    before = similar_pairs(vectors, pref, pref.join(pivoted.select(F.col("b").alias("id")), "id", "left_semi"), ksim,
                           leads.withColumnRenamed("a", "id")).select("a", "b")
    led = by_edge.select("a", "b").unionByName(before).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return ids.join(led, "id", "left").withColumn("leader", F.coalesce("leader", "id"))


def _settle(ids: DataFrame, edges: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(id, leads) as far as edges (a, b, complete) tell: a row follows if one of its smaller neighbours leads, and leads if
    its edges are complete and none does. A row with complete edges and one undecided neighbour is the
    opposite of that neighbour; such rows are chains, whose links are doubled until each points to a row that is
    none, so a chain takes as many rounds as the logarithm of its length."""
    if state is None:
        state = ids.withColumn("leads", F.lit(None).cast("boolean"))
    left = None
    while True:
        of_a = state.select(F.col("id").alias("a"), F.col("leads").alias("la"))
        seen = (edges.join(of_a, "a").groupBy(F.col("b").alias("id"))
                .agg(F.bool_or(F.coalesce("la", F.lit(False))).alias("led"), F.count_if(F.col("la").isNull()).alias("n_open"),
                     F.min(F.when(F.col("la").isNull(), F.col("a"))).alias("up"), F.bool_and("complete").alias("complete")))
        now = (F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), F.lit(False))
               .when(F.coalesce("n_open", F.lit(0)) == 0, F.when(F.coalesce("complete", F.lit(True)), F.lit(True))))
        link = now.isNull() & F.col("complete") & (F.col("n_open") == 1)
        state = cut_to_parquet(state.join(seen, "id", "left").select("id", now.alias("leads"), F.when(link, F.col("up")).alias("up"),
                                                                      link.alias("flip")), "settled")
        state = cut_to_parquet(_ends_of_chains(state), "settled")
        undecided = state.filter("leads IS NULL").count()
        if undecided == 0 or undecided == left:
            return state
        left = undecided


def _ends_of_chains(state: DataFrame) -> DataFrame:
    """(id, leads) of (id, leads, up, flip): a row with ``up`` is like it, or its opposite with ``flip``."""
    while True:
        above = state.select(F.col("id").alias("up"), F.col("leads").alias("ul"), F.col("up").alias("uu"), F.col("flip").alias("uf"))
        links = state.filter("up IS NOT NULL").join(above, "up")
        links = links.select("id", (F.col("ul") != F.col("flip")).alias("leads"), F.col("uu").alias("up"),
                             F.when(F.col("uu").isNotNull(), F.col("flip") != F.col("uf")).alias("flip"))
        if links.isEmpty():
            return state.select("id", "leads")
        # what points to a row that is no link is decided with it, or left
        state = cut_to_parquet(state.filter("up IS NULL").unionByName(links), "chains")


def leader_clusters(pairs: DataFrame) -> DataFrame:
    """A5 over the nodes that have at least one pair: rows in ``id`` order; an
    unassigned row leads and takes every still-unassigned row it is similar to.

    Rounds: for every undecided ``b``, ``ml`` is its smallest neighbour ``a < b`` that
    leads and ``mu`` its smallest undecided neighbour ``a < b``. ``b`` follows ``ml``
    when ``ml`` exists and precedes ``mu``; with neither, ``b`` leads. Each round
    decides at least the smallest undecided node; edges into decided nodes and out of
    followers are dropped, so the graph shrinks. Lineage is cut by a reliable checkpoint
    every round. Returns (id, leader)."""
    # the pair join runs once: edges are materialised first, nodes derive from them
    edges = cut_lineage(pairs.select("a", "b"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    state = cut_lineage(nodes.withColumn("leader", F.lit(None).cast("long")))
    while True:
        st_a = state.select(F.col("id").alias("a"), F.col("leader").alias("la"))
        agg = (edges.join(st_a, "a")
               .groupBy("b")
               .agg(F.min(F.when(F.col("la") == F.col("a"), F.col("a"))).alias("ml"),
                    F.min(F.when(F.col("la").isNull(), F.col("a"))).alias("mu")))
        decided = (F.when(F.col("leader").isNotNull(), F.col("leader"))
                   .when(F.col("ml").isNotNull() & (F.col("mu").isNull() | (F.col("ml") < F.col("mu"))),
                         F.col("ml"))
                   .when(F.col("ml").isNull() & F.col("mu").isNull(), F.col("id")))
        new_state = (state.join(agg, state["id"] == agg["b"], "left")
                     .select("id", decided.alias("leader")))
        new_state = cut_lineage(new_state)
        undecided = new_state.filter(F.col("leader").isNull())
        n_left = undecided.count()
        state = new_state
        if n_left == 0:
            break
        followers = new_state.filter(F.col("leader") != F.col("id")).select(F.col("id").alias("a"))
        edges = cut_lineage(
            edges.join(undecided.select(F.col("id").alias("b")), "b", "left_semi")
            .join(followers, "a", "left_anti"))
    return state


def assign_leaders(nodes: DataFrame, pairs: DataFrame, zero_ids: DataFrame | None = None,
                   zero_one_group: bool = False) -> DataFrame:
    """(idx, leader) for every node: clustered nodes from :func:`leader_clusters`, the
    rest lead themselves. With ``zero_one_group`` the ids in ``zero_ids`` (zero
    vectors) share the group id -1, as in the monitored job; by default each is its own
    group."""
    led = leader_clusters(pairs)
    out = (nodes.select("idx").join(led.withColumnRenamed("id", "idx"), "idx", "left")
           .withColumn("leader", F.coalesce(F.col("leader"), F.col("idx"))))
    if zero_one_group and zero_ids is not None:
        z = zero_ids.select(F.col("idx"), F.lit(True).alias("_zero"))
        out = (out.join(z, "idx", "left")
               .withColumn("leader", F.when(F.col("_zero"), F.lit(-1).cast("long")).otherwise(F.col("leader")))
               .drop("_zero"))
    return out


def dup_groups(members: DataFrame) -> DataFrame:
    """A3 + A4: per leader: max probability, size and the singleton flag.
    ``members``: (idx, leader, prob). Members are never collected into one row: the
    digest joins the group keys back to its members."""
    return (members.groupBy("leader")
            .agg(F.max("prob").alias("max_prob"), F.count(F.lit(1)).alias("n_members"))
            .withColumn("is_single", F.col("n_members") == 1))


def dup_stats(assign: DataFrame) -> DataFrame:
    """Texts, unique groups, duplicates."""
    return (assign.agg(F.count(F.lit(1)).alias("n_texts"),
                       F.countDistinct("leader").alias("n_unique"))
            .withColumn("n_duplicates", F.col("n_texts") - F.col("n_unique")))
