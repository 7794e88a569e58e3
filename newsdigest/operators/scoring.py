"""TF-IDF vectors, a linear (logistic) model as a table, scores and thresholds
(M1, M2, M3, F8-F10, P18).

Vectors are exploded ``(id, term, w)`` rows rather than ML vectors: the scorer is
then a join and a grouped sum that Catalyst plans like any other aggregate, the
idf/weight tables are joined (AQE broadcasts them only when their runtime size is under
the broadcast threshold, otherwise it shuffles), and every step has an SQL twin.

TF-IDF follows the common smooth definition: ``idf = ln((1 + n) / (1 + df)) + 1``,
``w = tf * idf``, L2-normalised per document, so a dot product is a cosine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import vector_terms
from ..session import cut_to_parquet


def doc_terms(df: DataFrame, id_col: str = "id", cleaned_col: str = "cleaned") -> DataFrame:
    """(id, term, tf) from cleaned texts. Texts are dealt by id, and their terms are counted there: a text is
    smaller than the rows of its terms."""
    return (df.select(F.col(id_col).alias("id"), F.col(cleaned_col).alias("cleaned")).repartition("id")
            .select("id", F.explode(vector_terms(F.col("cleaned"))).alias("term"))
            .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


#: tokens a default TF-IDF vectoriser sees in raw text: runs of two or more word characters
RAW_TOKEN = "[\\p{L}\\p{N}_]{2,}"


def raw_tokens(text_col: str = "text"):
    """The v1 vectoriser's tokens: lower-cased word runs."""
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(RAW_TOKEN), 0)


def token_counts(df: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(id, term, tf) from arrays of tokens."""
    return (df.select(F.col(id_col).alias("id"), F.explode(tokens_col).alias("term"))
            .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


def doc_terms_raw(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf) from raw text, the v1 vectoriser input."""
    return token_counts(df.select(id_col, text_col).repartition(id_col).select(id_col, raw_tokens(text_col).alias("tokens")), id_col)


def fit_idf(terms: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(term, df, idf) fitted on a corpus of ``(id, term, tf)`` rows."""
    if n_docs is None:
        n_docs = terms.select("id").distinct().count()
    return (terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("idf", F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)) + 1.0))


def tfidf_vectors(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """M1: (id, term, df, w) with ``w`` L2-normalised per id; terms outside the
    fitted vocabulary are dropped (inner join), as a fitted vectoriser ignores them."""
    raw = terms.join(idf.select("term", "df", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "df", (F.col("raw") / norm).alias("w"))


#: Terms whose idf and weight are sent to every task, at most: those of the most documents.
COMMON_TERMS = 1 << 16


def bags(terms: DataFrame) -> DataFrame:
    """(id, terms, tfs) of (id, term, tf): one row per id."""
    return (terms.groupBy("id").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("e"))
            .select("id", F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs")))


def bag_terms(packed: DataFrame) -> DataFrame:
    """(id, term, tf) of :func:`bags`."""
    return packed.select("id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def packed_vectors(packed: DataFrame, idf: DataFrame, weights: DataFrame) -> DataFrame:
    """M1, one row per id of :func:`bags`: (id, terms, dfs, raws, norm, dot), the terms in the order of ``df``, then term. ``raws / norm``
    are the weights of :func:`tfidf_vectors` and ``dot`` is the sum of :func:`lr_score`.

    The terms of most documents, a bounded number, are sent to every task, so most rows meet their idf where their id
    is; only rows of rarer terms are dealt by term and back."""
    model = cut_to_parquet(idf.select("term", "df", "idf").join(weights.select("term", "weight"), "term", "left"), "model")
    common = cut_to_parquet(model.orderBy(F.desc("df"), "term").limit(COMMON_TERMS), "common")
    raw = F.col("tf") * F.col("idf")

    def per_id(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("id").agg(F.collect_list(F.struct("df", "term", raw.alias("raw"))).alias(side), F.sum(raw * raw).alias(f"{side}_square"),
                                      F.sum(raw * F.coalesce("weight", F.lit(0.0))).alias(f"{side}_dot"))

    # no term holds a space; one string is shuffled in less room than an array of strings
    dealt = (packed.select("id", F.array_join("terms", " ").alias("line"), "tfs").repartition("id")
             .select("id", F.split("line", " ").alias("terms"), "tfs"))
    own = per_id(bag_terms(dealt).join(F.broadcast(common), "term"), "own")
    rare = per_id(bag_terms(packed).join(F.broadcast(common.select("term")), "term", "left_anti").join(model, "term"), "rare")
    none = F.array().cast("array<struct<df:bigint,term:string,raw:double>>")
    both = lambda c: F.coalesce(f"own_{c}", F.lit(0.0)) + F.coalesce(f"rare_{c}", F.lit(0.0))
    rows = own.join(rare, "id", "full").select("id", F.sort_array(F.concat(F.coalesce("own", none), F.coalesce("rare", none))).alias("e"),
                                               F.sqrt(both("square")).alias("norm"), both("dot").alias("dot"))
    return rows.select("id", F.col("e.term").alias("terms"), F.col("e.df").alias("dfs"), F.col("e.raw").alias("raws"), "norm",
                       (F.col("dot") / F.col("norm")).alias("dot"))


def unpacked(vectors: DataFrame) -> DataFrame:
    """(id, term, df, w) of :func:`packed_vectors`."""
    entry = F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"), F.col("raws").alias("raw"))
    return vectors.select("id", "norm", F.inline(entry)).select("id", "term", "df", (F.col("raw") / F.col("norm")).alias("w"))


def fit_linear_model(terms: DataFrame, labels: DataFrame, label_col: str = "quality"):
    """A linear model fitted in closed form (log-count ratio with add-one smoothing):
    ``weight(t) = ln((c1+1)/(n1+2)) - ln((c0+1)/(n0+2))`` over labelled documents that
    contain ``t``, ``intercept = ln((n1+1)/(n0+1))``. Returns (weights DataFrame, intercept).

    The monitored job loads pickled weights that are not shipped; this rule gives a
    deterministic model that SQL can reproduce. ``lr_train_score`` fits Spark ML's
    logistic regression instead."""
    lab = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y"))
    counts = lab.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("n1"),
                     F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("n0")).first()
    n1, n0 = int(counts["n1"] or 0), int(counts["n0"] or 0)
    per_term = (terms.select("id", "term").join(lab, "id")
                .groupBy("term")
                .agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("c1"),
                     F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("c0")))
    weights = per_term.select(
        "term",
        (F.log((F.col("c1") + 1.0) / F.lit(n1 + 2.0)) - F.log((F.col("c0") + 1.0) / F.lit(n0 + 2.0)))
        .alias("weight"))
    intercept = math.log((n1 + 1.0) / (n0 + 1.0))
    return weights, intercept


def lr_score(ids: DataFrame, vectors: DataFrame, weights: DataFrame, intercept: float,
             id_col: str = "id") -> DataFrame:
    """M2: ``prob = 1 / (1 + exp(-(b + sum(w * weight))))`` for every id in ``ids``;
    a zero vector scores ``sigmoid(b)``. Rows of :func:`packed_vectors` bring their sums with them."""
    dots = (vectors.select("id", "dot") if "dot" in vectors.columns else
            vectors.join(weights, "term").groupBy("id").agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    out = ids.join(dots, ids[id_col] == dots["id"], "left") if id_col != "id" else ids.join(dots, "id", "left")
    z = F.lit(intercept) + F.coalesce(F.col("dot"), F.lit(0.0))
    out = out.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return out.drop("dot") if id_col == "id" else out.drop("dot", dots["id"])


def score_counts(terms: DataFrame, idf: DataFrame, weights: DataFrame, intercept: float) -> DataFrame:
    """M1 and M2 in one pass over (id, term, tf), for scores that need no vectors: (id, prob) of every id with a term of the
    fitted vocabulary, as :func:`tfidf_vectors` and :func:`lr_score` give it. The counts meet idf and weights in one
    join, and a vector's length divides its whole dot product."""
    model = idf.select("term", "idf").join(weights.select("term", "weight"), "term", "left")
    raw = terms.join(model, "term").select("id", (F.col("tf") * F.col("idf")).alias("raw"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    dots = raw.groupBy("id").agg((F.sum(F.col("raw") * F.col("weight")) / F.sqrt(F.sum(F.col("raw") * F.col("raw")))).alias("dot"))
    return dots.select("id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(intercept) + F.col("dot"))))).alias("prob"))


def nonzero_vector(ids: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """F8: keep rows whose vector has at least one in-vocabulary term (semi join)."""
    present = vectors.select(F.col("id").alias(id_col)).distinct()
    return ids.join(present, id_col, "left_semi")


def threshold_v1(df: DataFrame, t: float, prob_col: str = "prob") -> DataFrame:
    """raw probability at or above ``t``."""
    return df.filter(F.col(prob_col) >= F.lit(t))


def round_prob(prob_col: str = "prob"):
    """Half-even rounding to 3 decimals."""
    return F.bround(F.col(prob_col), 3)


def threshold_v2(df: DataFrame, t: float, prob_col: str = "prob") -> DataFrame:
    """rounded (3 decimals, half even) probability at or above ``t``."""
    return df.filter(round_prob(prob_col) >= F.lit(t))


def save_linear_model(idf: DataFrame, weights: DataFrame, intercept: float, path: str) -> None:
    """The fitted vectoriser and model as one table ``(term, df, idf, weight)`` plus
    the intercept, written under ``path`` (parquet; the intercept is a one-row table)."""
    model = idf.select("term", "df", "idf").join(weights, "term", "left") \
        .withColumn("weight", F.coalesce(F.col("weight"), F.lit(0.0)))
    model.write.mode("overwrite").parquet(f"{path}/terms")
    idf.sparkSession.createDataFrame([(float(intercept),)], "intercept double") \
        .write.mode("overwrite").parquet(f"{path}/intercept")


def load_linear_model(spark, path: str):
    """(idf DataFrame, weights DataFrame, intercept) saved by :func:`save_linear_model`."""
    terms = spark.read.parquet(f"{path}/terms")
    intercept = spark.read.parquet(f"{path}/intercept").first()["intercept"]
    return terms.select("term", "df", "idf"), terms.select("term", "weight"), intercept
