"""Tokens and spans of tokens in a lexicon table (T3, T4) of any size: they are joined to it, not looked up in a literal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_tokens(docs: DataFrame, lexicon: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """docs (id, tokens) with each token that the lexicon (form, replacement; forms unique) has replaced, in order.
    Distinct tokens are joined first, so the lexicon meets each form once and a frequent token is one
    row; a document without tokens keeps an empty array."""
    t = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(tokens_col).alias("at", "form"))
    known = t.select("form").distinct().join(lexicon.select("form", "replacement"), "form")
    out = t.join(known, "form", "left").select("id", F.when(F.col("at").isNotNull(), F.struct(
        "at", F.coalesce("replacement", "form").alias("token"))).alias("x"))
    return (out.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"]).alias("tokens"))
            .withColumnRenamed("id", id_col).withColumnRenamed("tokens", tokens_col))


def mask_spans(docs: DataFrame, gazetteer: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Docs (id, tokens; ids unique) with every token of a name replaced by the name's placeholder. The gazetteer
    (surface, replacement) has names of one or more tokens, joined by one space. Of names that overlap the one that
    begins first is taken, of those that begin together the longest; what it covers begins no other.

    Tokens that begin a name are found by a join of distinct tokens, each with the lengths of its names; only the spans of
    these lengths at these places are joined to the names. A document then chooses among its own hits. Null and
    blank surfaces are no names; of a surface that repeats the smallest replacement counts."""
    names = (gazetteer.select(F.trim(F.regexp_replace("surface", " +", " ")).alias("surface"), "replacement").filter("surface <> ''")
             .groupBy("surface").agg(F.min("replacement").alias("replacement")))
    begins = names.select(F.split("surface", " ").alias("w")).groupBy(F.col("w")[0].alias("form")).agg(F.collect_set(F.size("w")).alias("lengths"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    at = rows.select("id", F.posexplode("tokens").alias("at", "form"))
    starts = (at.join(at.select("form").distinct().join(begins, "form"), "form")
              .groupBy("id").agg(F.collect_list(F.struct("at", "lengths")).alias("starts")))
    spans = F.flatten(F.transform("starts", lambda s: F.transform(s["lengths"], lambda n: F.struct(
        s["at"].alias("at"), n.alias("n"), F.array_join(F.slice("tokens", s["at"] + 1, n), " ").alias("surface")))))
    spans = rows.join(starts, "id").select("id", F.size("tokens").alias("size"), F.explode(spans).alias("s")).filter("s.at + s.n <= size")
    hits = spans.select("id", "s.*").join(names, "surface").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("k"), "n", "replacement"))).alias("hits"))
    end = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1))["at"] + F.try_element_at(s, F.lit(-1))["n"], F.lit(0))
    none = F.expr("cast(array() as array<struct<at: int, n: int, replacement: string>>)")
    chosen = F.aggregate("hits", none, lambda s, h: F.when(
        h["at"] >= end(s), F.concat(s, F.array(F.struct(h["at"].alias("at"), h["n"].alias("n"), h["replacement"].alias("replacement"))))).otherwise(s))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(
        F.try_element_at("chosen", i)["at"] + F.try_element_at("chosen", i)["n"])
    parts = F.flatten(F.transform("chosen", lambda c, i: F.concat(
        F.slice("tokens", before(i) + 1, c["at"] - before(i)), F.array_repeat(c["replacement"], c["n"]))))
    masked = F.concat(parts, F.slice("tokens", end(F.col("chosen")) + 1, F.size("tokens") - end(F.col("chosen"))))
    out = rows.join(hits.select("id", chosen.alias("chosen")), "id", "left").select(
        "id", F.when(F.col("chosen").isNull(), F.col("tokens")).otherwise(masked).alias("tokens"))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("tokens", tokens_col)
