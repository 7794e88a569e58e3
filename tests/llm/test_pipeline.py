"""The pipeline and the registered queries of the subpackage."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from newsdigest.llm import mixing, quality
from newsdigest.llm.common import table
from tools.oracle_check import digest

from .conftest import alnum_words, edge_rows, rows
from .test_duplicates import brute_classes
from .test_exact_and_shards import check_shards
from .test_mixing import check


def test_registered():
    names = set(E.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("key", ["op2_substring_dedup", "op3_exact_dedup", "op5_url_filter"])
def test_matches_sql(spark, sf, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = E.queries()[key](spark, sf), con.sql(E.oracle_sql()[key])
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(want.columns, want.fetchall())[0]


def test_stages_against_plain_python(spark, sf):
    """Each stage on what its predecessor kept; run() gives the rows of the last."""
    docs = table(spark, sf, "documents")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", quality.score_column(docs, quality.train(docs, table(spark, sf, "labels"))).alias("s")).collect()}
    one = stage["quality classifier"](spark, docs, sf).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, s in scores.items() if s >= 0.5}

    two = stage["MinHash near-dedup"](spark, one, sf).cache()
    kept = {i for (i, _, _, k) in brute_classes([(r.doc_id, r.text) for r in one.collect()]) if k}
    assert two.columns == columns and Counter(r.doc_id for r in two.collect()) == Counter(kept)

    three = stage["benchmark decontamination"](spark, two, sf).cache()
    items = [f" {' '.join(alnum_words(r.text))} " for r in table(spark, sf, "benchmark").collect()]
    clean = {r.doc_id for r in two.collect() if not any(x in f" {' '.join(alnum_words(r.text))} " for x in items)}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == clean

    four = stage["mixing to target weights"](spark, three, sf).cache()
    drawn = rows(mixing.mix(three))
    check(drawn, [(r["doc_id"], r["source"], r["size"]) for r in drawn])
    assert four.columns == columns
    assert Counter(r.doc_id for r in four.collect()) == Counter({r["doc_id"]: r["copies"] for r in drawn if r["copies"]})

    five = stage["sharding"](spark, four, sf)
    check_shards(rows(five), [(r.doc_id, r.text) for r in four.collect()], 24)
    final = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, rows(final))) == sorted(map(str, rows(five)))


def test_stages_on_edge_rows_and_empty_tables(spark, edge, empty, sf):
    for docs in (edge, empty):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf).cache()
            assert now.count() <= 3 * len(edge_rows())
            if name != "sharding":
                assert now.columns == docs.columns
