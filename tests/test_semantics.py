"""Section 2.11 decisions (Q5, Q7, Q8, Q12-Q14, Q16) as small truth tables."""

from pyspark.sql import functions as F

from newsdigest.config import latin_config
from newsdigest.functions import urls as U
from newsdigest.functions.text import candidate_text
from newsdigest.operators import dedup, filters, ordering


def test_q5_keywords_lowered_on_both_sides(spark):
    words = filters.normalise_words(["  Strike ", "", "MEETING"])
    assert words == ["strike", "meeting"]
    df = spark.createDataFrame([("A big STRIKE today",), ("nothing",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(filters.keyword_match(F.col("t"), words)).collect()]
    assert got == [True, False, False, False]


def test_q8_archive_prefix_and_timestamp_removed(spark):
    df = spark.createDataFrame([("https://web.archive.org/web/20220101000000id_/https://vk.com/wall-1_2",)], "u string")
    assert df.select(U.lookup_host(F.col("u"))).first()[0] == "vk.com"


def test_q12_empty_interleave_is_empty(spark):
    empty = spark.createDataFrame([], "pos long, url string")
    assert ordering.interleave_domains(empty).count() == 0


def test_q13_null_title_candidate(spark):
    df = spark.createDataFrame([(None, None)], "title string, text string")
    assert df.select(candidate_text("title", "text")).first()[0] == "\n"


def test_q14_zero_vectors_flag(spark):
    nodes = spark.range(4).withColumnRenamed("id", "idx")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    zero = spark.createDataFrame([(2,), (3,)], "idx long")
    default = {r["idx"]: r["leader"] for r in dedup.assign_leaders(nodes, pairs, zero, False).collect()}
    assert default == {0: 0, 1: 0, 2: 2, 3: 3}
    grouped = {r["idx"]: r["leader"] for r in dedup.assign_leaders(nodes, pairs, zero, True).collect()}
    assert grouped == {0: 0, 1: 0, 2: -1, 3: -1}


def test_q16_history_keeps_fixed_links_digest_shows_undone(spark):
    df = spark.createDataFrame([("https://t.me/chan/1",)], "u string")
    fixed = df.select(U.fix_messenger_link(F.col("u")).alias("f")).first()["f"]
    assert fixed == "https://t.me/s/chan/1"
    assert spark.createDataFrame([(fixed,)], "u string").select(U.undo_messenger_link(F.col("u"))).first()[0] \
        == "https://t.me/chan/1"


def test_q7_dedup_is_global(spark):
    cfg = latin_config()
    assert cfg.batch_size == 50
    df = spark.createDataFrame([(i, f"u{i}", "same text") for i in range(120)], "pos long, url string, text string")
    out = dedup.distinct_texts(df).collect()
    assert len(out) == 1 and out[0]["pos"] == 0
