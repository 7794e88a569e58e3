import os
import random
import re

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: documents with extra columns whose names the operators use themselves
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("size", "tag", "row", "found", "score", "kept", "node", "copies", "target", "vslot", "rank", "words", "mix_id")]])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def edge_texts():
    """Texts with copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(200), text(60)
    near = base.split()
    near[100] = "other"
    far = base.split()[:100] + text(100).split()
    long = text(20000)
    return [base, base, "  ".join(base.split()), " ".join(near), " ".join(far), f"{text(80)} {passage} {text(40)}",
            f"{text(30)}\n{passage}", passage, None, None, "", "", " \t\n ", "one", "one", "one two three", "a " * 50, "a " * 60,
            "\u00e9t\u00e9 \u4e2d\u6587 na\u00efve", "Released under the MIT License.", "MIT  licence; Apache\nLicense", long, long + " end",
            *[text(rng.randrange(5, 120)) for _ in range(40)]]


def edge_rows():
    texts = edge_texts()
    rows = [(i, t, None if i % 7 == 0 else "en", [None, "b", "a", "a"][i % 4], None if i % 5 == 0 else len(t or ""), *["x"] * 13)
            for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[9]]  # repeated rows
    rows += [(None, texts[4], None, None, None, *[None] * 13), (3, texts[7], "en", "a", 3, *["x"] * 13)]  # no id; an id again
    return rows


@pytest.fixture(scope="session", autouse=True)
def few_partitions(spark):
    """The tables are tiny; hundreds of small jobs need few tasks each."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    from newsdigest.session import ship_package
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ship_package(spark)
    return SF


def rows(df):
    return [r.asDict() for r in df.collect()]
