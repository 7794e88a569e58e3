"""Spelling variants by bit-sliced position indexes.

Words are near if they differ by exactly one inserted, deleted or replaced code point. A block of words of one
length has, for each position and letter, a bitset of the words with that letter there. A query's letters
are read one by one; two recurrences over whole bitsets (64 words at a time) follow the words that
agree so far (no error) and those with one error so far: replaced, where word and query stay in step, or
inserted, where the word is read one position further on. What is set at the end is near.

Words of n letters are looked up among words of n and of n + 1 letters. Two near words, the longer of m letters,
share their first or their last m / 2 letters, since one error leaves one of them whole; so words are dealt
by a hash of (m, first half) and of (m, last half) into buckets of about ``BLOCK`` words, and queries only meet
the words of their own two buckets. A bucket that is larger, because many words share a half, is
dealt into several blocks, and every block of its queries meets each of them. A pair is given by the
bucket of its first halves, and by that of its last halves only if the first ones differ, hence once.

Defined results of ``variants``: a word's form is its near word of largest count, ties to the smallest in code-point
order, if that count is at least ``RATIO`` times its own; the root is reached by following forms; null
words go, words that repeat have their counts added; an empty table gives an empty result. Of ``words_of``: null
texts have no words, a null id is written as nothing; runs are as long as they are; rows that repeat count
as often as they are there; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import renewed

#: Words of a block, on average and at most on average; long words come in smaller blocks.
BLOCK, BLOCK_LETTERS = 4096, 1 << 22
#: Queries that are followed at once.
SLICE = 512
#: Fixed values of the task: letters, shortest word, fewest occurrences, form's count to the word's, one in so many runs is misspelt.
RUN, SHORTEST, FEWEST, RATIO, MISSPELT = "[A-Za-zÀ-ÿ]+", 5, 3, 2, 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letters(words: list[str], n: int) -> np.ndarray:
    """Words of n code points as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)


class Index:
    """Bitsets of a block of words of one length, [position][letter], bit j of which is word j."""

    def __init__(self, words: np.ndarray, alphabet: np.ndarray):
        n, self.length = words.shape
        self.alphabet, self.size = alphabet, -(-n // 64)
        self.words = np.searchsorted(alphabet, words)
        self.place, self.bit = np.arange(n) // 64, np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.all = np.zeros(self.size, np.uint64)
        np.bitwise_or.at(self.all, self.place, self.bit)

    def at(self, position: int) -> np.ndarray:
        """The bitsets of a position, a row for each letter."""
        sets = np.zeros((len(self.alphabet), self.size), np.uint64)
        np.bitwise_or.at(sets, (self.words[:, position], self.place), self.bit)
        return sets

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all near pairs; queries have as many letters as the words, or one fewer."""
        q = np.searchsorted(self.alphabet, queries)
        shifted = q.shape[1] < self.length
        agree = np.broadcast_to(self.all, (len(q), self.size)).copy()
        error = np.zeros_like(agree)
        now = self.at(0)
        for i in range(q.shape[1]):
            if shifted:
                after = self.at(i + 1)
                error = (error | agree) & after[q[:, i]]
                agree &= now[q[:, i]]
                now = after
            else:
                there = now[q[:, i]]
                error = (error & there) | (agree & ~there)
                agree &= there
                now = self.at(i + 1) if i + 1 < self.length else now
            if not (agree.any() or error.any()):
                break
        if shifted:
            error |= agree  # the letter more is the last
        at, word = np.nonzero(error)
        bits = np.unpackbits(error[at, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return at[hit], word[hit] * 64 + bit


def _cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """Near pairs of a block of words and a block of queries of one bucket: both directions of each."""
    names = ["word", "n", "other", "n_other"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns: list[list] = [[], [], [], []]
    if left.num_rows and right.num_rows:
        length, side = left.column("m")[0].as_py(), left.column("side")[0].as_py()
        half = length // 2
        words, counts = left.column("word").to_pylist(), left.column("n").to_pylist()
        own = letters(words, length)
        asked: dict[int, list[int]] = {length: [], length - 1: []}
        for i, n in enumerate(right.column("size").to_pylist()):
            asked[n].append(i)
        queries, query_counts = right.column("word").to_pylist(), right.column("n").to_pylist()
        matrices = {n: letters([queries[i] for i in at], n) for n, at in asked.items() if at}
        index = Index(own, np.unique(np.concatenate([own.ravel(), *(x.ravel() for x in matrices.values())])))
        for n, x in matrices.items():
            for low in range(0, len(x), SLICE):
                part = x[low:low + SLICE]
                q, w = index.near(part)
                first = (part[q, :half] == own[w, :half]).all(axis=1)
                last = (part[q, n - half:] == own[w, length - half:]).all(axis=1)
                keep = first if side == 0 else last & ~first
                for i, j in zip((q[keep] + low).tolist(), w[keep].tolist()):
                    pair = queries[asked[n][i]], query_counts[asked[n][i]], words[j], counts[j]
                    # words of one length are queries of each other
                    for row in (pair,) if n == length else (pair, (*pair[2:], *pair[:2])):
                        for column, value in zip(columns, row):
                            column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _halves(words: DataFrame) -> DataFrame:
    """A row for each side: 0 with the first half of words of m letters, 1 with the last."""
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")),
                    F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - half + 1, half).alias("half")))
    return words.withColumn("s", F.explode(sides)).select("word", "n", "size", "m", "s.side", "s.half")


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word, n), distinct, to (word, n, other, n_other): every near pair in both directions."""
    sized = words.select("word", "n", F.length("word").alias("size")).filter("size > 0")
    lengths = cut(sized.groupBy(F.col("size").alias("m")).agg(F.count(F.lit(1)).alias("words")), "lengths")
    buckets = lengths.select("m", F.ceil(F.col("words") / _most(F.col("m"))).alias("buckets"))

    def dealt(rows: DataFrame) -> DataFrame:
        return (_halves(rows).join(buckets, "m")
                .withColumn("bucket", F.pmod(F.xxhash64("side", "half"), F.col("buckets"))).drop("half", "buckets"))

    own = cut(dealt(sized.withColumn("m", F.col("size"))), "dealt-words")
    asking = cut(dealt(sized.withColumn("m", F.explode(F.array(F.col("size"), F.col("size") + 1)))), "dealt-queries")
    at = ["m", "side", "bucket"]
    blocks = lambda rows, name: rows.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / _most(F.col("m"))).cast("int").alias(name))
    # a row for each bucket
    grid = cut(blocks(own, "down").join(blocks(asking, "across"), at), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, salt: F.pmod(F.xxhash64("word", F.lit(salt)), F.col(n)).cast("int")
    left = own.join(grid, at).withColumn("v", one("down", 1)).withColumn("q", every("across"))
    right = renewed(asking.join(grid, at).withColumn("q", one("across", 2)).withColumn("v", every("down")))
    key = [*at, "v", "q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_cell, "word string, n long, other string, n_other long")


def _most(length: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_LETTERS) / length)))


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """counts (word, n) to word, n, form, root, n_near, form_n."""
    words = cut(counts.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = F.min(F.struct((-F.col("n_other")).alias("k"), F.col("other").alias("w")))
    near = cut(near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    is_form = -F.col("best.k") >= ratio * F.col("n")
    forms = cut(words.join(near, "word", "left").select(
        "word", "n", F.when(is_form, F.col("best.w")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.k")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: steps are doubled until all have ended. Counts grow by
    the ratio with each form, so chains, and the rounds even more, are short."""
    links = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def words_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (word, n): runs of letters with A-Z lower-cased, one in ``MISSPELT`` of them short of a letter by
    a checksum of id and run; those of ``SHORTEST`` letters and ``FEWEST`` occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() would turn accented letters too
    lower = F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    marked = runs.select(F.col("id"), lower.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % MISSPELT == 0, less).otherwise(F.col("run"))
    return (marked.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words_of(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT i::BIGINT AS i FROM range(256) r(i))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
           lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]))) AS h
  FROM kinds, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shapes AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS shape FROM cuts),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS n_other FROM shapes a JOIN shapes b ON a.shape = b.shape AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shapes s JOIN words w ON s.shape = w.word
  UNION SELECT w.word, s.word, s.n FROM shapes s JOIN words w ON s.shape = w.word),
best AS (SELECT word, count(*) AS n_near, min({'k': -n_other, 'w': other}) AS b FROM pairs GROUP BY word),
forms AS (
  SELECT word, n, CASE WHEN -b.k >= 2 * n THEN b.w END AS form, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.k >= 2 * n THEN -b.k END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM forms UNION ALL SELECT up.word, form FROM up JOIN forms ON forms.word = root WHERE form IS NOT NULL)
SELECT f.word, n, form, root, n_near, form_n
FROM forms f JOIN (SELECT u.word, u.root FROM up u JOIN forms g ON g.word = u.root WHERE g.form IS NULL) r ON r.word = f.word
"""
