"""Exact dedup (op3) and sharding (op4)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from newsdigest.llm import exact_dedup, sharding
from newsdigest.llm.common import shared_path, table

from .conftest import edge_rows, rows


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_matches_brute_force_and_its_index_persists(spark, edge):
    path = shared_path(spark, "index")
    found = rows(exact_dedup.DigestIndex(spark, path, 4).dedup(edge))
    groups = defaultdict(list)
    for r in edge_rows():
        groups[plain(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == want
    # a second batch: what the index has goes, whatever its id, and new texts are appended
    again = exact_dedup.DigestIndex(spark, path, 4)
    before = again.read().count()
    batch = spark.createDataFrame([(-5, edge_rows()[0][1]), (900, "quite new"), (901, "quite \n new")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows(again.dedup(batch))}
    assert got == {-5: (0, False), 900: (900, True), 901: (900, False)}
    assert again.read().count() == before + 1


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_in_ranges_equals_one_batch(spark, edge, batches):
    """Later ranges meet the earlier ones in the index: texts that come again in each range, and rows without an id."""
    again = spark.createDataFrame([(2000 + i, f"again {i % 7}") for i in range(60)] + [(None, "again 1"), (None, "only here")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(again)
    flat = lambda df: Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(df))
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "index"), 4)
    assert flat(index.dedup_in_ranges(docs, batches)) == flat(exact_dedup.DigestIndex(spark, shared_path(spark, "index"), 4).dedup(docs))
    assert index.read().count() == index.read().distinct().count() == len({plain(r["text"]) for r in docs.collect()})


def test_exact_dedup_of_an_empty_table(spark, empty):
    assert exact_dedup.DigestIndex(spark, shared_path(spark, "index"), 4).dedup(empty).count() == 0
    assert exact_dedup.DigestIndex(spark, shared_path(spark, "index"), 4).dedup_in_ranges(empty, 3).count() == 0


def check_shards(found, texts, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    places = defaultdict(list)
    for r in found:
        places[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_hold_every_row_and_are_even(spark, edge, sf):
    check_shards(rows(sharding.shard(edge)), [r[:2] for r in edge_rows()], 24)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = rows(sharding.shard(docs))
    check_shards(found, [(r.doc_id, r.text) for r in docs.collect()], 24)
    load = Counter()
    for r in found:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.02 * min(load.values())
    assert Counter(map(str, found)) == Counter(map(str, rows(sharding.shard(docs))))  # reruns agree


def test_an_id_with_a_third_of_all_rows(spark, sf):
    for hot in (7, None):
        docs = [(i, "x" * (i % 50)) for i in range(2000)] + [(hot, "same text")] * 600 + [(hot, f"other {i}") for i in range(400)]
        found = rows(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
        check_shards(found, docs, 24)
        load = Counter()
        for r in found:
            load[r["shard"]] += r["size"]
        assert max(load.values()) <= 1.1 * min(load.values())


def test_sharding_of_an_empty_table(empty):
    assert sharding.shard(empty).count() == 0


def test_rebalancing_moves_few_slots(spark):
    stats = {v: (100 + v % 7, 1) for v in range(512)}
    one = sharding.build_map(stats, 8, 512)
    assert set(one) == set(range(512)) and set(one.values()) == set(range(8))
    stats |= {v: (3 * stats[v][0], 1) for v in range(512) if one[v] == 3}  # a shard has grown
    two = sharding.rebalance(one, stats, 8)
    load = [sum(stats[v][0] for v in two if two[v] == s) for s in range(8)]
    assert max(load) <= 1.03 * min(load)
    assert sum(one[v] != two[v] for v in one) < 64
    more = sharding.rebalance(two, stats, 9)
    assert sum(two[v] != more[v] for v in two) <= 512 // 8 and set(more.values()) == set(range(9))
    fewer = sharding.rebalance(more, stats, 5)
    assert set(fewer.values()) == set(range(5))
    versions = sharding.SlotMap(spark, shared_path(spark, "map"))
    versions.store(1, one, stats)
    assert {r.vslot: r.shard for r in versions.store(2, two, stats).collect()} == two
    assert {r.vslot: r.shard for r in versions.read(1).collect()} == one


@pytest.mark.parametrize("slots", [1, 24, 8192])
def test_any_number_of_slots(edge, slots):
    found = rows(sharding.shard(edge, 4, slots))
    assert len(found) == len(edge_rows())
