import numpy as np
import pytest

from almanac.llm.mixing import MixParameters, mix, mix_quotas, mix_sizes, splitting_tree, water_fill
from almanac.llm.tokens import ByteTokenizer, token_counts

TARGETS = "mix_id int, source string, weight double, max_repeats int, total_fraction double"


def test_water_fill():
    assert water_fill({"a": 1, "b": 1}, {"a": 100, "b": 100}, 50) == {"a": 25, "b": 25}
    assert water_fill({"a": 1, "b": 1, "c": 2}, {"a": 5, "b": 100, "c": 0}, 50) == {"a": 5, "b": 45, "c": 0}
    assert water_fill({"a": 1}, {"a": 5}, 50) == {"a": 5}
    assert water_fill({"a": 0, "b": -1}, {"a": 5, "b": 5}, 50) == {"a": 0, "b": 0}


def test_splitting_tree_keeps_quotas_and_mean():
    deals = np.array([[units for _, _, units in splitting_tree([30, 10, 0, 3], 5, [1, i])] for i in range(300)])
    assert (deals.sum(1) == [30, 10, 0, 3]).all()
    sizes = deals.sum(2)
    assert sizes.max() - sizes.min() <= 1
    assert np.allclose(deals.mean(0)[:, 0], 30 * sizes.mean(0) / 43, atol=0.3)


def test_parts_of_the_tree_are_the_tree():
    whole = [(s, b.tolist(), u.tolist()) for s, b, u in splitting_tree([700, 0, 41, 5000], 100, [3])]
    parts = [(s, b.tolist(), u.tolist()) for a in range(0, 100, 7) for s, b, u in splitting_tree([700, 0, 41, 5000], 100, [3], a, min(100, a + 7))]
    assert parts == whole and [s for s, _, _ in whole] == list(range(100))
    at = np.zeros(4, int)
    for _, begins, units in whole:
        assert (at == begins).all()
        at += units
    assert at.tolist() == [700, 0, 41, 5000]


def test_shards_of_a_trillion_tokens():
    p, tokens = MixParameters(), 10**12
    shards = -(-tokens // p.shard_tokens)
    counts = [tokens // 2 // p.block_tokens, tokens // 3 // p.block_tokens, tokens // 6 // p.block_tokens, 1]
    for first in (0, shards // 2, shards - p.subtree):
        deals = [int(u.sum()) for _, _, u in splitting_tree(counts, shards, [p.seed, 1], first, first + p.subtree)]
        assert len(deals) == p.subtree
        assert min(deals) * p.block_tokens > p.shard_tokens / 2 and max(deals) * p.block_tokens < p.shard_tokens * 2
    with pytest.raises(ValueError):
        next(splitting_tree([10**9], 2, [1]))


def test_many_shards_of_known_sizes(spark):
    sizes = spark.range(200_000).selectExpr("id AS _id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN 'tiny' ELSE concat('s', id % 7) END AS source", "200 + id % 101 AS tokens")
    targets = spark.createDataFrame([(1, "hot", 2.0, 1, 0.4), (1, "tiny", 1.0, 500, 0.4), (1, "s1", 1.0, 2, 0.4)], TARGETS)
    p = MixParameters(block_tokens=1000, shard_tokens=64_000, subtree=16)
    selection, report = mix_sizes(sizes, targets, p)
    of = {r["shard"]: r["n"] for r in selection.groupBy("shard").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert sorted(of) == list(range(max(of) + 1)) and len(of) > 200
    assert min(of.values()) > 32_000 and max(of.values()) < 128_000
    rep = {r["source"]: r for r in report.collect()}
    assert all(abs(r["tokens"] - r["quota"]) <= 300 for r in rep.values()) and rep["tiny"]["max_uses"] > 100
    assert abs(rep["hot"]["actual_share"] - 0.5) < 0.001
    assert selection.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_a_million_repeats_stay_within_the_quota():
    quotas = mix_quotas([{"mix_id": 1, "source": "a", "weight": 1.0, "max_repeats": 10**6, "total_fraction": 1.0}], {"a": 10}, 10**7)
    assert quotas == [(1, "a", 1.0, 10**7)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word {i} " * (1 + i % 7), "big") for i in range(600)] + [(1000 + i, "some small text here", "small") for i in range(20)]
    rows += [(2000, None, "big"), (2001, "", "small"), (2002, "no source", None), (2003, "other " * 50, "unwanted")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS copy", "2 AS tokens", "3 AS block", "4 AS keep", "'x' AS _n")


P = MixParameters(block_tokens=40, shard_tokens=800)


def test_shares_repeats_and_positions(spark, docs):
    targets = spark.createDataFrame(
        [(1, "big", 3.0, 1, 0.5), (1, "small", 1.0, 3, 0.5), (1, "missing", 1.0, 2, 0.5), (2, "small", 1.0, 2, 0.9), (3, "big", None, None, None), (None, "big", 1.0, 1, 1.0)], TARGETS
    )
    tk = ByteTokenizer()
    sizes = {r["doc_id"]: (r["source"], r["tokens"]) for r in token_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"], "text", tk).collect()}
    total = sum(n for _, n in sizes.values())
    selection, report = mix(docs, targets, tk, P)
    rows = selection.collect()
    rep = {(r["mix_id"], r["source"]): r for r in report.collect()}
    small = sum(n for s, n in sizes.values() if s == "small")
    for r in rows:
        assert sizes[r["doc_id"]] == (r["source"], r["tokens"]) and r["tokens"] > 0
    uses = {}
    for r in rows:
        uses[r["mix_id"], r["doc_id"]] = uses.get((r["mix_id"], r["doc_id"]), 0) + 1
    cap = {(1, "big"): 1, (1, "small"): 3, (2, "small"): 2}
    assert all(n <= cap[m, sizes[d][0]] for (m, d), n in uses.items())
    assert len({(r["mix_id"], r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert rep[2, "small"]["tokens"] == 2 * small and rep[2, "small"]["max_uses"] == 2
    assert rep[1, "missing"]["tokens"] == 0 and rep[1, "missing"]["n_docs"] == 0
    got = rep[1, "big"]["tokens"] + rep[1, "small"]["tokens"]
    assert abs(got - total / 2) < 60 and abs(rep[1, "big"]["tokens"] - rep[1, "big"]["quota"]) <= 30
    if rep[1, "small"]["quota"] < 3 * small:
        assert abs(rep[1, "big"]["actual_share"] - 0.75) < 0.03
    assert (3, "big") in rep and rep[3, "big"]["tokens"] == 0
    for m, s in {(r["mix_id"], r["shard"]) for r in rows}:
        at = sorted(r["position"] for r in rows if (r["mix_id"], r["shard"]) == (m, s))
        assert at == list(range(1, len(at) + 1))


def test_same_seed_same_mix_and_empty_tables(spark, docs):
    targets = spark.createDataFrame([(1, "big", 1.0, 1, 0.3)], TARGETS)
    a, b = (sorted(map(tuple, mix(docs, targets, ByteTokenizer(), P)[0].collect())) for _ in range(2))
    assert a == b and a
    assert mix(docs.limit(0), targets, ByteTokenizer(), P)[0].count() == 0
    assert mix(docs, targets.limit(0), ByteTokenizer(), P)[0].count() == 0
