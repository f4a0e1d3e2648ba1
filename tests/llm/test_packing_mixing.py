import random

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import mixing, packing

PACKS = "pack_id STRING, capacity_tokens INT, container STRING"


def _plain_ffd(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, free in enumerate(bins):
            if free >= s:
                bins[i] -= s
                break
        else:
            bins.append(capacity - s)
    return len(bins)


def test_tournament_is_first_fit():
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.randrange(0, 101) for _ in range(r.randrange(1, 200))]
        placed = packing.first_fit_decreasing(range(len(sizes)), sizes, 100)
        assert len({c for _, _, c, *_ in placed}) == _plain_ffd(sizes, 100) and len(placed) == len(sizes)


def test_pieces_positions_and_capacity():
    placed = packing.first_fit_decreasing([1, 2, 3, 4, 5], [250, 100, 60, 40, 0], 100)
    assert sorted((i, p, s) for i, p, _, _, _, s in placed) == [(1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 100), (3, 0, 60), (4, 0, 40), (5, 0, 0)]
    by = {}
    for i, _, c, n, at, s in placed:
        by.setdefault(c, []).append((n, at, s))
    for items in by.values():
        items.sort()
        assert [n for n, _, _ in items] == list(range(len(items)))
        assert all(at == sum(s for _, _, s in items[:n]) for n, at, _ in items) and sum(s for _, _, s in items) <= 100


def test_pack_groups(spark):
    r = random.Random(4)
    data = [(i, r.choice([0, 3, 50, 99, 100, 101, 350]), "x") for i in range(500)]
    sizes = spark.createDataFrame(data + data[:40] + [(None, 5, "x")], "doc_id BIGINT, tokens BIGINT, grp STRING")
    packs = spark.createDataFrame([("a", 100, "z"), ("b", 200, "z"), ("none", None, "z"), ("a", 100, "z")], PACKS)
    places = packing.pack(sizes, packs, group_docs=100).toPandas()
    assert places.groupby("pack_id").doc_id.nunique().to_dict() == {"a": 500, "b": 500}
    assert places.groupby(["pack_id", "doc_id"]).tokens.sum().groupby("pack_id").sum().eq(sum(t for _, t, _ in data)).all()
    full = places.groupby(["pack_id", "container"]).tokens.sum()
    assert full["a"].max() <= 100 and full["b"].max() <= 200 and places.container.str.split("-").str[0].nunique() > 1
    assert set(places[(places.pack_id == "a") & (places.piece > 0)].doc_id) == {i for i, t, _ in data if t > 100}
    assert packing.pack(sizes.limit(0), packs).count() == 0 and packing.pack(sizes, packs.limit(0)).count() == 0
    report = packing.fill_report(packing.pack(sizes, packs), packs.dropDuplicates(["pack_id"])).toPandas()
    assert (report.used_share <= 1).all() and len(report) == 2


def test_subset_sum_equals_brute_force():
    r = random.Random(6)
    for _ in range(40):
        n = r.randrange(1, 6)
        lengths = np.array(sorted(r.sample(range(1, 30), n)))
        counts = np.array([r.randrange(0, 4) for _ in range(n)])
        budget = r.randrange(0, 120)
        take = mixing.subset_sum(lengths, counts, budget)
        sums = {0}
        for size, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and (take >= 0).all()
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_budget_on_large_histograms():
    lengths, counts = np.arange(0, 3000), np.full(3000, 1_000_000)
    budget = 3_000_000_000_001
    take = mixing.fit_budget(lengths, counts, budget)
    assert int((take * lengths).sum()) == budget and (take <= counts).all() and take[0] == 0
    assert (mixing.fit_budget(lengths, counts, int((lengths * counts).sum())) == counts).all()
    assert mixing.fit_budget(np.array([7]), np.array([3]), 20).tolist() == [2] and mixing.fit_budget(np.array([], int), np.array([], int), 5).tolist() == []


def test_budget_of_few_long_documents():
    lengths, counts = np.array([50_000, 90_000, 100_000]), np.array([1, 1, 1])
    assert all(mixing.fit_budget(lengths, counts, 150_000, seed).tolist() == [1, 0, 1] for seed in range(20))
    r = random.Random(9)
    for _ in range(60):
        lengths, counts = np.array(sorted(r.sample(range(1, 60), 5))), np.array([r.randrange(1, 4) for _ in range(5)])
        sums = {0}
        for size, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(c + 1)}
        budget = r.randrange(0, max(sums))
        take = mixing.fit_budget(lengths, counts, budget, dp_tokens=r.choice((1, 5, 20)))
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_mix_end_to_end(spark):
    data = [(i, "big", 10 + i % 3) for i in range(600)] + [(1000 + i, "small", 7) for i in range(30)] + [(2000 + i, "tiny", 5) for i in range(3)] + [(3000, None, 9), (3001, "other", 9), (3002, "big", 0)]
    sizes = spark.createDataFrame(data, "doc_id BIGINT, source STRING, tokens BIGINT")
    targets = spark.createDataFrame([("big", 0.5, 1, "c"), ("small", 0.1, 5, "c"), ("tiny", 0.4, 2, "c"), ("absent", 0.0, 2, "c"), (None, 0.1, 1, "c")], "source STRING, target_share DOUBLE, max_repeats INT, docs STRING")
    choice = mixing.choose(sizes, targets)
    uses = mixing.uses(sizes, choice).toPandas()
    total = sum(t for _, s, t in data if s in ("big", "small", "tiny"))
    spent = (uses.tokens * uses.uses).groupby(uses.source).sum()
    assert spent["big"] == int(0.5 * total) and spent["small"] == max(s for s in range(int(0.1 * total) + 1) if s % 7 == 0) and spent["tiny"] == 3 * 5 * 2
    assert uses.groupby("source").uses.max().to_dict() == {"big": 1, "small": 4, "tiny": 2} and len(uses) == 634
    assert {r.source for r in choice.where("NOT reachable").collect()} == {"tiny"}
    shares = mixing.shares(choice, targets).toPandas().set_index("source")
    assert abs(shares.actual_share.sum() - 1) < 1e-9 and shares.used_tokens["big"] == spent["big"] and shares.used_tokens["absent"] == 0
    assert mixing.uses(sizes.limit(0), mixing.choose(sizes.limit(0), targets)).count() == 0
    again = mixing.uses(sizes, choice).toPandas()
    assert uses.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_repeated_rows_of_one_id_count_once(spark):
    data = [(1, "a", 10), (2, "a", 10), (3, "b", 10), (3, "b", 10), (3, "b", 10), (None, "a", 5), (None, "a", 5)]
    sizes = spark.createDataFrame(data, "doc_id BIGINT, source STRING, tokens BIGINT")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    choice = mixing.choose(sizes, targets)
    assert {r.source for r in choice.where("NOT reachable").collect()} == {"b"}  # 10 of 40 tokens; counted as 30 of 60 it would reach its share
    assert choice.agg(F.sum(F.col("tokens") * F.col("docs"))).first()[0] == 40
    assert [r.uses for r in mixing.uses(sizes, choice).where("doc_id = 3").collect()] == [1]


def test_hot_length_is_selected_exactly(spark):
    """All documents of one length: the quota is met across hash ranges, not in one group."""
    sizes = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(4).cast("bigint").alias("tokens"))
    targets = spark.createDataFrame([("s", 0.3331, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    assert mixing.uses(sizes, mixing.choose(sizes, targets)).agg(F.sum("uses")).first()[0] == int(0.3331 * 80_000) // 4
