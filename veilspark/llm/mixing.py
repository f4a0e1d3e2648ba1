"""Documents of several sources combined to target shares of the total size.

Sizes are counted by exact token length, so a source is a histogram however
many documents it has. A source's budget is its share of all tokens; as many
full passes over it as fit are taken first. What remains is a subset-sum over
the histogram: every length gives the same part of its documents, and the last
few thousand tokens are fitted by bounded-knapsack dynamic programming. Where
that falls short, as with few or long documents, the programme gets more and
at last all of what remains, so the budget is met as nearly as any choice of
these documents can. It stops at sums beyond ``MOST_SUMS`` (in units of the
lengths' common divisor) or beyond ``MOST_WORK`` steps; only a source whose
remaining budget is larger may then fall short. Documents of a chosen length
are then selected by seeded hash, in ranges of it: lengths that a third of all
documents share are ranked in small pieces.

Defined results: documents of null or unlisted sources take no part; a source
that cannot reach its share even at ``max_repeats`` uses every document that
often and is marked; a null or non-positive target or repeat count means no
use; sizes of 0 are used in full passes only; ties of hash go by id; repeated
rows of one id count once; empty tables give the listed sources with 0 tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CHOICE = "source STRING, tokens BIGINT, docs BIGINT, passes INT, extra BIGINT, reachable BOOLEAN"
DP_TOKENS = 60_000
MOST_SUMS = 20_000_000
MOST_WORK = 4_000_000_000
_RANGES = 4096


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length come nearest below or at ``budget``: bounded knapsack by dynamic programming.

    ``first[s]`` is the item whose turn first reached sum ``s``; its
    predecessor was reached in an earlier turn, so walking back uses no item twice.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take
    items = []
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        n, k = min(n, budget // size if size else 0), 1
        while n > 0:
            k = min(k, n)
            items.append((size * k, i, k))
            n, k = n - k, k * 2
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    first = np.full(budget + 1, -1, np.int32)
    for at, (weight, _, _) in enumerate(items):
        if weight <= budget:
            new = np.flatnonzero(reached[: budget + 1 - weight] & ~reached[weight:]) + weight
            reached[new] = True
            first[new] = at
            if reached[budget]:
                break
    s = int(np.flatnonzero(reached)[-1])
    while s:
        weight, i, k = items[first[s]]
        take[i] += k
        s -= weight
    return take


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, dp_tokens: int) -> np.ndarray:
    total = int((lengths * counts).sum())
    use = lengths > 0
    # the same part of every length, but for what the programme fits; exact integers, as totals may be large
    part = max(0, budget - dp_tokens // 2)
    take = np.where(use, np.array([int(c) * part // total for c in counts.tolist()], np.int64), 0)
    left = budget - int((take * lengths).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if left <= dp_tokens:
            break
        if use[i] and take[i] < counts[i]:
            n = min(int(counts[i] - take[i]), -(-(left - dp_tokens) // int(lengths[i])), left // int(lengths[i]))
            take[i] += max(0, n)
            left -= max(0, n) * int(lengths[i])
    # what is left is small, or smaller than every document that is left: then no sum is tried
    rest = np.where(use & (lengths <= left), counts - take, 0)
    return take + subset_sum(lengths, rest, left) if rest.any() else take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0, dp_tokens: int = DP_TOKENS) -> np.ndarray:
    """Documents to take of each length so that their tokens sum to ``budget`` (at most ``counts``)."""
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    unit = int(np.gcd.reduce(lengths))  # no sum lies between its multiples
    lengths, budget = lengths // unit, budget // unit
    best, spent = None, -1
    while True:
        take = _fit(lengths, counts, budget, seed, dp_tokens)
        if (s := int((take * lengths).sum())) > spent:
            best, spent = take, s
        if spent == budget or dp_tokens >= 2 * budget:  # nothing is fixed before the programme: no choice comes nearer
            return best
        dp_tokens = min(8 * dp_tokens, 2 * budget)
        items = sum(min(int(c), 2 * dp_tokens // int(n)).bit_length() for n, c in zip(lengths.tolist(), counts.tolist()) if n)
        if min(dp_tokens, budget) > MOST_SUMS or items * min(dp_tokens, budget) > MOST_WORK:
            return best


def distinct_documents(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), rows repeated under one id once; rows without an id can't be told to be repeats and stay."""
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return sizes.groupBy("doc_id", "source", apart.alias("apart")).agg(F.max("tokens").alias("tokens")).select("doc_id", "source", "tokens")


def choose(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``CHOICE``: for every source and token length, the full passes over all of its documents and the extra documents."""
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    histogram = materialise(distinct_documents(sizes).groupBy("source", "tokens").agg(F.count("*").alias("docs")).join(t, "source", "right"), "mix-histogram")
    total = histogram.agg(F.coalesce(F.sum(F.col("tokens") * F.col("docs")), F.lit(0)).alias("n")).scalar()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        share, most = (0 if pd.isna(x) else x for x in (rows["share"].iloc[0], rows["most"].iloc[0]))
        total_tokens = float(rows["total"].iloc[0])
        rows = rows[rows["docs"].notna() & rows["tokens"].notna()].sort_values("tokens")
        lengths, counts = rows["tokens"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64)
        own, most = int((lengths * counts).sum()), max(0, int(most))
        wanted = max(0.0, float(share)) * total_tokens
        reachable = own * most >= wanted
        budget = min(int(wanted), own * most)
        passes = budget // own if own else 0
        extra = fit_budget(lengths, counts, budget - passes * own, seed) if own and passes < most else np.zeros_like(counts)
        if not len(rows):
            return pd.DataFrame([(key[0], None, 0, 0, 0, bool(reachable))], columns=["source", "tokens", "docs", "passes", "extra", "reachable"])
        return pd.DataFrame({"source": key[0], "tokens": lengths, "docs": counts, "passes": passes, "extra": extra, "reachable": bool(reachable)})

    return histogram.withColumn("total", total).groupBy("source").applyInPandas(run, CHOICE)


def uses(sizes: DataFrame, choice: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each document is used."""
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    keyed = distinct_documents(sizes).select("doc_id", "source", "tokens", h.alias("h"), F.pmod(F.shiftright(h, 20), F.lit(_RANGES)).cast("int").alias("rng"))
    by_range = keyed.groupBy("source", "tokens", "rng").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = by_range.withColumn("before", before).join(choice.where("tokens IS NOT NULL").select("source", "tokens", "passes", "extra"), ["source", "tokens"])
    quota = quota.select("source", "tokens", "rng", "passes", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "rng").orderBy("h", "doc_id"))
    ranked = keyed.withColumn("rank", rank).join(quota, ["source", "tokens", "rng"])
    return ranked.select("doc_id", "source", "tokens", (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("int")).alias("uses"))


def shares(choice: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every source."""
    actual = choice.groupBy("source").agg(F.coalesce(F.sum(F.col("tokens") * (F.col("docs") * F.col("passes") + F.col("extra"))), F.lit(0)).alias("used_tokens"), F.first("reachable").alias("reachable"))
    everything = Window.partitionBy(F.lit(1))  # one row per source
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return actual.join(t, "source").withColumn("actual_share", F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(everything)))
