"""Whole documents into containers of fixed capacity: first-fit decreasing in randomised groups.

Documents are dealt to groups by a seeded hash of their id; within a group,
items are placed in order of falling size into the first container with room,
found by descending a tournament tree of the containers' free space
(logarithmic per item). Groups are independent tasks of bounded size, so the
work spreads and only (id, size) pairs are shuffled. A group of ``group_docs``
documents wastes at most its last containers; more documents mean more groups.

Defined results: a document larger than the capacity fills containers of its
own piece by piece, and only its remainder shares one; sizes of 0 take a place
without space; ids are unique (repeated rows of one id count once); ties of
size go by id; an empty table gives no rows; a null or non-positive capacity
gives no containers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = "pack_id STRING, doc_id BIGINT, piece INT, container STRING, position INT, first_token INT, tokens INT"
GROUP_DOCS = 20_000


class Tournament:
    """The leftmost of ``n`` containers with enough free space; each inner node holds the larger space of its two."""

    def __init__(self, n: int, capacity: int) -> None:
        self.size = 1 << max(0, (n - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """Take ``need`` from the first container that has it."""
        free, at = self.free, 1
        while at < self.size:
            at *= 2
            if free[at] < need:
                at += 1
        where = at - self.size
        free[at] -= need
        while at > 1:
            at //= 2
            a, b = free[2 * at], free[2 * at + 1]
            best = a if a > b else b
            if free[at] == best:
                break
            free[at] = best
        return where


def first_fit_decreasing(ids: Sequence[int], sizes: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(id, piece, container, position, first token, tokens) of every document, or of every piece of one above capacity."""
    pieces: list[tuple[int, int, int]] = []  # (size, id, piece)
    for i, s in zip(ids, sizes):
        whole, rest = divmod(s, capacity) if s > capacity else (0, s)
        pieces.extend((capacity, i, p) for p in range(whole))
        if rest or not whole:
            pieces.append((rest, i, whole))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    tree, filled, counts, out = Tournament(max(1, len(pieces)), capacity), {}, {}, []
    for size, i, piece in pieces:
        c = tree.place(size)
        at, n = filled.get(c, 0), counts.get(c, 0)
        out.append((i, piece, c, n, at, size))
        filled[c], counts[c] = at + size, n + 1
    return out


def pack(sizes: DataFrame, packs: DataFrame, group_docs: int = GROUP_DOCS, seed: int = 0) -> DataFrame:
    """``PLACES`` of ``sizes(doc_id, tokens)`` for every row of ``packs(pack_id, capacity_tokens)``."""
    sizes = sizes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").cast("int").alias("tokens"))
    groups = F.greatest(F.lit(1), F.ceil(F.lit(sizes.select(F.count("*").alias("n")).scalar()) / F.lit(group_docs)))
    dealt = sizes.withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), groups))
    kinds = packs.where("pack_id IS NOT NULL AND capacity_tokens > 0").dropDuplicates(["pack_id"]).agg(F.collect_list(F.struct("pack_id", "capacity_tokens")).alias("k"))
    tall = dealt.withColumn("pack", F.explode(F.coalesce(kinds.scalar(), F.array().cast("array<struct<pack_id:string,capacity_tokens:int>>"))))
    flat = tall.select("grp", "doc_id", "tokens", F.col("pack.pack_id").alias("pack_id"), F.col("pack.capacity_tokens").alias("capacity"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pack_id, grp = key
        placed = first_fit_decreasing(rows["doc_id"].tolist(), np.maximum(rows["tokens"].fillna(0), 0).astype(int).tolist(), int(rows["capacity"].iloc[0]))
        return pd.DataFrame([(pack_id, i, piece, f"{grp}-{c}", n, at, s) for i, piece, c, n, at, s in placed], columns=[x.split()[0] for x in PLACES.split(", ")])

    return flat.groupBy("pack_id", "grp").applyInPandas(run, PLACES)


def fill_report(places: DataFrame, packs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, by pack."""
    used = places.groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") > 0).alias("further_pieces"))
    return used.join(packs.select("pack_id", "capacity_tokens"), "pack_id").withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
