"""The trie of conversation prefixes, with totals over its subtrees, from a minimal-perfect-hash node table.

A node is a distinct sequence of first turns.  It is named by a digest: four lanes of hashes of (place, turn) summed from the start, so the digests of all prefixes
of a conversation are running sums, which no task has to hold.  Conversations with the same turns are one row from then on.

The trie is cut into shards.  A node is heavy if more than ``SHARD_ROWS`` prefix rows lie at or below it; every light node below a
heavy one starts a subtree, and whole subtrees are dealt to shards.  In a shard the distinct digests get the slots of a minimal perfect
hash (levels of bit tables: a digest that is alone in its place of a level takes that place's rank), and every lookup compares the whole digest that is
stored in the slot, so a digest of another shard finds no slot.  Rows scatter their counts into flat arrays by slot; rows that meet in a slot must
agree in parent and turn, or the job fails instead of joining two nodes.  Sums over subtrees run through the array of parent slots from the deepest
level up.  The heavy nodes, at most the ``SHARD_ROWS``-th part of the rows on each level, are a last shard, to which the sums of the subtrees below them are added first.

The numbers of the conversations that end in a node are joined in runs of ``RUN`` and hashed as a stream in their order.

Null roles and texts count as empty; turns with one number are ordered by role and a hash of the text, and repeated rows are repeated
turns.  Rows without a conversation id belong to no conversation.  Ids are whole numbers.  An empty table gives an empty table.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.talks import numbered_turns
from lanewright.operators.ordered import running_totals
from lanewright.session import materialize

SHARD_ROWS = 1 << 17
LANES = 4
#: Numbers that may be joined into one piece: a range of 2**12.
RUN = 12


class SlotTable:
    """Slots 0 to n - 1 for n distinct 128-bit digests."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        open_keys, given = np.arange(len(high)), 0
        slots = np.zeros(len(high), dtype=np.int64)
        while len(open_keys):
            size = max(2 * len(open_keys), 16)
            places = self._place(high[open_keys], low[open_keys], len(self.levels), size)
            alone = np.bincount(places, minlength=size) == 1
            ranks = given + np.cumsum(alone) - 1
            self.levels.append((alone, ranks))
            single = alone[places]
            slots[open_keys[single]] = ranks[places[single]]
            given += int(alone.sum())
            open_keys = open_keys[~single]
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.high[slots], self.low[slots] = high, low

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        x = high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        found = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for level, (alone, ranks) in enumerate(self.levels):
            places = self._place(high[left], low[left], level, len(alone))
            here = alone[places]
            found[left[here]] = ranks[places[here]]
            left = left[~here]
        there = np.flatnonzero(found >= 0)
        wrong = (self.high[found[there]] != high[there]) | (self.low[found[there]] != low[there])
        found[there[wrong]] = -1
        return found


NODE = "g1 bigint, g2 bigint, p1 bigint, p2 bigint, conv bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"


def accumulate(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard from its rows: digest (g1, g2), parent's digest (p1, p2), turn (a, b), depth, words, conv, n, and what comes from below the shard."""
    column = {c: rows[c].to_numpy() for c in rows.columns}
    distinct = rows.drop_duplicates(["g1", "g2"])
    table = SlotTable(distinct["g1"].to_numpy(), distinct["g2"].to_numpy())
    n, slot = len(distinct), table.slots(column["g1"], column["g2"])
    fixed = {}
    for name in ("p1", "p2", "a", "b", "depth", "words"):
        fixed[name] = np.zeros(n, dtype=np.int64)
        fixed[name][slot] = column[name]
        if not np.array_equal(fixed[name][slot], column[name]):
            raise ValueError("two prefixes have one digest")
    members, children, leaves, saved = (np.zeros(n, dtype=np.int64) for _ in range(4))
    conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(conv, slot, column["conv"])
    for total, name in ((members, "n"), (children, "children"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, slot, column[name])
    depth, up = fixed["depth"], table.slots(fixed["p1"], fixed["p2"])
    up[depth == 0] = -1
    inner = np.flatnonzero(up >= 0)
    np.add.at(children, up[inner], 1)
    leaves[children == 0] = 1
    saved += (members - 1) * fixed["words"]
    by_depth = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[by_depth], prepend=-1, append=-1))
    for start, end in zip(edges[-2::-1], edges[:0:-1]):
        level = by_depth[start:end]
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    parent = pd.array(np.where(up >= 0, conv[up], 0), dtype="Int64")
    parent[up < 0] = pd.NA
    return pd.DataFrame({
        "g1": table.high, "g2": table.low, "p1": fixed["p1"], "p2": fixed["p2"], "conv": conv, "depth": depth, "parent": parent,
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved": saved,
    })


def _digest(at: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(i), at, *sums).alias(f"g{i}") for i in (1, 2)]


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn ``conv``, ``depth``, digest ``g1``, ``g2``, parent's digest ``p1``, ``p2``, the turn's ``a``, ``b`` and ``words``."""
    half = F.lit((1 << 32) - 1)
    mixed = [F.xxhash64(F.lit(i), "_at", "_a", "_b") for i in range(LANES // 2)]
    lanes = [x for m in mixed for x in (m.bitwiseAND(half), F.shiftrightunsigned(m, 32))]
    names = [f"_l{i}" for i in range(LANES)]
    rows = turns.withColumns(dict(zip(names, lanes)))
    rows = running_totals(rows, ["_at"], names, ["_conv"])
    before = [F.col(f"{n}_before").cast("bigint") for n in names]
    own = _digest(F.col("_at") + 1, [b + F.col(n) for b, n in zip(before, names)])
    parent = [c.alias(f"p{i}") for i, c in zip((1, 2), _digest(F.col("_at"), before))]
    return rows.select(F.col("_conv").alias("conv"), (F.col("_at") + 1).alias("depth"), *own, *parent, F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_words").alias("words"))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node from the sorted pieces of its numbers."""
    key, state = None, None
    for batch in batches:
        done = []
        for g1, g2, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (g1, g2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (g1, g2), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["g1", "g2", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["g1", "g2", "ends"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``g1``, ``g2`` and ``ends``, the SHA-256 of the ascending numbers of the conversations (``conv``) that end there."""
    runs = ends.groupBy("g1", "g2", F.shiftright("conv", RUN).alias("_run")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("_piece"))
    ordered = runs.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "_run").select("g1", "g2", "_piece")
    return ordered.mapInArrow(_stream_digests, "g1 bigint, g2 bigint, ends string")


def trie(turns: DataFrame, conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns`` are those of ``talks.numbered_turns``, places without gaps; ``conversations`` names all members (``_conv``), also those without turns.
    """
    spark = turns.sparkSession
    digest = ["g1", "g2"]
    zero = F.lit(0).cast("bigint")
    rows = materialize(prefixes(turns), "prefixes")
    last = rows.groupBy("conv").agg(F.max_by(F.struct(*digest), "depth").alias("_end"), F.max("depth").alias("length"))
    ends = conversations.select(F.col("_conv").alias("conv")).join(last, "conv", "left")
    root = [c.alias(f"_r{i}") for i, c in zip((1, 2), _digest(zero, [zero] * LANES))]
    ends = ends.select("conv", *[F.coalesce(F.col(f"_end.{g}"), r).alias(g) for g, r in zip(digest, root)], F.coalesce("length", zero).alias("length"))
    ends = materialize(ends, "ends")

    # Conversations with the same turns go on as the smallest of them.
    classes = materialize(ends.groupBy(*digest).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("length").alias("length")), "classes")
    rows = materialize(rows.join(classes.select("conv", "n", "length"), "conv"), "distinct")
    heavy = rows.groupBy(*digest).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("_weight")).filter(F.col("_weight") > shard_rows).select(*digest, F.lit(True).alias("heavy"))
    marked = rows.join(heavy, digest, "left").withColumns({"heavy": F.coalesce("heavy", F.lit(False)), **{c: zero for c in ("children", "leaves", "saved")}})
    marked = materialize(marked, "marked")
    tops = marked.filter("not heavy").groupBy("conv").agg(F.min("depth").alias("_top_depth"), F.min_by(F.struct(*digest), "depth").alias("_top"))
    shards = max(1, -(-rows.count() // shard_rows))
    light = marked.filter("not heavy").join(tops, "conv").withColumn("_shard", F.pmod(F.xxhash64("_top"), F.lit(shards)))
    below = materialize(light.drop("heavy", "_top").groupBy("_shard").applyInPandas(accumulate, NODE), "subtrees")

    # A node whose parent has no slot in its shard is the top of a subtree: its sums go to the heavy nodes or the root.
    top = F.col("parent").isNull()
    sums = below.filter(top).groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    of_root = ends.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0").select(
        *[r.alias(g) for g, r in zip(digest, root)], *[zero.alias(c) for c in ("p1", "p2", "a", "b", "depth", "words")], "conv", "n"
    )
    crown = marked.filter("heavy").groupBy(*digest, "p1", "p2", "a", "b", "depth", "words").agg(F.min("conv").alias("conv"), F.sum("n").alias("n")).unionByName(of_root)
    crown = crown.join(sums, digest, "left").fillna(0, ["children", "leaves", "saved"]).withColumn("_shard", F.lit(0))
    crown = materialize(crown.groupBy("_shard").applyInPandas(accumulate, NODE), "crown")

    over = crown.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conv").alias("_over"))
    tops = below.filter(top).join(over, ["p1", "p2"]).withColumn("parent", F.col("_over")).drop("_over")
    nodes = below.filter(~top).unionByName(tops).unionByName(crown)
    return nodes.join(end_digests(ends), digest, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``trie`` of a table of conversations (conv_id, turn, role, text) as it is."""
    placed = materialize(numbered_turns(turns), "turns")
    return trie(placed, placed.select("_conv").distinct(), shard_rows)
