"""Near duplicates by an inverted join over MinHash signature coordinates.

A text's set is its distinct shingles of ``WIDTH`` words (the whole sequence if it has fewer).  Texts with equal sets are one class
and only its smallest row goes on.  A class is posted under each (coordinate, value) of its signature.  Two sets that are as similar as asked
agree in ``least`` of the coordinates (all but one chance in a million, see ``least_matches``), so they also share a posting among the
``COORDINATES - least + 1`` rarest of each: this prefix is merged, and the longer lists are skipped and only probed.
Postings of one class need no merge, so a text without a neighbour leaves the join at once, and a value that a third of all texts share is
never in a prefix unless the rest of the signature is as common.

The merge reads each posting list of the prefixes with the signatures of its classes, counts the collisions of its pairs and keeps those of ``least`` or more.
A list gives a spanning forest of the pairs it keeps, never all of them, and one of more than ``LIST_ROWS`` classes is cut into blocks, every two of which meet in
a task.  Texts that only share passages drop out here, before any set travels.  The kept pairs are gathered into clusters by connected components.  Inside a cluster pairs that are
already connected are skipped, and the others are confirmed on the full sets (of 64-bit shingle hashes).  A cluster that is too large for a task is
cut into blocks, and every pair of blocks is a task of its own, so no candidate is lost and no task holds more than two blocks.  A task returns a spanning forest of its links,
which has the same components as all links.

Words are runs of other bytes than space and 0x09-0x0D, A-Z lower-cased.  Null and empty texts have no set and are linked with nothing.
Rows are numbered once, and linked, judged and dropped by that number: an id may repeat, and be of any type that has an order.  A component is named by its smallest id, null if it has none.
Of each component one row stays, the first with that id, or the first of all if none has an id.  Words of any length are hashed whole; an empty table gives an empty table.  Only the named columns are read; ``drop_near_duplicates`` gives back all columns of the rows that stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import numbered, short_batches, text_of
from lanewright.llm.graph import components
from lanewright.session import materialize

WIDTH = 5
COORDINATES = 32
#: A block of a large cluster holds at most about so many texts, and so many shingles.
BLOCK_TEXTS = 2048
BLOCK_SHINGLES = 3_000_000
#: A block of a long posting list holds about so many classes; lists of at most ``SHORT_LIST`` are compared many at a time.
LIST_ROWS = 4096
SHORT_LIST = 16
#: Bytes of text hashed at once.
PIECE = 1 << 20

_random = np.random.Generator(np.random.PCG64(20240817))
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
#: Places in a word whose values are looked up; later ones are worked out.
USUAL = 64
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A value of its own for each byte and place, so that the sum over a word depends on the order of its bytes."""
    return _mix(values + places.astype(np.uint64) * STEP)


TABLE = _placed(BYTE_VALUE[:, None], np.arange(USUAL)[None, :]).ravel()


def _piece_words(data: np.ndarray) -> np.ndarray:
    space = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = np.flatnonzero(~space)
    lengths = ends - starts
    offset = inside - np.repeat(starts, lengths)
    values = TABLE[data[inside].astype(np.int64) * USUAL + np.minimum(offset, USUAL - 1)]
    late = np.flatnonzero(offset >= USUAL)
    values[late] = _placed(BYTE_VALUE[data[inside[late]]], offset[late])
    return _mix(np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1]))) ^ lengths.astype(np.uint64))


def word_hashes(text: str, size: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each word, in order; a long text is read in pieces that end at white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    parts, start = [], 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data):
            stop = np.flatnonzero(IS_SPACE[data[end : end + size]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + size, len(data))
        parts.append(_piece_words(data[start:end]))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < width:
        return _mix((words * PLACE[: len(words)]).sum(keepdims=True) + PLACE[32 + len(words) : 33 + len(words)])
    last = len(words) - width + 1
    total = words[:last] * PLACE[0]
    for i in range(1, width):
        total = total + words[i : i + last] * PLACE[i]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * FACTOR + SHIFT).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_matches(similarity: float, chance: float = 1e-6) -> int:
    """The most coordinates that two sets of this similarity share, but for the given chance."""
    below = 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)
        if below > chance:
            return max(1, k)
    return COORDINATES


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, signs = [], [], []
        for text in batch.column(2).to_pylist():
            shingles = shingle_set(text)
            n.append(len(shingles))
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            signs.append(signature(shingles) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int32()))],
            names=["id", "doc", "n", "key", "sign"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


class Forest:
    """Joins nodes, and tells whether they were apart."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _alike(signs: np.ndarray, sizes: np.ndarray, a: np.ndarray | int, b: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Whether rows ``a`` (or one row) and rows ``b`` collide in ``least`` coordinates or more, and are near enough in size."""
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    return fits & ((signs[a] == signs[b]).sum(axis=1) >= least)


def list_pairs(lists: np.ndarray, sizes: np.ndarray, signs: np.ndarray, percent: int, least: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one list (equal neighbours in ``lists``) that are alike: the same components as all such pairs."""
    starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(lists)])))
    short = np.repeat(lengths <= SHORT_LIST, lengths)
    for apart in range(1, min(SHORT_LIST, len(lists))):
        a = np.flatnonzero(short[:-apart] & (lists[apart:] == lists[:-apart]))
        if not len(a):
            break
        a = a[_alike(signs, sizes, a, a + apart, percent, least)]
        yield from zip(a.tolist(), (a + apart).tolist())
    for start, length in zip(starts[lengths > SHORT_LIST], lengths[lengths > SHORT_LIST]):
        # A class that was reached is never compared again, so a list of near copies takes little more than one pass.
        rest = np.arange(start, start + length)
        while len(rest) > 1:
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                hit = _alike(signs, sizes, x, rest, percent, least)
                reached.extend(rest[hit])
                yield from ((int(x), int(y)) for y in rest[hit])
                rest = rest[~hit]


def _count_task(percent: int, least: int):
    """Over rows sorted by list: the kept pairs of a task's lists, without those that its earlier ones connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[pa.RecordBatch] = []

        def judged(table: pa.Table, n: int) -> pa.RecordBatch:
            lists = table.column("list").to_numpy()[:n]
            reps, sizes = table.column("rep").to_numpy()[:n], table.column("n").to_numpy()[:n]
            signs = table.column("sign").slice(0, n).combine_chunks().flatten().to_numpy().reshape(n, COORDINATES)
            found = [(int(reps[a]), int(reps[b])) for a, b in list_pairs(lists, sizes, signs, percent, least) if forest.join(int(reps[a]), int(reps[b]))]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * LIST_ROWS:
                table = pa.Table.from_batches(held)
                lists = table.column("list").to_numpy()
                whole = int(np.argmax(lists == lists[-1]))  # the last list may go on in the next batch
                if whole:
                    yield judged(table, whole)
                    held = table.slice(whole).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            yield judged(table, table.num_rows)

    return run


def cluster_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts; ``sides`` 0 and 1: only pairs across, all 2: every pair."""
    g = len(ids)
    signs = np.stack([signature(s) for s in sets])
    tokens = (np.arange(COORDINATES, dtype=np.int64) << 32) | signs.view(np.uint32).astype(np.int64)
    _, flat, counts = np.unique(tokens.ravel(), return_inverse=True, return_counts=True)
    flat = flat.reshape(g, COORDINATES)
    # Rarest first, ties by token: the same order for all, so similar signatures meet in their prefixes.
    ranked = np.take_along_axis(flat, np.lexsort((flat, counts[flat]), axis=1), axis=1)[:, : COORDINATES - least + 1]
    order = np.argsort(ranked.ravel(), kind="stable")
    posted, owner = ranked.ravel()[order], np.repeat(np.arange(g), ranked.shape[1])[order]
    starts = np.searchsorted(posted, np.arange(len(counts) + 1))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, flat_sets = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    marked = np.zeros(int(flat_sets.max()) + 1, dtype=bool)
    parent = np.arange(g)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(g):
        lists = [owner[starts[t] : starts[t + 1]] for t in ranked[i] if starts[t + 1] - starts[t] > 1]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[near > i]
        near = near[(sides[near] == 2) | (sides[near] != sides[i])]
        near = near[100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i])]
        if len(near):
            near = near[(signs[near] == signs[i]).sum(axis=1) >= least]
        if len(near):
            mine = root(i)
            near = near[[root(int(j)) != mine for j in near]]
        if not len(near):
            continue
        marked[flat_sets[begins[i] : ends[i]]] = True
        for part in np.array_split(near, max(1, int(sizes[near].sum()) // 2_000_000)):
            n = sizes[part]
            places = np.arange(n.sum()) + np.repeat(begins[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            shared = np.add.reduceat(marked[flat_sets[places]].astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
            for j in part[100 * shared >= percent * (n + sizes[i] - shared)]:
                a, b = root(i), root(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[j])))
        marked[flat_sets[begins[i] : ends[i]]] = False
    return links


def _link_task(percent: int, least: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        block = rows["block"].to_numpy()
        sides = np.full(len(rows), 2) if i == j else (block == j).astype(int)
        return pd.DataFrame(cluster_links(rows["id"].to_numpy(), sides, sets, percent, least), columns=["a", "b"], dtype="int64")

    return run


def counted_pairs(prefix: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """``a`` and ``b``: pairs of classes that share a posting of their prefixes and collide in ``least`` coordinates or more, connected as by all such pairs."""
    lists = prefix.groupBy("token").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("blocks"), F.count("*").alias("size")).filter("size > 1")
    posted = prefix.join(lists.drop("size").hint("merge"), "token").join(classes.select("rep", "n", "sign").hint("shuffle_hash"), "rep")
    posted = posted.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Blocks of a long list meet two by two; their inner pairs are found wherever they meet.
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    met = posted.withColumn("other", F.explode(others)).select(
        F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("list"), "rep", "n", "sign"
    )
    return met.repartition("list").sortWithinPartitions("list", "rep").mapInArrow(_count_task(percent, least), "a bigint, b bigint")


def _judged(docs: DataFrame, percent: int, id_column: str, text: str) -> DataFrame:
    """Per row of ``numbered``: ``id`` (the number of the row), ``doc`` (its id), ``n``, ``component`` and ``kept``."""
    least = least_matches(percent / 100)
    rows = docs.select(F.col("_place").alias("id"), F.col(f"_doc.`{id_column}`").alias("doc"), text_of(f"_doc.`{text}`").alias("_text"))
    signed = materialize(rows.mapInArrow(_signatures, f"id bigint, doc {rows.schema['doc'].dataType.simpleString()}, n bigint, key binary, sign array<int>"), "signatures")

    named = F.when(F.col("doc").isNotNull(), F.struct("doc", "id"))
    classes = signed.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.first("sign").alias("sign"), F.max("n").alias("n"), F.min(named).alias("named"),
        F.min(F.when(F.col("doc").isNull(), F.col("id"))).alias("unnamed"),
    )
    classes = materialize(classes, "classes")
    posts = classes.select("rep", F.posexplode("sign").alias("at", "value")).select("rep", F.xxhash64("at", "value").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    # Neither side is sent whole: the planner takes the postings for no more than the classes, as if the explode made one row of each.
    found = posts.join(shared.hint("merge"), "token")
    by_rep = Window.partitionBy("rep")
    rarest = found.withColumns({
        "place": F.row_number().over(by_rep.orderBy("size", "token")), "alone": F.lit(COORDINATES) - F.count("*").over(by_rep),
    }).filter(F.col("place") + F.col("alone") <= COORDINATES - least + 1)
    prefix = materialize(rarest.select("rep", "token"), "prefix")
    clusters = components(materialize(counted_pairs(prefix, classes, percent, least), "counted"))

    member = classes.select("rep", "key", "n").join(clusters, F.col("rep") == F.col("node")).select("rep", "key", "n", F.col("root").alias("cluster"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    cut = member.groupBy("cluster").agg(blocks.cast("int").alias("blocks"))
    member = member.join(cut, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    member = materialize(member, "members")
    chosen = rows.select("id", "_text").join(member.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sets, "id bigint, shingles binary")
    chosen = chosen.join(member.withColumnRenamed("rep", "id").hint("shuffle_hash"), "id")
    tasks = chosen.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "shingles"
    )
    links = tasks.groupBy("cluster", "i", "j").applyInPandas(_link_task(percent, least), "a bigint, b bigint")
    joined = components(materialize(links, "links"))

    # Only classes that are linked meet the others of their component; all others are components of their own.
    linked = classes.select("rep", "named", "unnamed").join(joined, F.col("rep") == F.col("node"))
    whole = linked.groupBy("root").agg(F.min("named").alias("first"), F.min("unnamed").alias("first_unnamed"))
    stays = linked.select("rep", "root").join(whole, "root").select(F.col("rep").alias("node"), "first", "first_unnamed")
    placed = classes.join(stays, F.col("rep") == F.col("node"), "left").select(
        "key", F.when(F.col("node").isNull(), F.col("named")).otherwise(F.col("first")).alias("first"),
        F.when(F.col("node").isNull(), F.col("unnamed")).otherwise(F.col("first_unnamed")).alias("first_unnamed"),
    )
    alone = F.col("key").isNull()
    kept = alone | F.coalesce(F.col("id") == F.col("first.id"), F.lit(False)) | F.coalesce(F.col("first").isNull() & (F.col("id") == F.col("first_unnamed")), F.lit(False))
    component = F.when(alone, F.col("doc")).otherwise(F.col("first.doc"))
    return signed.join(placed, "key", "left").select("id", "doc", "n", component.alias("component"), kept.alias("kept"))


def near_components(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_column``, ``n_shingles``, ``component_id``, the smallest id reachable by links of ``percent`` or more, and ``kept``."""
    short_batches(docs.sparkSession)
    judged = _judged(numbered(docs, [id_column, text]), percent, id_column, text)
    return judged.select(F.col("doc").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_components`` keeps, with all their columns."""
    short_batches(docs.sparkSession)
    rows = numbered(docs, docs.columns)
    gone = materialize(_judged(rows, percent, id_column, text).filter("not kept").select(F.col("id").alias("_gone")), "gone")
    return rows.join(gone.hint("shuffle_hash"), F.col("_place") == F.col("_gone"), "left_anti").select("_doc.*")
