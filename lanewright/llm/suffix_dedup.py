"""Repeated byte strings removed with a hash-compared suffix sort.

Every byte that a string of ``LENGTH`` bytes covers goes, if the same string starts anywhere else, in the same text or another.

Sampling.  The anchor of a string is the place of its smallest ``GRAM``-byte hash, the leftmost of equals, so equal strings have their anchors
at the same offset and only anchors with an equal gram need to meet.  Neighbouring strings share their anchor, so there is
about one anchor for every 85 bytes, and a gram that occurs once is dropped before any text travels.

Sorting.  An anchor that is left travels with the bytes of all strings it stands for.  Equal contexts are one suffix.  The suffixes
that start at the anchors of a gram are sorted by a mergesort whose comparisons find the common extension of two suffixes by binary search over
prefix polynomial hashes, so a comparison takes the logarithm of the length.  For each offset d of the anchor in its string, neighbours in suffix order
that extend by ``LENGTH - d`` bytes form a run, and two of a run whose ``d`` bytes before the anchor have the same hash are
the same string.  Every such pair is compared byte by byte before it counts, so a hash collision removes nothing.

Large groups.  A gram with more than ``MOST_IN_GROUP`` anchors (a line that a third of all texts hold) is split by the bytes around it before it is
sorted.  Equal contexts first become one by an aggregate with map-side combine; all strings of a context that several anchors have are repeated.
What differs is cut into halves by the anchor's offset in the string: all strings of a half share more bytes than the gram, so their hash splits the
group.  Halves that are still too large are cut again.  After eight cuts a half is one string, whose copies are one context, so every group ends up sorted, and
every byte that goes was compared.  A context that crosses the end of the common line is cut at most twice on each level, since the parts inside the line become one.

Null and empty texts have no bytes and lose none.  Rows are numbered first, so repeated rows and repeated or null ids are different texts, and two
equal rows of ``LENGTH`` bytes or more empty each other.  An empty table gives an empty table.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import short_batches, text_of
from lanewright.session import materialize

LENGTH = 200
GRAM = 32
#: Anchors of one gram that are sorted together, at most 8 MB of contexts; a larger group is cut until its parts are no larger.
MOST_IN_GROUP = 20_000
#: Offsets of an anchor in its string lie in bands of ``2 ** bits`` offsets; all of them lie in the first band of 8 bits.
BAND_BITS = 8
#: Contexts in one Arrow batch.
BATCH_CONTEXTS = 4096
BATCH_ANCHORS = 50_000
#: Contexts sorted at once, and string starts hashed at once (the arrays of a piece stay in a core's cache).
SORTED_AT_ONCE = 8192
PIECE = 1 << 15
ORDER = np.uint64(0x9FB21C651E98DF25)

_random = np.random.Generator(np.random.PCG64(7771))
VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x5851F42D4C957F2D
WINDOW_MASK = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Prefix polynomial hashes modulo 2**64 of a byte array; any part's hash is one subtraction and one product."""

    powers = _powers(BASE, 2)
    inverses = _powers(pow(BASE, -1, 1 << 64), 2)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes.powers) < n:
            size = max(n, 1 << 16)
            Hashes.powers, Hashes.inverses = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(VALUE[data] * Hashes.powers[: n - 1], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from every place on."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * Hashes.inverses[:n]

    def part(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * Hashes.inverses[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, size: int = PIECE) -> list[np.ndarray]:
    """Gram hash, anchor place, and first and last start of the strings of each anchor, in four arrays."""
    found = []
    width = length - gram + 1
    last = len(data) - length + 1
    for start in range(0, max(last, 0), size):
        stop = min(start + size, last)
        part = data[start : stop + length - 1]
        hashed = Hashes(part).grams(gram)
        # Minima of spans that double in length, and of two spans that cover the width.
        smallest = ((hashed * ORDER) & ~WINDOW_MASK) | np.arange(len(hashed), dtype=np.uint64)
        starts, span = stop - start, 1
        while 2 * span <= width:
            smallest = np.minimum(smallest[:-span], smallest[span:])
            span *= 2
        smallest = np.minimum(smallest[:starts], smallest[width - span : width - span + starts])
        smallest = (smallest & WINDOW_MASK).astype(np.int64)
        first = np.flatnonzero(np.diff(smallest, prepend=-1))
        end = np.append(first[1:], starts) - 1
        at = smallest[first]
        found.append((_mix(hashed[at]).view(np.int64), at + start, first + start, end + start))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4


def _array(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        bodies = [pack.compress(text.encode("utf-8", "surrogatepass")) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["id", "body"])


def _unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of several texts in one batch, which is sent when it has ``BATCH_ANCHORS`` rows or more."""
    for batch in batches:
        held, size = [], 0
        for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            columns = anchors(_array(_unpack(body)))
            held.append([np.full(len(columns[0]), row, dtype=np.int64), *columns])
            size += len(columns[0])
            if size >= BATCH_ANCHORS:
                yield _joined(held)
                held, size = [], 0
        if size:
            yield _joined(held)


def _joined(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["row", "gram", "at", "first", "last"])


CONTEXT = "row bigint, gram bigint, at bigint, first bigint, last bigint, context binary"


def _context_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), BATCH_CONTEXTS):
        *numbers, contexts = zip(*rows[i : i + BATCH_CONTEXTS])
        arrays = [*[pa.array(x, pa.int64()) for x in numbers], pa.array(contexts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "gram", "at", "first", "last", "context"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        for row, body, marks in zip(*(batch.column(i) for i in range(3))):
            row, text, marks = row.as_py(), _unpack(body.as_py()), marks.as_py()
            for m in marks:
                held.append((row, m["gram"], m["at"], m["first"], m["last"], text[m["first"] : m["last"] + LENGTH]))
                if len(held) == BATCH_CONTEXTS:
                    yield from _context_rows(held)
                    held = []
        yield from _context_rows(held)


def halves(row: int, at: int, first: int, last: int, context: bytes, bits: int) -> Iterator[tuple]:
    """The parts of a context whose strings have the anchor in one band of ``2 ** bits`` offsets, named by the hash of the bytes that all strings of the band share."""
    for band in range((at - last) >> bits, ((at - first) >> bits) + 1):
        low = band << bits
        high = min(low + (1 << bits) - 1, LENGTH - GRAM)
        begin, end = max(first, at - high), min(last, at - low)
        shared = context[at - low - first : at - high + LENGTH - first]
        name = xxhash.xxh3_64_intdigest(shared, seed=low + 1)
        yield row, name - (1 << 63), at, begin, end, context[begin - first : end + LENGTH - first]


def _halved(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "at", "first", "last", "context")]
            yield from _context_rows([part for values in zip(*columns) for part in halves(*values, bits)])

    return run


def common_extension(hashes: Hashes, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from ``left`` and ``right`` on are equal, ``most`` at most: binary search over hashes."""
    low, high = np.zeros_like(most), most.copy()
    while np.any(low < high):
        middle = (low + high + 1) >> 1
        same = hashes.part(left, middle) == hashes.part(right, middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def sort_suffixes(data: np.ndarray, hashes: Hashes, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``data[at : at + size]`` within their groups; ``group`` ascends.

    All runs of all groups are merged at once: an element's new place is its place in its own run and the number of
    elements before it in the other run, found by binary search.
    """
    n = len(at)
    _, begin, count = np.unique(group, return_index=True, return_counts=True)
    begin, count = np.repeat(begin, count), np.repeat(count, count)
    local = np.arange(n) - begin
    order = np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        most = np.minimum(size[x], size[y])
        common = common_extension(hashes, at[x], at[y], most)
        inside = common < most
        bytes_x = data[at[x] + np.where(inside, common, 0)]
        bytes_y = data[at[y] + np.where(inside, common, 0)]
        shorter = (size[x] < size[y]) | ((size[x] == size[y]) & ties)
        return np.where(inside, bytes_x < bytes_y, shorter)

    width = 1
    while width < (count.max() if n else 0):
        run = local // width
        other = run ^ 1
        other_begin = np.minimum(other * width, count)
        low, high = np.zeros(n, dtype=np.int64), np.minimum(other_begin + width, count) - other_begin
        from_left = other < run
        while True:
            busy = np.flatnonzero(low < high)
            if not len(busy):
                break
            middle = (low[busy] + high[busy]) >> 1
            rival = order[begin[busy] + other_begin[busy] + middle]
            first = before(rival, order[busy], from_left[busy])
            low[busy] = np.where(first, middle + 1, low[busy])
            high[busy] = np.where(first, high[busy], middle)
        place = begin + (run >> 1) * 2 * width + (local - run * width) + low
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, width * 2
    return order


def repeated_offsets(contexts: list[bytes], before: np.ndarray, least: np.ndarray, group: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which strings of each different context occur elsewhere: a table of context by offset of the anchor in the string.

    ``before`` bytes stand before the anchor, so offsets run from ``least`` to ``before``; ``many`` contexts occur more
    than once and so do all their strings.
    """
    offsets = np.arange(LENGTH - GRAM + 1)
    has = (offsets >= least[:, None]) & (offsets <= before[:, None])
    found = has & many[:, None]
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    data = _array(b"".join(contexts))
    start = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    at = start + before
    size = sizes - before
    order = sort_suffixes(data, hashes, at, size, group)
    at, group_of, has_of = at[order], group[order], has[order]
    common = np.zeros(len(order), dtype=np.int64)
    common[1:] = common_extension(hashes, at[:-1], at[1:], np.minimum(size[order][:-1], size[order][1:]))
    common[1:][group_of[1:] != group_of[:-1]] = -1
    span = np.arange(LENGTH)
    for offset in offsets:
        there = np.flatnonzero(has_of[:, offset])
        if len(there) < 2:
            continue
        run = np.cumsum(common < LENGTH - offset)[there].astype(np.uint64)
        key = _mix(run) ^ hashes.part(at[there] - offset, int(offset))
        by_key = np.argsort(key, kind="stable")
        twins = np.flatnonzero(key[by_key][1:] == key[by_key][:-1])
        if not len(twins):
            continue
        x, y = there[by_key[twins]], there[by_key[twins + 1]]
        for part in np.array_split(np.arange(len(x)), len(x) // 4096 + 1):
            equal = (data[(at[x[part]] - offset)[:, None] + span] == data[(at[y[part]] - offset)[:, None] + span]).all(axis=1)
            found[order[x[part][equal]], offset] = True
            found[order[y[part][equal]], offset] = True
    return found


def _spans_of(rows: list[tuple]) -> pa.RecordBatch:
    """Repeated spans of whole groups of anchors; a row is (gram, row, at, first, last, context), sorted by gram."""
    classes: dict[tuple, int] = {}
    member, grams, contexts, before, least = [], [], [], [], []
    for gram, _, at, first, last, context in rows:
        key = (gram, at - first, at - last, context)
        number = classes.setdefault(key, len(classes))
        if number == len(contexts):
            grams.append(gram)
            contexts.append(context)
            before.append(at - first)
            least.append(at - last)
        member.append(number)
    member = np.array(member)
    many = np.bincount(member, minlength=len(contexts)) > 1
    _, group = np.unique(np.array(grams), return_inverse=True)
    # A class of several rows has all its strings; it is only sorted where another class of its gram needs it.
    alone = np.bincount(group)[group] == 1
    found = np.zeros((len(contexts), LENGTH - GRAM + 1), dtype=bool)
    before, least = np.array(before), np.array(least)
    offsets = np.arange(LENGTH - GRAM + 1)
    found[alone & many] = ((offsets >= least[:, None]) & (offsets <= before[:, None]))[alone & many]
    mixed = np.flatnonzero(~alone)
    if len(mixed):
        by_group = mixed[np.argsort(group[mixed], kind="stable")]
        found[by_group] = repeated_offsets([contexts[i] for i in by_group], before[by_group], least[by_group], group[by_group], many[by_group])
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    which, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    runs: dict[int, list[tuple[int, int]]] = {}
    for c, a, b in zip(which.tolist(), low.tolist(), high.tolist()):
        runs.setdefault(c, []).append((a, b - 1))
    out = [(rows[i][1], rows[i][2] - b, rows[i][2] - a + LENGTH) for i, c in enumerate(member.tolist()) for a, b in runs.get(c, ())]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["row", "start", "end"])


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by gram; only whole groups are worked on."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "row", "at", "first", "last", "context")))
        if len(held) >= SORTED_AT_ONCE:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield _spans_of(held[:cut])
                held = held[cut:]
    if held:
        yield _spans_of(held)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, removed, kept = [], [], []
        for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = _unpack(body)
            merged = merge_spans([(s["start"], s["end"]) for s in spans or ()])
            ends = [0, *[b for _, b in merged]]
            sizes.append(len(text))
            removed.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in merged], len(text)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"]
        )


def _split_spans(contexts: DataFrame, most: int, sorted_spans: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeated spans of groups that are too large to sort.  Each round makes equal contexts one, sorts the groups that are small enough and halves the rest."""
    found = []
    for bits in range(BAND_BITS - 1, -2, -1):
        contexts = materialize(contexts, "contexts")
        same = ["gram", "before", "behind", "context"]
        placed = contexts.withColumn("before", F.col("at") - F.col("first")).withColumn("behind", F.col("last") - F.col("at"))
        different = materialize(
            placed.groupBy(*same).agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min(F.struct("row", "at"))["at"].alias("at")), "different"
        )
        several = different.filter("n > 1").select(*same)
        found.append(placed.join(several, same).select("row", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")))
        sizes = different.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1")
        placed = different.withColumn("first", F.col("at") - F.col("before")).withColumn("last", F.col("at") + F.col("behind"))
        sized = placed.join(sizes, "gram").select("row", "gram", "at", "first", "last", "context", "size")
        # After the last cut a group holds one string and whatever shares its 64-bit hash.
        fits = F.col("size") <= most if bits >= 0 else F.lit(True)
        found.append(sorted_spans(sized.filter(fits).drop("size")))
        rest = sized.filter(~fits).drop("size")
        if rest.isEmpty():
            break
        contexts = rest.mapInArrow(_halved(bits), CONTEXT)
    return reduce(DataFrame.union, found)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """Per row: ``id_column``, ``n_bytes``, ``removed`` (maximal removed runs: start, end) and ``kept``, the bytes that stay."""
    spark = docs.sparkSession
    short_batches(spark, 64)
    id_type = docs.schema[id_column].dataType.simpleString()
    packed = docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text).alias("_text")).mapInArrow(_packed, f"id {id_type}, body binary")
    bodies = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "bodies")

    placed = bodies.select("row", "body").mapInArrow(_anchor_rows, "row bigint, gram bigint, at bigint, first bigint, last bigint")
    shared = materialize(placed.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1"), "grams")
    marks = materialize(placed.join(shared.hint("shuffle_hash"), "gram"), "marks")

    def with_bodies(part: DataFrame) -> DataFrame:
        of_row = part.groupBy("row").agg(F.collect_list(F.struct("gram", "at", "first", "last")).alias("marks"))
        return bodies.select("row", "body").join(of_row.hint("shuffle_hash"), "row")

    def contexts_of(part: DataFrame) -> DataFrame:
        return with_bodies(part).mapInArrow(_contexts, CONTEXT)

    def sorted_spans(contexts: DataFrame) -> DataFrame:
        return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_spans, "row bigint, start bigint, end bigint")

    spans = sorted_spans(contexts_of(marks.filter(F.col("size") <= most_in_group)))
    large = marks.filter(F.col("size") > most_in_group)
    if not large.isEmpty():
        spans = spans.union(_split_spans(contexts_of(large), most_in_group, sorted_spans))
    of_row = materialize(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    joined = bodies.join(of_row.hint("shuffle_hash"), "row", "left").select("id", "body", "spans")
    cut = joined.mapInArrow(_cut, f"id {id_type}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return cut.withColumnRenamed("id", id_column)
