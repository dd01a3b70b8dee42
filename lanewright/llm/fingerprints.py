"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

The paragraphs of a text are its lines.  A paragraph is hashed to a wide vector, and the fingerprint of a text is the sum of the vectors of its
paragraphs, lane by lane modulo 2**32: the order of the paragraphs does not matter, and a paragraph is put in or taken out by adding or
subtracting its vector (``plus``, ``minus``), without the rest of the text.

A vector has two parts.  ``EXACT`` lanes hold bits of the paragraph's SHA-512, mixed anew for each pair of lanes: two texts with equal paragraphs agree in
them, others do not.  ``SIGNS`` lanes count, for each lane, the shingles of up to ``WIDTH`` words of the paragraph whose hash has that lane's bit set.  Twice the
count less the number of shingles is a sum of random signs, so the product of two texts' lanes estimates how many shingles they share, and
``likeness`` is twice that over the two sizes (Dice on multisets, 0 to 1, with a standard error below 0.09).

Null counts as the empty text, which is one empty paragraph.  Texts without words are alike (1) if their fingerprints are equal, else not (0).
Repeated rows have equal fingerprints and are separate rows.  A text of any length is a sum, so only its lines are held.  An empty table gives an empty table.

``edited_fingerprints`` updates fingerprints instead of making them anew.  Its order (descending id, null ids last, ties by a hash of the text and then as read) is cut
into blocks of ``BLOCK`` neighbours; the first row of a block is sent to the block before it as well, so no row needs any but its own block.
Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import text_of
from lanewright.session import materialize

WIDTH = 3
#: Lanes of 32 bits: those that tell paragraphs apart, and those that count signs.
EXACT = 8
SIGNS = 128
BLOCK = 128
LANE = 1 << 32
#: Bits 0 and 32: two counters of one sum.
BOTH = (1 << 32) + 1


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def _words(paragraph: Column) -> Column:
    return F.transform(F.filter(F.split(paragraph, "\\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: str) -> Column:
    """The hash of the up to ``WIDTH`` words from each word on; ``words`` is a column, because an expression would be worked out anew for each word."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WIDTH)]))


def fingerprints(rows: DataFrame, keys: list[str], lines: str) -> DataFrame:
    """``keys`` and ``vector``, the sum over all paragraphs in the arrays ``lines`` of a key; a key without a paragraph has no row."""
    each = rows.select(*keys, F.explode(lines).alias("_paragraph"))
    each = each.select(*keys, F.unhex(F.sha2("_paragraph", 512)).alias("_sha"), _words(F.col("_paragraph")).alias("_words"))
    each = each.select(*keys, "_sha", F.posexplode_outer(_shingles("_words")).alias("_word", "_shingle"))
    first, low = F.coalesce(F.col("_word") == 0, F.lit(True)), F.lit(LANE - 1)
    per_hash = SIGNS // 64
    hashed = each.select(
        *keys, F.when(first, F.col("_sha")).alias("_sha"), F.col("_word"),
        *[F.when(F.col("_word").isNotNull(), F.xxhash64(F.lit(k), "_shingle")).alias(f"_h{k}") for k in range(per_hash)],
    )
    exact = [F.when(F.col("_sha").isNotNull(), F.xxhash64(F.lit(k), "_sha")) for k in range(EXACT // 2)]
    lanes = [half for x in exact for half in (x.bitwiseAND(low), F.shiftrightunsigned(x, 32))]
    signs = [F.shiftrightunsigned(f"_h{k}", bit).bitwiseAND(F.lit(BOTH)) for k in range(per_hash) for bit in range(32)]
    summed = hashed.groupBy(*keys).agg(
        F.count("_word").alias("_n"), *[F.sum(x).alias(f"_e{i}") for i, x in enumerate(lanes)], *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(signs)]
    )
    vector = F.struct(
        F.col("_n").alias("n"), F.array(*[F.pmod(f"_e{i}", F.lit(LANE)) for i in range(len(lanes))]).alias("exact"),
        F.array(*[F.coalesce(f"_s{i}", F.lit(0).cast("bigint")) for i in range(len(signs))]).alias("signs"),
    )
    return summed.select(*keys, vector.alias("vector"))


def none() -> Column:
    """The vector of no paragraph."""
    zero = F.lit(0).cast("bigint")
    return F.struct(zero.alias("n"), F.array_repeat(zero, EXACT).alias("exact"), F.array_repeat(zero, SIGNS // 2).alias("signs"))


def _joined(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"), F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(LANE))).alias("exact"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: x + sign * y).alias("signs"),
    )


def plus(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both."""
    return _joined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The vector of what is left of ``a`` without the paragraphs of ``b``, all of which it has."""
    return _joined(a, b, -1)


def printed(vector: Column) -> Column:
    """The lanes in hexadecimal digits."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(EXACT - 2), F.lit(2)), lambda i: F.concat(*[F.lpad(F.hex(F.get(vector["exact"], i + k)), 8, "0") for k in (0, 1)]))
    return F.array_join(F.concat(pairs, F.transform(vector["signs"], lambda x: F.lpad(F.hex(x), 16, "0"))), "")


def sums(vector: Column) -> Column:
    """The sum of signs of each lane."""
    size = vector["n"].cast("double")
    low = F.transform(vector["signs"], lambda x: 2 * x.bitwiseAND(F.lit(LANE - 1)).cast("double") - size)
    return F.concat(low, F.transform(vector["signs"], lambda x: 2 * F.shiftrightunsigned(x, 32).cast("double") - size))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(equal: Column, a: Column, b: Column, aa: Column, bb: Column) -> Column:
    """0 to 1 from the lane sums of two vectors and their squares."""
    whole = aa + bb
    estimate = F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * _product(a, b) / whole))).otherwise(F.lit(0.0))
    return F.when(equal, F.lit(1.0)).otherwise(estimate)


def in_blocks(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``_id``, ``_text``, ``_block``, ``_at`` (place in the order) and ``_copy`` (the row belongs to the next block)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_of(text).alias("_text"))
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("_text"), F.col("_read")]
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(slices, *order).sortWithinPartitions(*order)
    placed = ranged.select("_id", "_text", F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_slice"))
    placed = materialize(placed, "in-order")
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(whole).alias("_rows"))
    placed = placed.join(F.broadcast(starts), "_slice")  # one row for each slice
    at = F.col("_start") + F.col("_in_slice")
    follows = F.when(at == 0, F.col("_rows")).otherwise(at)
    own = F.struct(F.floor(at / BLOCK).alias("_block"), at.alias("_at"), F.lit(False).alias("_copy"))
    copy = F.struct(F.floor((follows - 1) / BLOCK).alias("_block"), follows.alias("_at"), F.lit(True).alias("_copy"))
    places = F.when(at % BLOCK == 0, F.array(own, copy)).otherwise(F.array(own))
    return placed.select("_id", "_text", places.alias("_to")).select("_id", "_text", F.inline("_to"))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_column``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The edited text has its last half (rounded down) replaced by as many characters from the start of the next text, or all of them if there are fewer; the
    first row of the order comes after the last.  Its fingerprint is that of the text less the paragraphs that the edit touches, and the new ones.
    """
    by_place = Window.partitionBy("_block").orderBy("_at")
    size = F.char_length("_text")
    rows = in_blocks(docs, id_column, text).withColumn("_next", F.lead("_text").over(by_place))
    rows = rows.withColumn("_cut", F.when(F.col("_copy"), F.lit(0)).otherwise(F.floor(size / 2).cast("int")))
    rows = rows.withColumn("_head", F.substr("_text", F.lit(1), size - F.col("_cut")))
    rows = rows.withColumn("_new", F.substr("_next", F.lit(1), F.col("_cut"))).withColumn("_line", F.substring_index("_head", "\n", -1))
    about = F.struct(
        F.col("_id").alias("id"), "_copy", size.cast("bigint").alias("n_chars"), F.unhex(F.sha2(F.concat("_head", F.coalesce("_new", F.lit(""))), 256)).alias("sha")
    )
    kept = F.char_length("_head") - F.char_length("_line") - 1
    parts = {
        "kept": F.when(kept >= 0, paragraphs(F.substr("_head", F.lit(1), kept))),
        "old": paragraphs(F.concat("_line", F.substr("_text", size - F.col("_cut") + 1, F.col("_cut")))),
        "new": F.when(~F.col("_copy"), paragraphs(F.concat("_line", "_new"))),
    }
    listed = F.array(*[F.struct(F.lit(i).alias("_part"), lines.alias("_lines")) for i, lines in enumerate(parts.values())])
    listed = rows.select("_block", "_at", about.alias("_about"), listed.alias("_parts")).select("_block", "_at", "_about", F.explode_outer("_parts").alias("_p"))
    listed = listed.select("_block", "_at", "_about", "_p.*")
    # Blocks are whole in a task, so the sums by row and the neighbours' vectors need no further shuffle.
    summed = fingerprints(listed, ["_block", "_at", "_about", "_part"], "_lines")
    rows = summed.groupBy("_block", "_at", "_about").agg(
        *[F.first(F.when(F.col("_part") == i, F.col("vector")), ignorenulls=True).alias(f"_{name}") for i, name in enumerate(parts)]
    )
    old, new = F.coalesce("_old", none()), F.coalesce("_new", none())
    rows = rows.withColumn("_whole", plus(F.coalesce("_kept", none()), old)).withColumn("_edited", plus(minus(F.col("_whole"), old), new))
    rows = rows.select(
        "_block", "_at", "_about", *[printed(F.col(c)).alias(f"{c}_print") for c in ("_whole", "_edited")],
        *[sums(F.col(c)).alias(f"{c}_sums") for c in ("_whole", "_edited")],
    )
    rows = rows.withColumns({f"{c}_square": _product(F.col(f"{c}_sums"), F.col(f"{c}_sums")) for c in ("_whole", "_edited")})
    rows = rows.withColumns({f"_next_{c}": F.lead(f"_whole_{c}").over(by_place) for c in ("print", "sums", "square")}).filter(~F.col("_about._copy"))

    def near(side: str) -> Column:
        of = {c: F.col(f"{side}_{c}") for c in ("print", "sums", "square")}
        return likeness(F.col("_whole_print") == of["print"], F.col("_whole_sums"), of["sums"], F.col("_whole_square"), of["square"])

    return rows.select(
        F.col("_about.id").alias(id_column), F.col("_about.n_chars").alias("n_chars"), F.lower(F.hex("_about.sha")).alias("edited_sha256"),
        F.col("_whole_print").alias("fingerprint"), F.col("_edited_print").alias("edited_fingerprint"), near("_edited").alias("near_edited"), near("_next").alias("near_next"),
    )
