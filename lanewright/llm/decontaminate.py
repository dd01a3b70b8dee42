"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are lower-cased runs of letters and digits.  A seed is the hash of the words that a fixed mask leaves in view; the positions
between them are ignored, so a word that was replaced there does not hide the match.  Seeds of the texts are joined to those of the
benchmark.  Each hit names an item and a diagonal (place in the text minus place in the item), and the overlap on it is verified word
by word: a text is contaminated if ``SPAN`` aligned words in a row, or all words of a shorter item, match with at most one in ``ONE_IN``
replaced.  The first mask alone is hit by every stretch of 13 words with two replaced ones, wherever they are.  The two masks miss replaced
words in items of under ``MASKED`` words, so those are posted under runs of adjacent words instead: the whole item if no word of it may be
replaced, else its two halves, one of which a single replaced word leaves alone.  Texts are searched only with the masks that the benchmark has
posted, so short items cost nothing where there are none.

Items of any length are found; an item of one word contaminates every text that has the word.  Items with equal words count as one, the smallest id.
Items are told apart by their words, so an item without an id contaminates too, and is listed as one null after the other ids.  Null and
empty texts and items hit nothing.  Hits are kept by a hash of the text and not by its id, and every row verifies them on its own words: ids may repeat, be null or of
any type, equal texts are looked up once, and texts whose hashes collide only verify more.  An empty benchmark contaminates nothing.

The seeds of the benchmark are sent to all tasks only after they have been counted and found to be at most
``MOST_SENT``; a larger benchmark is joined by shuffling, with the same result.  Hits are reduced to distinct diagonals before they travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import text_of
from lanewright.session import materialize

#: Offsets of the words that a mask leaves in view.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
SPAN = 13
ONE_IN = 6
#: Fewest words of an item that ``MASKS`` find wherever words are replaced; shorter ones are posted under ``RUNS``.
MASKED = 10
RUNS = tuple(tuple(range(n)) for n in range(1, MASKED // 2 + 1))
EVERY = dict(enumerate(MASKS + RUNS))
MOST_SENT = 500_000


def word_array(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str], words: str = "_words", masks: dict[int, tuple[int, ...]] = EVERY) -> DataFrame:
    """``keep``, ``_at`` (place), ``_mask`` and ``_seed`` of every place and mask."""
    reach = max(mask[-1] for mask in masks.values()) + 1
    size = F.size(words)
    shifted = [F.slice(words, F.lit(i + 1), F.greatest(size - i, F.lit(0))).alias(f"w{i}") for i in range(reach)]
    placed = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("_at", "_w"))
    made = [
        F.struct(F.lit(i).alias("_mask"), F.when(F.col(f"_w.w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"_w.w{o}") for o in mask])).alias("_seed"))
        for i, mask in masks.items()
    ]
    return placed.select(*keep, "_at", F.explode(F.array(*made)).alias("_s")).select(*keep, "_at", "_s.*").filter("_seed is not null")


def item_seeds(items: DataFrame) -> DataFrame:
    """``_item``, ``_item_at``, ``_mask`` and ``_seed``: all places under ``MASKS``, or the run or the two halves of a short item."""
    n, run = F.size("_item_words"), F.col("_mask") - len(MASKS) + 1
    halves = (F.col("_at") == 0) & (run == F.floor(n / 2)) | (F.col("_at") == F.floor(n / 2)) & (run == n - F.floor(n / 2))
    posted = F.when(n >= MASKED, run < 1).when(n >= ONE_IN, halves).otherwise(run == n)
    made = seeds(items, ["_item", "_item_words"], "_item_words")
    return made.filter(posted).select("_item", F.col("_at").alias("_item_at"), "_mask", "_seed")


def benchmark_items(benchmark: DataFrame, item_column: str = "item_id", text: str = "text") -> DataFrame:
    """``_item`` (a number, stable once written), ``_item_id`` and ``_item_words`` of the different items that have words."""
    items = benchmark.select(F.col(f"`{item_column}`").alias("_item_id"), word_array(text_of(text)).alias("_item_words"))
    items = items.filter(F.size("_item_words") > 0).groupBy("_item_words").agg(F.min("_item_id").alias("_item_id"))
    return items.withColumn("_item", F.monotonically_increasing_id())


def _best_stretch(words: Column, hit: Column) -> Column:
    """Most equal words in an aligned stretch of ``SPAN`` words (or the whole item) on a hit's diagonal; -1 if none fits."""
    item, diagonal = hit["words"], hit["diagonal"]
    first = F.greatest(F.lit(0), -diagonal)
    length = F.least(F.size(item), F.size(words) - diagonal) - first
    span = F.least(F.lit(SPAN), F.size(item))
    same = F.zip_with(
        F.slice(item, first + 1, F.greatest(length, F.lit(0))), F.slice(words, first + diagonal + 1, F.greatest(length, F.lit(0))),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )

    def at(start: Column) -> Column:
        return F.aggregate(F.slice(same, start + 1, span), F.lit(0), lambda total, x: total + x)

    return F.when(length >= span, F.array_max(F.transform(F.sequence(F.lit(0), length - span), at))).otherwise(F.lit(-1))


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """Every row of ``docs``: ``keep`` and ``_items``, the sorted ids of the benchmark items that it overlaps."""
    rows = docs.select(F.struct(*keep).alias("_kept"), text_of(text).alias("_text")).withColumn("_id", F.xxhash64("_text"))
    items = materialize(benchmark_items(benchmark), "items")
    posted = materialize(item_seeds(items), "seeds")
    searched = F.broadcast(posted) if posted.count() <= MOST_SENT else posted
    used = {r["_mask"]: EVERY[r["_mask"]] for r in posted.select("_mask").distinct().collect()} or EVERY  # one row per mask

    found = seeds(rows.select("_id", word_array(F.col("_text")).alias("_words")), ["_id"], masks=used).join(searched, ["_mask", "_seed"])
    hits = found.select("_id", "_item", (F.col("_at") - F.col("_item_at")).alias("diagonal")).distinct()
    hits = hits.join(items, "_item").groupBy("_id").agg(
        F.collect_list(F.struct(F.col("_item_id").alias("item"), "diagonal", F.col("_item_words").alias("words"))).alias("_hits")
    )
    hits = materialize(hits.withColumnRenamed("_id", "_hit_id"), "hits")
    # The hits are the hinted side: the texts are streamed past them, neither sorted nor sent to all tasks.
    joined = rows.join(hits.hint("shuffle_hash"), F.col("_id") == F.col("_hit_id"), "left")
    words = joined.select("_kept", "_hits", F.when(F.col("_hits").isNotNull(), word_array(F.col("_text"))).alias("_words"))

    def leaks(hit: Column) -> Column:
        span = F.least(F.lit(SPAN), F.size(hit["words"]))
        return span - _best_stretch(F.col("_words"), hit) <= F.floor(span / ONE_IN)

    matched = F.array_sort(F.array_distinct(F.transform(F.filter("_hits", leaks), lambda hit: hit["item"])))
    none = F.slice(F.array(F.lit(None).cast(items.schema["_item_id"].dataType)), 1, 0)
    return words.select("_kept.*", F.coalesce(matched, none).alias("_items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_column``, ``leaked`` and ``items``, the ids of the benchmark items it overlaps."""
    judged = judge(docs, benchmark, [F.col(f"`{id_column}`")], text)
    return judged.select(id_column, (F.size("_items") > 0).alias("leaked"), F.col("_items").alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns."""
    judged = judge(docs, benchmark, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")], text)
    return judged.filter(F.size("_items") == 0).select("_row.*")
