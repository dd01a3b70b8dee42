"""Toxicity: maximum-scoring passages of token log-odds, with extreme-value significance.

Model.  Units are whole words and word beginnings of 3 to 8 characters.  A unit's score is its log-odds between toxic and
clean labelled texts with an informative Dirichlet prior: the pooled rate of the unit, worth ``PRIOR_TEXTS`` texts.  Only units whose
log-odds are more than ``LEAST_Z`` standard errors above zero are kept, if a text that has one is toxic with a chance of at
least ``THRESHOLD``, and a shorter beginning only if it covers clearly more texts than a longer one.  Texts that copy each other would lend a rare word their number, so a unit counts no more toxic
texts than it has different neighbours (left and right word) there.

Scan.  A word scores its best unit, or ``GAP`` below zero if it has none.  One linear pass (Ruzzo and Tompa) finds every maximal-scoring
passage.  Under the clean model the number of passages of score S or more among n words is Poisson with mean
``K n exp(-lambda S)``, where lambda solves ``E[exp(lambda s)] = 1``; the text's p-value is that of its best, its two best, ...
passages, whichever is smallest.  The score is the posterior ``prior / (prior + (1 - prior) p)``.

The labelled rows used are at most about ``MAX_LABELLED`` (a hash of the id picks them), so the fitted tables, which are sent to all tasks, have
a bound that does not grow with the corpus.  Every text is scored whole.  Null and empty texts have p = 1 and score the prior.  Labels that
are null or of unknown rows are ignored; without labels of both kinds nothing is found and the prior is 0.5 or the
smoothed share.  Ties between passages are ordered by place.  Only the key columns are kept, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.llm.common import keyed, short_batches, text_of, with_arrow_column
from lanewright.session import materialize

MAX_LABELLED = 20_000
PRIOR_TEXTS = 50.0
LEAST_Z = 1.96
COVERS = 0.9
GAP = 0.5
THRESHOLD = 0.7
#: Counts that one task holds before it hands them on.
MOST_COUNTS = 400_000

WORDS = re.compile(r"\w+").findall
SHORTEST, LONGEST = 3, 8
PASSAGE = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
])
RESULT = T.StructType([
    T.StructField("n_words", T.IntegerType()), T.StructField("passages", T.ArrayType(PASSAGE)), T.StructField("p_value", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])


@dataclass(frozen=True)
class ToxicModel:
    """Scores of units (whole words end in ``$``), the calibration of the scan, and the share of toxic texts."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    prior: float = 0.5

    def word_score(self, word: str) -> float:
        """The best score of the word's units, 0 if it has none."""
        scores = self.scores
        best = scores.get(word + "$", 0.0)
        for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            found = scores.get(word[:k])
            if found is not None and found > best:
                best = found
        return best


def units(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]]


def maximal_passages(hits: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal-scoring passages (first word, end, score); ``hits`` are the words above zero by place, all others score ``-gap``.

    Candidates are kept with the running totals before and after them and a link to the last one that starts lower, so
    the pass is linear, as Ruzzo and Tompa show.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, link
    total, at = 0.0, 0
    for place, score in hits:
        total -= gap * (place - at)
        first, before = place, total
        total, at = total + score, place + 1
        after = total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((first, place + 1, before, after, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(first, end, after - before) for first, end, before, after, _ in found]


def p_value(model: ToxicModel, n_words: int, scores: list[float]) -> float:
    """The smallest, over every r, chance that a clean text of this length has r passages as good as its r best."""
    best = 1.0
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        mean = model.scale * n_words * math.exp(-model.decay * score)
        if r == 1:
            best = -math.expm1(-mean)
        # A tail is never under its first term, nor under a half if r or more are expected, so no smaller chance is passed over.
        elif best > 0.5 if mean >= r else mean > 0 and math.exp(r * math.log(mean) - mean - math.lgamma(r + 1)) < best:
            best = min(best, _poisson_tail(r, mean))
    return max(best, 1e-300)


def _poisson_tail(r: int, mean: float) -> float:
    """The chance of r or more events: from r on if fewer are expected, so that small values stay exact, else 1 less the terms below r."""
    if mean <= 0:
        return 0.0
    k = r - 1 if mean >= r else r
    term = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
    total = term
    if mean >= r:
        while k > 0 and term > total * 1e-16:
            term *= k / mean
            total += term
            k -= 1
        return max(0.0, 1.0 - total)
    while term > total * 1e-16:
        k += 1
        term *= mean / k
        total += term
    return min(1.0, total)


def score_text(model: ToxicModel, text: str) -> dict:
    words = WORDS(text.lower())
    known: dict[str, float] = {}
    hits = []
    for place, word in enumerate(words):
        score = known.get(word)
        if score is None:
            score = known[word] = model.word_score(word)
        if score > 0:
            hits.append((place, score))
    passages = maximal_passages(hits)
    # Words repeat in bursts, so a passage is evidence only if it has a hit that no better passage has.
    evidence, seen = [], set()
    for first, end, score in sorted(passages, key=lambda x: -x[2]):
        new = {w for w in words[first:end] if known[w] > 0} - seen
        if new:
            evidence.append(score)
            seen |= new
    p = p_value(model, len(words), evidence) if evidence else 1.0
    return {
        "n_words": len(words), "passages": [{"start": a, "end": b, "score": s} for a, b, s in passages], "p_value": p,
        "score": model.prior / (model.prior + (1 - model.prior) * p),
    }


def _log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> tuple[float, float]:
    """Log-odds with the Dirichlet prior, and their z-score."""
    prior = PRIOR_TEXTS * (toxic + clean) / (n_toxic + n_clean)
    odds = math.log((toxic + prior) / (n_toxic + PRIOR_TEXTS)) - math.log((clean + prior) / (n_clean + PRIOR_TEXTS))
    return odds, odds / math.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def _solve_decay(rates: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(lambda s)] = 1 over the hits' (rate, score) and the gap score of all other words."""
    rest = 1 - sum(rate for rate, _ in rates)

    def excess(x: float) -> float:
        return sum(rate * math.exp(min(x * score, 700.0)) for rate, score in rates) + rest * math.exp(-x * GAP) - 1

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, most: int) -> DataFrame:
    """``_text`` and ``_toxic`` of the labelled rows, about ``most`` of them at most; ids that occur twice in the labels count once."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(f"`{id_column}`").alias("_id")).agg(F.max(label).alias("_toxic"))
    known = materialize(known, "labels")
    share = min(1.0, most / max(1, known.count()))
    slot = F.pmod(F.xxhash64(F.col("_id"), F.lit("labelled")), F.lit(1 << 20))
    chosen = known.filter(slot < int(share * (1 << 20)))
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_of(text).alias("_text"))
    # At most about ``most`` rows of two numbers: small enough for every executor at any size of the corpus.
    return rows.join(F.broadcast(chosen), "_id").select("_text", "_toxic")


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    totals = [0, 0, 0]

    def flush():
        names = list(toxic.keys() | clean.keys())
        yield _count_batch(names, [toxic[u] for u in names], [clean[u] for u in names])
        toxic.clear()
        clean.clear()

    for batch in batches:
        for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = WORDS(text.lower())
            totals[1 - mark] += 1
            totals[2] += len(words)
            (toxic if mark else clean).update({u for w in set(words) for u in units(w)})
            if len(toxic) + len(clean) > MOST_COUNTS:
                yield from flush()
    yield from flush()
    yield _count_batch(["", " "], [totals[0], totals[2]], [totals[1], 0])


def _count_batch(names: list[str], toxic: list[int], clean: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["unit", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> ToxicModel:
    """Learn from ``labels`` (id, label 0 or 1); pass only the rows that may be learned from."""
    spark = docs.sparkSession
    short_batches(spark)
    sample = materialize(labelled_sample(docs, labels, id_column, text, label, most), "sample")
    marked = sample.select("_text", (F.col("_toxic") == 1).cast("int").alias("_mark"))
    counts = marked.mapInArrow(_unit_counts, "unit string, toxic bigint, clean bigint").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    counts = materialize(counts, "units")
    totals = {r["unit"]: r for r in counts.filter(F.col("unit").isin("", " ")).collect()}
    n_toxic, n_clean = (totals[""]["toxic"], totals[""]["clean"]) if totals else (0, 0)
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    if not n_toxic or not n_clean:
        return ToxicModel(prior=prior)
    mean_words = max(1.0, totals[" "]["toxic"] / (n_toxic + n_clean))

    # The sample bounds the number of units; those that can pass are fetched, then tried again with their neighbours counted.
    apart = F.col("toxic") / n_toxic > F.col("clean") / n_clean
    tried = {
        r["unit"]: (r["toxic"], r["clean"])
        for r in counts.filter(apart & (F.col("toxic") >= 2) & ~F.col("unit").isin("", " ")).toLocalIterator()
        if _log_odds(r["toxic"], r["clean"], n_toxic, n_clean)[1] > LEAST_Z
    }
    sent = spark.sparkContext.broadcast(frozenset(tried))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            pairs = set()
            for body in batch.column(0).to_pylist():
                words = WORDS(body.lower())
                for i, word in enumerate(words):
                    for unit in units(word):
                        if unit in wanted:
                            pairs.add((unit, f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"))
            yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in pairs], pa.string()), "around": pa.array([a for _, a in pairs], pa.string())})

    around = marked.filter("_mark = 1").select("_text").mapInArrow(neighbours, "unit string, around string")
    apart_of = {r["unit"]: r["n"] for r in around.distinct().groupBy("unit").agg(F.count("*").alias("n")).toLocalIterator()}
    least = math.log(n_clean / n_toxic) + math.log(THRESHOLD / (1 - THRESHOLD))
    kept: dict[str, tuple[float, float]] = {}
    scores: dict[str, float] = {}
    for unit, (toxic, clean) in tried.items():
        toxic = min(toxic, apart_of.get(unit, 0))
        if toxic >= 2:
            odds, z = _log_odds(toxic, clean, n_toxic, n_clean)
            if z > LEAST_Z and odds >= least:
                kept[unit], scores[unit] = (toxic, clean), odds
    for unit in sorted(kept, key=len, reverse=True):
        word = unit.rstrip("$")
        for k in range(SHORTEST, len(word) + (unit != word)):
            if word[:k] in scores and kept[word[:k]][0] * COVERS <= kept[unit][0]:
                del scores[word[:k]]
    rates = []
    for unit, score in scores.items():
        toxic, clean = kept[unit]
        prior_texts = PRIOR_TEXTS * (toxic + clean) / (n_toxic + n_clean)
        rates.append(((clean + prior_texts) / (n_clean + PRIOR_TEXTS) / mean_words, score))
    if not rates:
        return ToxicModel(prior=prior)
    decay = _solve_decay(rates)
    return ToxicModel(scores, decay, -math.expm1(-decay * GAP), prior)


def score(docs: DataFrame, model: ToxicModel, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``n_words``, ``passages`` (start, end, score; in words), ``p_value`` and ``score`` of each whole text."""
    spark = docs.sparkSession
    short_batches(spark)
    rows, names = keyed(docs, keys, _text=text_of(text))
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([
        ("n_words", pa.int32()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
        ("p_value", pa.float64()), ("score", pa.float64()),
    ])

    def convert():
        fitted = sent.value
        return lambda texts: [score_text(fitted, x) for x in texts]

    made = with_arrow_column(rows, "_text", "_result", RESULT, kind, convert)
    return made.select(*names, "_result.*").withColumnsRenamed(names)


def learnable(id_column: str = "doc_id"):
    """Rows whose labels may be learned: crc32 of the id as text leaves another remainder than 1 when divided by 3."""
    return ~held_out(id_column)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def keep_clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under ``threshold``."""
    model = fit(docs, labels.filter(learnable(id_column)), id_column, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    short_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        for texts in batches:
            yield texts.map(lambda x: score_text(fitted, x)["score"]).astype("float64")

    return docs.filter(toxic(text_of(text)) < threshold)
