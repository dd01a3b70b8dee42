"""Fingerprints against the same sums made in Python, and their algebra."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from lanewright.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, _id string, _block string, fingerprint string"
RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(300)]


def prose(lines, words=8):
    return "\n".join(" ".join(RNG.choice(WORDS) for _ in range(words)) for _ in range(lines))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


def spark_hash(*values):
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else v.to_bytes(8 if isinstance(v, Long) else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


class Long(int):
    """A whole number of 64 bits."""


def signed(x):
    return Long(x - (1 << 64) if x >> 63 else x)


def brute_print(text):
    exact, signs = [0] * fp.EXACT, [0] * (fp.SIGNS // 2)
    for line in text.split("\n"):
        digest = hashlib.sha512(line.encode()).digest()
        for k in range(fp.EXACT // 2):
            x = spark_hash(k, digest)
            exact[2 * k] += x & 0xFFFFFFFF
            exact[2 * k + 1] += x >> 32
        words = [signed(spark_hash(w.encode())) for w in line.split()]
        for i in range(len(words)):
            shingle = signed(spark_hash(*words[i : i + fp.WIDTH]))
            for k in range(fp.SIGNS // 64):
                x = spark_hash(k, shingle)
                for bit in range(32):
                    signs[32 * k + bit] += (x >> bit) & fp.BOTH
    return "".join(f"{x % (1 << 32):08X}" for x in exact) + "".join(f"{x:016X}" for x in signs)


def brute_edits(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(text), brute_print(edited))
    return out


def test_edits_of_tables(spark):
    rows = [(i * 3, prose(RNG.randint(1, 6))) for i in range(300)]
    rows += [(1, None), (2, ""), (4, "x"), (5, "\n\n"), (7, "é" * 41), (8, "w" * 100_000), (10, prose(400, 40)), (11, prose(1, 20_000)), (13, rows[0][1]), (1000, " a\n b ")]
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(table(spark, rows)).collect()}
    want = brute_edits(rows)
    assert set(got) == set(want)
    for i, (n, digest, whole, edited) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, digest, whole, edited), i
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[0]["fingerprint"] == got[13]["fingerprint"]
    usual = [r for r in got.values() if 50 < r["n_chars"] < 1000]
    assert sum(0.3 < r["near_edited"] < 0.75 and r["near_next"] < 0.35 for r in usual) > 0.9 * len(usual)


def test_null_and_repeated_ids_one_row_and_none(spark):
    rows = [(None, prose(2)) for _ in range(150)] + [(7, "same text")] * 140
    made = fp.edited_fingerprints(table(spark, rows)).collect()
    assert len(made) == 290 and sum(r["doc_id"] is None for r in made) == 150
    assert sum(r["near_next"] == 1.0 and r["near_edited"] < 1.0 for r in made if r["doc_id"] == 7) >= 139
    alone = fp.edited_fingerprints(table(spark, [(1, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1.0
    assert fp.edited_fingerprints(table(spark, [])).count() == 0


def test_paragraphs_are_a_multiset(spark):
    lines = [prose(1) for _ in range(6)] + [""]
    base, extra = [*lines, lines[0]], [lines[1], lines[1], "one more"]
    shuffled = RNG.sample(base, len(base))
    rows = spark.createDataFrame([("base", base), ("shuffled", shuffled), ("more", base + extra), ("extra", extra), ("once", lines)], "name string, lines array<string>")
    made = fp.fingerprints(rows, ["name"], "lines").groupBy().pivot("name").agg(F.first("vector"))
    v = {c: F.col(c) for c in made.columns}
    sums = {"whole": v["base"], "other": v["shuffled"], "single": v["once"], "less": fp.minus(v["more"], v["extra"]), "sum": fp.plus(v["extra"], v["base"]), "all": v["more"],
            "zero": fp.minus(v["base"], v["base"]), "nothing": fp.none()}
    row = made.select(*[fp.printed(x).alias(f"print_{c}") for c, x in sums.items()]).first()
    assert row["print_whole"] == row["print_other"] == row["print_less"] != row["print_single"]
    assert row["print_sum"] == row["print_all"] and row["print_zero"] == row["print_nothing"]
