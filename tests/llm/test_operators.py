"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lanewright.llm import byte_bpe, decontaminate, html_text, near_dedup, preferences, radix_dedup, suffix_dedup, token_counts, toxicity, url_filter
from lanewright.llm.graph import components
from lanewright.llm.queries import BYTE_RANKS, PIECE_MODEL, URL_RULES

#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, ids string, _row string, _id string, _text string, `row` int"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "a", "b", "c", "d", 1) for i, t in enumerate(texts)], SCHEMA)


def edge_texts():
    base = prose(120)
    return [
        None, "", " \n\t", "Hello World", "hello world", "HELLO WORLD", base, base, base.upper(), base + " end", "é" * 300, "x" * 300_000, prose(30_000), "a\u00a0b  c\n\n d's 12",
    ]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Byte BPE


def test_bpe_round_trip_and_library(spark):
    texts = [*edge_texts(), "1 < 2 <|endoftext|> \U0001f600 \x1c!\x1c  \r\n x", prose(200_000)]
    docs = table(spark, texts)
    tokens = byte_bpe.encode(docs, BYTE_RANKS, ["doc_id", "ids"])
    assert tokens.columns == ["doc_id", "ids", "ids"]
    made = byte_bpe.decode(byte_bpe.encode(docs, BYTE_RANKS, ["doc_id"]), BYTE_RANKS, ["doc_id"]).collect()
    library = byte_bpe.encoding(BYTE_RANKS)
    for row in made:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == library.encode_ordinary(text)
        assert bytes(row["raw"]) == text.encode()
    assert byte_bpe.encode(empty(spark), BYTE_RANKS, ["doc_id"]).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), BYTE_RANKS, ["doc_id"]).first()["raw"] == b""


def test_bpe_pieces_are_safe_everywhere():
    library, rng = byte_bpe.encoding(BYTE_RANKS), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab Z9.,!'\n\t é中\u00a0\x1c😀s") for _ in range(rng.randint(0, 40)))
        assert "".join(byte_bpe.pieces(text, 3)) == text
        assert byte_bpe.encode_text(library, text, 3).tolist() == library.encode_ordinary(text)
    assert isinstance(library, tiktoken.Encoding)


# Token counts


def test_token_counts_and_cache(spark):
    texts = edge_texts()
    docs = table(spark, texts).unionByName(table(spark, texts[3:6])).unionByName(spark.createDataFrame([(None, "Hello World", *"abcd", 1)], SCHEMA))
    cache = token_counts.new_cache(spark)
    rows = token_counts.count_tokens(docs, PIECE_MODEL, cache).collect()
    assert len(rows) == docs.count()
    library = token_counts.processor(PIECE_MODEL)
    texts_of = [(i, t or "") for i, t in [*enumerate(texts), *enumerate(texts[3:6]), (None, "Hello World")]]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == Counter((i, len(t.encode()), len(library.encode(t))) for i, t in texts_of)
    stored = token_counts.read_cache(spark, cache)
    digests = stored.select("content").distinct().count()
    assert digests == len({hashlib.sha256((t or "").encode()).digest() for t in texts})
    before = stored.count()
    token_counts.count_tokens(docs, PIECE_MODEL, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == before, "a second run encodes nothing"
    assert token_counts.count_tokens(empty(spark), PIECE_MODEL, token_counts.new_cache(spark)).count() == 0


def test_a_digest_is_encoded_once_whatever_its_ids(spark):
    """Fifty rows without an id, fifty with one id, and repeated rows; a cache that knows some of the texts is only added to."""
    rows = [(None, "one text", *"abcd", 1)] * 50 + [(7, "one text", *"abcd", 1)] * 50 + [(None, None, *"abcd", 1), (None, "", *"abcd", 1), (7, "another", *"abcd", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cache = token_counts.new_cache(spark)
    assert token_counts.count_tokens(docs.limit(1), PIECE_MODEL, cache).count() == 1
    made = token_counts.count_tokens(docs, PIECE_MODEL, cache)
    library = token_counts.processor(PIECE_MODEL)
    expected = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in made.collect()) == expected
    assert token_counts.read_cache(spark, cache).count() == 3


# URL filter


def test_url_rules_and_terms(spark):
    cases = {
        "http://A.Example.ORG/es/x?y=1": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://org": ("org", "", None, "allow"),
        "http://b.com/fr/porn": ("b.com", "/fr/porn", "com/fr/", "allow"),
        "http://b.com/en/porn": ("b.com", "/en/porn", None, "block"),
        "http://b.com/en/pornography": ("b.com", "/en/pornography", None, "allow"),
        "http://ads-track.b.net/x": ("ads-track.b.net", "/x", None, "block"),
        "http://ads.b.net/ads": ("ads.b.net", "/ads", None, "allow"),
        "http://b.net?q=/a": ("b.net", "", None, "allow"),
        "no scheme/org/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://b.net/" + "a" * 100_000 + "/xxx": ("b.net", "/" + "a" * 100_000 + "/xxx", None, "block"),
    }
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases)], "page_id int, url string, host string, rule string")
    for row in url_filter.judge(pages, URL_RULES, ["page_id"]).collect():
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == list(cases.values())[row["page_id"]]
    assert url_filter.judge(pages.limit(0), URL_RULES, ["page_id"]).count() == 0


# Exact duplicates


@pytest.mark.parametrize("digit", [1, 4, 256])
def test_exact_duplicates(spark, digit):
    texts = [t for t in edge_texts() if not t or len(t) < 2000 or digit == 256]
    texts += ["abc", "abcd", "ABC", "abc", "", "é", "É"]
    docs = table(spark, texts).union(table(spark, ["twice"], 900)).union(table(spark, ["twice"], 900)).union(spark.createDataFrame([(None, "abc", *"abcd", 1)], SCHEMA))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    size = Counter(lower(t) for _, t in rows)
    best = {lower(t): max((i for i, u in rows if lower(u) == lower(t) and i is not None), default=None) for _, t in rows}
    got = radix_dedup.mark_duplicates(docs, first_digit=digit).collect()
    want = sorted((i if i is not None else -1, best[lower(t)], size[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(size)
    kept = radix_dedup.drop_duplicates(docs, first_digit=digit)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())
    assert radix_dedup.mark_duplicates(empty(spark)).count() == 0 and radix_dedup.drop_duplicates(empty(spark)).count() == 0


# Near duplicates


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_components(texts, percent):
    sets = brute_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts():
    rng = random.Random(11)
    texts = [t for t in edge_texts() if not t or len(t) < 250_000]
    for _ in range(12):
        words = prose(rng.randint(30, 250), rng).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    return texts + ["a b c", "A  b\nc", "a b", "one line that all share here " + prose(4, rng)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    texts = near_texts()
    want, sizes = brute_components(texts, percent)
    docs = table(spark, texts)
    rows = near_dedup.near_components(docs, percent).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in rows} == dict(enumerate(zip(want, sizes)))
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(near_dedup, "LIST_ROWS", 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs, percent).collect()} == dict(enumerate(want))
    kept = near_dedup.drop_near_duplicates(docs.union(spark.createDataFrame([(None, texts[6], *"abcd", 1)], SCHEMA)), percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)), "the row without an id belongs to a group that has one"


def test_collisions_of_posting_lists_are_counted_as_by_all_pairs():
    rng = np.random.default_rng(4)
    least, lists, signs = 20, [], []
    for number, size in enumerate([1, 2, 2, 3, 16, 17, 40, 90, 1]):
        bases = rng.integers(0, 1 << 31, (4, near_dedup.COORDINATES), dtype=np.int32)
        for _ in range(size):
            row = bases[rng.integers(4)].copy()
            row[rng.permutation(near_dedup.COORDINATES)[: rng.integers(0, 12)]] = rng.integers(0, 1 << 31)
            lists.append(number), signs.append(row)
    lists, signs, sizes = np.array(lists), np.stack(signs), rng.integers(80, 100, len(signs))
    want, got = near_dedup.Forest(), near_dedup.Forest()
    wanted = 0
    for a, b in itertools.combinations(range(len(lists)), 2):
        if lists[a] == lists[b] and (signs[a] == signs[b]).sum() >= least and 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b]):
            wanted += want.join(a, b)
    pairs = list(near_dedup.list_pairs(lists, sizes, signs, 85, least))
    assert sum(got.join(a, b) for a, b in pairs) == wanted > 50
    assert all(want.root(a) == want.root(b) for a, b in pairs)
    assert list(near_dedup.list_pairs(lists[:1], sizes[:1], signs[:1], 85, least)) == []


def test_texts_that_only_share_passages_make_no_cluster(spark, monkeypatch):
    rng = random.Random(21)
    pool = [prose(60, rng) for _ in range(60)]
    docs = table(spark, ["\n".join(rng.sample(pool, 4)) for _ in range(500)])
    counted, real = [], near_dedup.counted_pairs

    def spy(prefix, *rest):
        found = real(prefix, *rest)
        counted.append((prefix.select("rep").distinct().count(), components(found).groupBy("root").count().agg(F.max("count")).first()[0]))
        return found

    monkeypatch.setattr(near_dedup, "counted_pairs", spy)
    rows = near_dedup.near_components(docs, 85).collect()
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == list(range(500))
    sharing, largest = counted[0]
    assert sharing > 450 and (largest or 0) < 50


def test_near_duplicates_under_null_and_repeated_ids(spark):
    rng = random.Random(12)
    bases = [prose(100, rng) for _ in range(4)]
    near = lambda i, n: f"{bases[i]} {n}"
    pairs = [
        (3, near(0, "a")), (7, near(0, "b")), (7, prose(100, rng)),  # the second row of id 7 is a text of its own
        (None, near(1, "a")), (None, near(1, "b")), (None, near(1, "c")), (None, prose(100, rng)), (None, None), (None, ""),
        (9, near(2, "a")), (9, near(2, "b")), (11, near(2, "c")), (5, near(3, "a")), (5, near(3, "a")),
    ]
    docs = spark.createDataFrame([(i, t, str(n), "b", "c", "d", 1) for n, (i, t) in enumerate(pairs)], SCHEMA).coalesce(1)
    assert sorted(int(r["ids"]) for r in near_dedup.drop_near_duplicates(docs).collect()) == [0, 2, 3, 6, 7, 8, 9, 12]
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).filter("n_shingles > 0").collect()]
    null_first = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(rows, key=null_first) == sorted([
        (3, 3, True), (7, 3, False), (7, 7, True), (None, None, True), (None, None, False), (None, None, False), (None, None, True),
        (9, 9, True), (9, 9, False), (11, 9, False), (5, 5, True), (5, 5, False),
    ], key=null_first)


def test_words_that_differ_have_hashes_that_differ(spark):
    long = "y" * 65_535
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [f"x{long}z", f"z{long}x", thue, thue.translate(str.maketrans("ab", "ba")), "x" * 64 + "ab", "x" * 64 + "ba", "ab", "ba"]
    assert len({int(near_dedup.word_hashes(w)[0]) for w in words}) == len(words)
    assert [r["component_id"] for r in near_dedup.near_components(table(spark, words)).orderBy("doc_id").collect()] == list(range(len(words)))


def test_near_duplicates_with_text_ids(spark):
    body = prose(100, random.Random(3))
    docs = spark.createDataFrame([("b", body + " x"), ("a", body + " y"), (None, body + " z"), ("c", "other words")], "doc_id string, text string")
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect()}
    assert rows == {("a", "a", True), ("b", "a", False), (None, "a", False), ("c", "c", True)}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_components(empty(spark)).count() == 0
    assert near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_postings_are_never_sent_whole(spark, monkeypatch):
    """An explode makes 32 postings a class, which the planner takes for one row: their joins are not left to its size check."""
    plans, write = {}, near_dedup.materialize

    def watched(df, label="stage"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(near_dedup, "materialize", watched)
    texts = [prose(40) for _ in range(30)]
    assert near_dedup.near_components(table(spark, texts + texts[:5])).count() == 35
    assert "BroadcastHashJoin" not in plans["prefix"] and "BroadcastHashJoin" not in plans["counted"]


def test_word_hashes_do_not_depend_on_pieces():
    text = "Some words\tand\x0bmore é中 " * 50 + "w" * 3000
    for size in (1, 7, 100):
        assert (near_dedup.word_hashes(text, size) == near_dedup.word_hashes(text)).all()
    assert (near_dedup.shingle_set("A B c d E f") == near_dedup.shingle_set("a b C d e F")).all()


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (7, 7), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, **{100 + i: 100 for i in range(41)}}


# Repeated bytes


def repeat_texts():
    rng = random.Random(3)
    line, passage = prose(20, rng)[:120], prose(90, rng)
    texts = [f"{prose(rng.randint(5, 60), rng)} {line} {passage[rng.randint(0, 200):] if i % 3 else ''} {prose(20, rng)}" for i in range(25)]
    return [*texts, texts[0], texts[0], "Shti " * 120, "x" * 450, "é" * 150 + texts[1], None, "", "x" * 199]


@pytest.mark.parametrize("most", [5000, 3])
def test_repeated_bytes(spark, most):
    texts = repeat_texts()
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    for row in suffix_dedup.remove_repeats(table(spark, texts), most_in_group=most).collect():
        body = bodies[row["doc_id"]]
        spans = suffix_dedup.merge_spans([(i, i + 200) for i in range(len(body) - 199) if seen[body[i : i + 200]] > 1])
        assert [(s["start"], s["end"]) for s in row["removed"]] == spans
        gone = {i for a, b in spans for i in range(a, b)}
        assert bytes(row["kept"]) == bytes(c for i, c in enumerate(body) if i not in gone)
        assert row["n_bytes"] == len(body)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_a_line_of_a_third_of_all_texts(spark):
    """24,000 texts hold one line between words of their own: the group is split, and just the line goes."""
    line = prose(60, random.Random(8))[:260]
    own = F.concat_ws(" ", *[F.sha2(F.concat(F.lit(part), F.col("id").cast("string")), 256) for part in "abcdef"])
    docs = spark.range(72_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.substring(own, 1, 150), F.lit("|" + line + "|"), F.substring(own, 200, 150))).otherwise(own).alias("text"),
    )
    cut = suffix_dedup.remove_repeats(docs).select("doc_id", F.size("removed").alias("n"), F.get("removed", F.lit(0))["start"].alias("a"), F.get("removed", F.lit(0))["end"].alias("b"))
    found = {tuple(r) for r in cut.groupBy((F.col("doc_id") % 3 == 0).alias("has"), "n").agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.count("*")).collect()}
    hexes = 16  # A hex digit on either side of the line may be that of another text; so may two or more.
    assert {(h, n, c) for h, n, *_, c in found} == {(True, 1, 24_000), (False, 0, 48_000)}
    for has, _, a, a_most, b, b_most, _ in found:
        assert not has or (150 - hexes < a <= a_most <= 150 and 152 + len(line) <= b <= b_most < 152 + len(line) + hexes)


def test_equal_hashes_of_different_bytes_remove_nothing(spark):
    """All contexts are given one gram hash, whatever their bytes, and are cut down to parts of three."""
    rng = random.Random(4)
    half = bytes(rng.randrange(97, 123) for _ in range(300))
    contexts = [bytes(rng.randrange(97, 123) for _ in range(40)) + half[i % 7 :] + bytes(rng.randrange(97, 123) for _ in range(60)) for i in range(40)]
    rows = [(i, 5, 100 + i % 2, 0, len(c) - 200, c) for i, c in enumerate(contexts)]
    rows = [(i, g, at, max(first, at - 168), min(last, at), c) for i, g, at, first, last, c in rows]
    rows = [(i, g, at, first, last, c[first : last + 200]) for i, g, at, first, last, c in rows]
    seen = Counter((at - f - k, c[k : k + 200]) for _, _, at, f, last, c in rows for k in range(last - f + 1))
    expected = {(i, f + k) for i, _, at, f, last, c in rows for k in range(last - f + 1) if seen[(at - f - k, c[k : k + 200])] > 1}
    frame = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], suffix_dedup.CONTEXT)
    sort = lambda df: df.repartition("gram").sortWithinPartitions("gram").mapInArrow(suffix_dedup._sorted_spans, "row bigint, start bigint, end bigint")
    for most in (3, 1000):
        got = {(r["row"], s) for r in suffix_dedup._split_spans(frame, most, sort).collect() for s in range(r["start"], r["end"] - 199)}
        assert got == expected and expected
    strangers = [(i, 9, 0, 0, 0, bytes(rng.randrange(256) for _ in range(200))) for i in range(5)]
    assert suffix_dedup._spans_of(strangers).num_rows == 0


def test_anchors_do_not_depend_on_pieces_and_suffixes_sort():
    data = np.frombuffer(prose(800).encode(), dtype=np.uint8)
    whole, parts = suffix_dedup.anchors(data), suffix_dedup.anchors(data, size=100)
    covered = lambda a: {(int(at), s) for at, x, y in zip(*a[1:]) for s in range(x, y + 1)}
    assert covered(whole) == covered(parts) and len({s for _, s in covered(whole)}) == len(data) - 199
    at = np.sort(np.random.default_rng(0).integers(0, 3000, 300))
    size, group = np.minimum(150, len(data) - at), np.repeat([0, 1, 2], 100)
    order = suffix_dedup.sort_suffixes(data, suffix_dedup.Hashes(data), at, size, group)
    got = [(int(group[i]), data[at[i] : at[i] + size[i]].tobytes()) for i in order]
    assert got == sorted(got)


# Toxicity


def toxic_corpus(n=600):
    rng = random.Random(8)
    texts, marks = [], []
    for i in range(n):
        words = prose(rng.randint(5, 80), rng).split()
        toxic = i % 8 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vile", "scummy", "zorgak", "zorgut", "zorgin"]))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    return texts, marks


def test_toxicity_on_held_out_rows(spark):
    texts, marks = toxic_corpus()
    docs = table(spark, [*texts, None, "", prose(40_000)])
    labels = spark.createDataFrame([*enumerate(marks), (3, None), (None, 1), (10**9, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels.filter(toxicity.learnable()))
    rows = toxicity.score(docs, model, ["doc_id", "_id"]).withColumn("held", toxicity.held_out()).collect()
    by_id = {r["doc_id"]: r for r in rows}
    held = [r["doc_id"] for r in rows if r["held"] and r["doc_id"] < len(marks)]
    assert len(held) > 100 and all((by_id[i]["score"] >= 0.7) == bool(marks[i]) for i in held)
    assert all(by_id[len(marks) + i]["score"] < 0.7 for i in range(3))
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows if r["score"] < 0.7}
    assert toxicity.score(empty(spark), model, ["doc_id"]).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).scores == {}
    assert toxicity.fit(empty(spark), labels).prior == 0.5


def test_maximal_passages_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 14)
        scores = [rng.choice([-0.5, -0.5, 1.0, 2.0, 0.75]) for _ in range(n)]
        sums = np.concatenate(([0.0], np.cumsum(scores)))

        def maximal(a, b, sums=sums):
            parts = [sums[j] - sums[i] for i in range(a, b + 1) for j in range(i + 1, b + 1) if (i, j) != (a, b)]
            return sums[b] - sums[a] > max([0.0, *parts])

        every = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if maximal(a, b)]
        # Among passages better than all their parts, the maximal ones lie inside no other.
        want = [(a, b) for a, b in every if not any((x, y) != (a, b) and x <= a and b <= y for x, y in every)]
        got = toxicity.maximal_passages([(i, s) for i, s in enumerate(scores) if s > 0])
        assert [(a, b) for a, b, _ in got] == want
        assert all(abs(s - (sums[b] - sums[a])) < 1e-9 for a, b, s in got)


def test_poisson_tail():
    assert abs(toxicity._poisson_tail(2, 0.3) - (1 - np.exp(-0.3) * 1.3)) < 1e-12
    assert toxicity._poisson_tail(3, 0.0) == 0.0


def test_poisson_tail_of_large_means():
    assert abs(toxicity._poisson_tail(2, 300) - 1) < 1e-12 and abs(toxicity._poisson_tail(5, 1000) - 1) < 1e-12
    for mean in (0.5, 7.0, 219.5, 250.0, 700.0, 3000.0):
        chance = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(int(3 * mean) + 60)]
        for r in (2, 5, int(mean) + 1, int(mean) + 2, int(1.2 * mean) + 3):
            assert math.isclose(toxicity._poisson_tail(r, mean), math.fsum(chance[r:]), rel_tol=1e-8, abs_tol=1e-11)


def test_long_clean_text_with_two_weak_words():
    model = toxicity.ToxicModel({"vile$": 3.0, "scummy$": 3.0}, 1.7, 0.57, 0.2)
    words = ["plain"] * 300_000
    words[1000], words[200_000] = "vile", "scummy"
    found = toxicity.score_text(model, " ".join(words))
    assert len(found["passages"]) == 2 and found["p_value"] > 0.99 and found["score"] < 0.21


def test_many_weak_passages_are_significant_together():
    n, many = 20_143, 120  # about 70 such passages are expected in a clean text
    model = toxicity.ToxicModel({f"bad{i}$": 3.0 for i in range(many)}, 1.7, 0.57, 0.2)
    words = ["plain"] * n
    for i in range(many):
        words[100 + 160 * i] = f"bad{i}"
    found = toxicity.score_text(model, " ".join(words))
    assert len(found["passages"]) == many and found["p_value"] < 1e-6 and found["score"] > 0.99
    rng = random.Random(3)
    scores = [rng.uniform(1, 6) for _ in range(300)]
    for size in (200, 5_000, 60_000):
        means = [model.scale * size * math.exp(-model.decay * s) for s in sorted(scores, reverse=True)]
        want = min(-math.expm1(-m) if r == 1 else toxicity._poisson_tail(r, m) for r, m in enumerate(means, 1))
        assert toxicity.p_value(model, size, scores) == max(want, 1e-300)


# HTML text


def test_html_text(spark):
    pages = {
        1: ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>a&nbsp; b\n c<br>d</p><div class='ad'>buy</div><p>1 < 2</p></article><footer>x</footer>", "T & U\n\na b c d\n\n1 < 2"),
        2: (None, ""),
        3: ("", ""),
        4: ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> -->", ""),
        5: ("<article><p>open <b>never closed<p>next<div class=comments><p>I said so</div></article>", "open never closed\n\nnext"),
        6: ("<main><p>" + "word " * 50_000 + "</p></main>", ("word " * 50_000).strip()),
        7: ("<article><p>&lt;b&gt; &#233; &eacute; &amp;amp;</p></article>", "<b> é é &amp;"),
        8: ("<article><form><label>Name</label><input></form><p hidden>no</p><p>yes</p><aside>side</aside></article>", "yes"),
    }
    df = spark.createDataFrame([(i, h, "t", "b") for i, (h, _) in pages.items()], "page_id int, html string, text string, blocks string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, ["page_id"]).collect()}
    assert got == {i: t for i, (_, t) in pages.items()}
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


def test_html_article_inside_wrappers(spark):
    article = "<article><p>One short text.</p></article>"
    around = [
        '<div class="content-sidebar-wrap">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="has-sidebar">{}</div>', '<div class="search"><div>{}</div></div>',
        '<article class="post tag-privacy category-social"><p>One short text.</p></article>', '<body class="sidebar ad">{}', "<header>{}</header>",
        '<form><p>One short text.</p><article><div class="ad">No</div></article></form><nav>No</nav><article></article>',
    ]
    without = [
        "<nav>{}</nav>", '<div class="comments">{}</div>', '<section id="comment-list"><div>{}</div></section>', '<article class="comment">No</article>', "<aside>{}</aside>",
        '<div class="share-buttons sidebar">{}</div>', '<article><div class="post-comments"><p>I have read it all and I do not think that a word of it is true, but it is well written</p></div></article>',
        "<footer><p>" + "many words " * 40 + "</p></footer>", '<div id="cookieNotice">' + "many words " * 40 + "</div>", '<form class="newsletter">' + "many words " * 40 + "</form>",
    ]
    pages = [(i, page.format(article)) for i, page in enumerate(around + without)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id int, html string"), ["page_id"]).collect()}
    wrapper = len(around) - 1
    assert {i: t for i, t in got.items() if i < wrapper} == {i: "One short text." for i in range(wrapper)}
    assert {i: t for i, t in got.items() if i >= len(around)} == {i: "" for i in range(len(around), len(pages))}
    assert html_text.blocks(pages[wrapper][1])[0]["mark"] == 0 and [b["mark"] for b in html_text.blocks(pages[wrapper][1])[1:]] == [-1, -1]


def test_html_unmarked_pages_go_by_words_and_links(spark):
    """Without any container the block and its neighbours decide."""
    long = "This paragraph has no link in it and is long enough to be read as the text of a page by anybody who comes along here."
    teaser = f"<div><a href=/x>{long}</a></div>"
    page = f"<body><div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><p>{long}</p><p>It is short.</p><p>{long}</p></div>{teaser}{teaser}<div>Menu</div><div><a href=/c>Next</a></div></body>"
    made = html_text.extract(spark.createDataFrame([(1, page), (1, page)], "page_id int, html string"), ["page_id"]).collect()
    assert [r["text"] for r in made] == [f"{long}\n\nIt is short.\n\n{long}"] * 2


def test_html_tree_asks_links_and_neighbours(spark):
    tree = html_text.fit_tree(html_text.labelled_blocks(spark))
    asked = set()

    def walk(node):
        if node.subtreeDepth():
            asked.add(html_text.FEATURES[node.split().featureIndex()])
            walk(node.leftChild())
            walk(node.rightChild())

    walk(tree)
    assert "links" in asked and "words" in asked and asked & {"words_before", "links_before", "words_after", "links_after"}


def test_html_broken_markup_takes_linear_time():
    pages = ['<a title="x>hello</p> ' * 50_000, "<a \"x ' href='>b" * 60_000, "<div>" * 200_000 + "x", "<svg><button>x" * 70_000, "<a " * 300_000, "<p>" + "<span>" * 50_000 + "</p><td></td>" * 50_000]
    for page in pages:
        start = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - start < 5


@pytest.mark.parametrize("seed", range(4))
def test_html_text_of_written_pages(spark, seed):
    """Pages written from their parts, so that the main text is known: the parts that are not main text never show, the others all do."""
    rng = random.Random(seed)
    rest = ["<nav><ul><li><a href=/>{}</a></li></ul></nav>", '<div class="ad">{}</div>', "<!-- {} -->", "<script>var a='<p>{}</p>'</script>", "<aside><p>{}</p></aside>", '<div class="site-notice">{}</div>', "<form><label>{}</label></form>"]
    pages, texts = [], []
    for i in range(30):
        parts, main = [], []
        for _ in range(rng.randint(0, 12)):
            words = prose(rng.randint(1, 40), rng)
            if rng.random() < 0.4:
                parts.append(rng.choice(rest).format(words))
            else:
                tag = rng.choice(["p", "h2", "div", "blockquote", "li"])
                parts.append(f"<{tag}>" + words.replace(" ", rng.choice([" ", "\n ", "&#32;", "&nbsp; ", "<br>"]), 1) + f" &amp;</{tag}>")
                main.append(words + " &")
        pages.append((i, "<html><body>" + rng.choice(rest).format("x y") + "<article>" + "".join(parts) + "</article><footer>" + prose(30, rng) + "</footer></body></html>"))
        texts.append("\n\n".join(main))
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id int, html string"), ["page_id"]).collect()}
    assert got == dict(enumerate(texts))


def test_html_tree_fits_its_table(spark):
    labelled = html_text.labelled_blocks(spark)
    tree = html_text.fit_tree(labelled)
    guess = html_text.tree_expression(tree, {c: F.col(c) for c in html_text.FEATURES})
    right = labelled.select((guess.cast("double") == F.col("label")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right >= 0.9


# Preferences


def test_preferences(spark):
    def rows(i, *turns):
        return [(i, n, role, text, "x") for n, (role, text) in enumerate(turns)]

    start = [("system", "be kind"), ("user", "hi")]
    turns = spark.createDataFrame(
        [*rows(0, *start, ("assistant", "hello"), ("user", "bye")), *rows(1, *start, ("assistant", "go away")), *rows(2, ("user", None)), *rows(3, ("user", None)),
         *rows(4, ("user", "only")), (None, 0, "user", "lost", "x"), (6, 0, None, "a", "x"), (7, 0, "assistant", "", "x"), (7, 0, "assistant", "", "x")],
        "conv_id bigint, turn int, role string, text string, prompt string",
    )
    pairs = preferences.opening_pairs(turns)
    got = {r["pair_id"]: r for r in preferences.format_pairs(pairs, turns).collect()}
    assert set(got) == {0, 1, 3}
    first = got[0]
    assert (first["chosen"], first["rejected"], first["n_common"]) == (0, 1, 2)
    assert first["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n"
    spans = [first["chosen_text"][s["start"] : s["end"]] for s in first["chosen_mask"]]
    assert spans == ["hello<|end|>\n"] and first["chosen_text"].endswith("<|user|>\nbye<|end|>\n")
    assert [first["rejected_text"][s["start"] : s["end"]] for s in first["rejected_mask"]] == ["go away<|end|>\n"]
    assert (got[1]["n_common"], got[1]["chosen_text"], got[1]["chosen_mask"]) == (1, "", [])
    assert got[3]["n_common"] == 0 and len(got[3]["chosen_mask"]) + len(got[3]["rejected_mask"]) == 2
    assert preferences.format_pairs(pairs.limit(0), turns).count() == 0
    assert preferences.opening_pairs(turns.limit(0)).count() == 0
    lone = preferences.format_pairs(spark.createDataFrame([(9, 0, None)], "pair_id int, chosen bigint, rejected bigint"), turns).first()
    assert lone["n_common"] == 0 and lone["rejected_text"] == "" and lone["chosen_text"].startswith("<|system|>")


# Decontamination


def brute_leaks(texts, items):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for text in texts:
        w, found = tokens(text), set()
        for i, item in items:
            b = tokens(item)
            span = min(13, len(b))
            if len(b) < 8:
                continue
            for d in range(-len(b), len(w)):
                low, high = max(0, -d), min(len(b), len(w) - d)
                same = [b[k] == w[k + d] for k in range(low, high)]
                if any(span - sum(same[s : s + span]) <= span // 6 for s in range(len(same) - span + 1)):
                    found.add(i)
        out.append(sorted(found))
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng.choice([13, 15, 25, 40]), rng)) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (60, None)]
    items.append((61, items[0][1]))
    texts = [None, "", items[0][1], items[1][1].upper() + "!", prose(300, rng), prose(20_000, rng)]
    for _ in range(40):
        words = rng.choice(items[:12])[1].split()
        words = words[rng.randint(0, 3) :]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(f"{prose(rng.randint(0, 40), rng)} {', '.join(words)} {prose(rng.randint(0, 40), rng)}")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, texts)
    want = brute_leaks(texts, items[:15])
    rows = decontaminate.find_leaks(docs, benchmark).collect()
    assert {r["doc_id"]: r["items"] for r in rows} == dict(enumerate(want))
    odd = docs.union(docs.filter("doc_id = 2")).union(spark.createDataFrame([(None, items[0][1], *"abcd", 1), (None, "clean", *"abcd", 1)], SCHEMA))
    kept = decontaminate.drop_leaks(odd, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, *[i for i, x in enumerate(want) if not x]]
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(empty(spark), benchmark).count() == 0


def test_decontamination_without_ids(spark):
    """Rows without ids, or with one id, must not meet in one group."""
    rng = random.Random(4)
    item = prose(30, rng)
    texts = [f"{prose(rng.randint(50, 200), rng)} {item} {prose(50, rng)}" if n % 2 else prose(100, rng) for n in range(600)] + [f"{item} same"] * 50
    docs = spark.createDataFrame([(None if n % 3 else 7, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    leaked = decontaminate.find_leaks(docs.withColumn("doc_id", F.xxhash64("text")), benchmark).filter("leaked").count()
    assert decontaminate.find_leaks(docs, benchmark).filter("leaked").count() == leaked == 350
    assert decontaminate.drop_leaks(docs, benchmark).count() == 300
    named = docs.withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    assert decontaminate.find_leaks(named, benchmark).filter("leaked").count() == 350


def test_masks_cover_every_allowed_replacement():
    for n in range(1, 14):
        for r in range(n // decontaminate.ONE_IN + 1):
            for gone in itertools.combinations(range(n), r):
                if n >= decontaminate.MASKED:
                    posted = [[at + o for o in mask] for mask in decontaminate.MASKS for at in range(n - mask[-1])]
                else:
                    posted = [range(n)] if n < decontaminate.ONE_IN else [range(n // 2), range(n // 2, n)]
                assert any(not set(gone) & set(places) for places in posted), (n, gone)


def short_leaks(texts, items):
    """Items of any length, by the stated rule."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for text in texts:
        w, found = tokens(text), set()
        for i, item in items:
            b = tokens(item)
            span = min(13, len(b))
            for d in range(len(w) - len(b) + 1) if 0 < len(b) < 13 else ():
                if span - sum(x == y for x, y in zip(b, w[d:])) <= span // 6:
                    found.add(i)
        out.append(sorted(found))
    return out


def test_decontamination_of_short_items(spark):
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(1, 13)]
    texts = ["", None, prose(200)]
    for n, item in items:
        texts += [item, f"{prose(5)} {item} {prose(5)}", item.rsplit(" ", 1)[0] + " other"]
        for gone in [*itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            texts.append(f"{prose(3)} {' '.join('other' if k in gone else w for k, w in enumerate(item.split()))} {prose(3)}")
    rows = decontaminate.find_leaks(table(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = short_leaks(texts, items)
    assert {r["doc_id"]: r["items"] for r in rows} == dict(enumerate(want))
    assert {i for x in want for i in x} == set(range(1, 13))


def test_decontamination_with_items_without_id(spark):
    rng = random.Random(6)
    items = [(None, prose(20, rng)), (None, prose(20, rng)), (5, prose(20, rng))]
    texts = [items[0][1], f"{items[1][1]} and {items[0][1]}", f"{items[2][1]} and {items[1][1]}", prose(60, rng)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in decontaminate.find_leaks(table(spark, texts), benchmark).collect()}
    assert {i: (r["leaked"], r["items"]) for i, r in rows.items()} == {0: (True, [None]), 1: (True, [None]), 2: (True, [5, None]), 3: (False, [])}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(table(spark, texts), benchmark).collect()] == [3]
