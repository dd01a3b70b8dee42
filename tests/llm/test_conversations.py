"""Structure repair and the prefix trie against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lanewright.llm import prefix_trie, structure_repair, talks

SCHEMA = "conv_id bigint, turn bigint, role string, text string, _conv string, depth string, `_at` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def some_rows(rng, convs, most, texts):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"])
            rows.append((c, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(texts)))
    return rows


TEXTS = ["one two.", "a b c!", "no end", "", None, " \n", "what?", "one two.", "long " * 5000 + "end.", "é ü."]


def damage(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[c] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, turns in convs.items()}


def least_audit(turns):
    """Every sequence of edits that costs at most twice the number of turns."""
    found, n = [], len(turns)
    kinds, seen = [], set()
    for turn in turns:
        role, text = turn[1:]
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def go(i, cost, audit, initials):
        if cost > 2 * n or not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == n and re.fullmatch("(s?(ua)+)?", initials):
            found.append((cost, audit))
        for c in "ua":
            go(i, cost + 5, audit + "I", initials + c)
        if i < n:
            go(i + 1, cost + 2, audit + "D", initials)
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                if turns[i][1]:
                    go(i + 1, cost + more, audit + "K", initials + turns[i][1][0])
                for c in "ua":
                    go(i + 1, cost + more + 1, audit + "R", initials + c)

    go(0, 0, "", "")
    return min(found), kinds


@pytest.mark.parametrize("seed", [1, 2])
def test_audits_are_the_least(seed):
    rng = random.Random(seed)
    for _ in range(400):
        texts = ["a.", "b!", "c?", "d", "e.", "", "f.", "g."]
        turns = [(i, rng.choice(["user", "assistant", "system", " ", "", "sue"]), rng.choice(texts)) for i in range(rng.randint(0, 7))]
        assert structure_repair.examine(turns)[5:7] == least_audit(turns)[0]


def test_repair_of_tables(spark):
    rng = random.Random(3)
    rows = some_rows(rng, [*range(60), None], 5, TEXTS)
    rows += [rows[0]] * 3
    got = {r["_conv"]: tuple(r) for r in structure_repair.repair(talks.damaged(table(spark, rows))).collect()}
    want = damage(rows)
    assert set(got) == set(want) and len(got) == 61
    for c, turns in want.items():
        (cost, audit), kinds = least_audit(turns)
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out, at = [], 0
        for edit in audit:
            if edit == "K":
                out.append(f"{turns[at][1]}:{turns[at][2]}")
            elif edit in "IR":
                out.append(f"{'assistant' if out and out[-1][0] == 'u' else 'user'}:{'' if edit == 'I' else turns[at][2]}")
            at += edit != "I"
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        assert got[c] == (c, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
    assert structure_repair.repair(talks.damaged(table(spark, []))).count() == 0


def test_long_conversations_stay_within_their_band():
    rng = random.Random(4)
    turns = [(i, ("user", "assistant")[i % 2], f"t{i}" + ("" if rng.random() < 0.05 else ".")) for i in range(3000) if rng.random() > 0.02]
    kinds = structure_repair.faults([t[1:] for t in turns])[0]
    table = structure_repair.Alignment("".join(t[1][0] for t in turns), kinds)
    assert sum(map(len, table.rows)) < 0.1 * len(turns) ** 2
    cost, audit = table.best()
    assert audit.count("D") + audit.count("K") + audit.count("R") == len(turns) and cost <= table.bound


def brute_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    # Turns that share a number have equal roles and texts in this test, or no order is compared.
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        own = (len(members) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += own
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == k).encode()).hexdigest())
        for k, m in list(nodes.items())
    )


@pytest.mark.parametrize("shard_rows", [25, prefix_trie.SHARD_ROWS])
def test_trie_of_rebuilt_conversations(spark, shard_rows):
    rng = random.Random(6)
    opening = [("user", "hello there."), ("assistant", "good day to you!"), ("user", None)]
    rows = [(None, 0, "user", "nobody's")]
    for c in [*range(0, 150), 5000, 9000, 70_000]:
        turns = opening[: rng.randint(0, 3)] + [(rng.choice(["user", "assistant", None]), rng.choice(TEXTS)) for _ in range(rng.randint(0, 3))]
        turns = opening if c % 3 == 0 else turns or opening[:1]
        rows += [(c, None if i == 0 else i, *turn) for i, turn in enumerate(turns)]
    rows += [(200, 1, "user", "again."), (200, 1, "user", "again."), *[(201, i, "user", str(i % 7)) for i in range(120)]]
    rng.shuffle(rows)
    placed = talks.numbered_turns(table(spark, rows))
    made = prefix_trie.trie(talks.rebuilt(placed), placed.select("_conv").distinct(), shard_rows).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in made) == brute_trie(rows, True)


def test_trie_as_it_is_and_empty(spark):
    rows = [(c, t, "user", f"{t % 3} {'' if c < 40 else c}") for c in (*range(-5, 50), 4095, 4096, 9999) for t in range(4)]
    made = prefix_trie.prefix_trie(table(spark, rows), 30).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in made) == brute_trie(rows, False)
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    slots = prefix_trie.SlotTable(*keys)
    assert sorted(slots.slots(*keys)) == list(range(5000))
    others = keys + np.array([[0], [1]])
    assert (slots.slots(*others) == -1).all() and len(prefix_trie.SlotTable(keys[0][:0], keys[1][:0]).slots(*keys)) == 5000


def test_a_digest_of_two_turns_is_refused():
    import pandas as pd

    row = {"g1": 1, "g2": 2, "p1": 0, "p2": 0, "a": 5, "b": 6, "depth": 1, "words": 1, "conv": 1, "n": 1, "children": 0, "leaves": 0, "saved": 0}
    with pytest.raises(ValueError):
        prefix_trie.accumulate(pd.DataFrame([row, {**row, "a": 7}]))
