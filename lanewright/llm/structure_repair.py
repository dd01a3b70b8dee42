"""Conversation structure repair by aligning the turns with every feasible length of an alternating grammar.

The role initials of a good conversation are ``(s?(ua)+)?``: pairs of user and assistant, after a system turn or not, or nothing at all.  A
conversation is aligned with each string of the grammar by Wagner-Fischer; keeping a turn costs 0, giving it the role user or assistant 1,
deleting it 2, inserting an empty turn 5.  Blank and repeated turns must be deleted; a truncated turn that is not deleted costs 5 more.

All strings of the grammar have the same end, so one table over suffixes serves every length: cell (i, j) is the least cost of turning the last i turns
into the last j symbols.  The incumbent, the cheaper of two one-pass repairs, bounds the table like Ukkonen's bands: no more deletions and insertions than it
pays for (i - j and j - i), and no cell that exceeds it together with what the faults of the turns before it cost at least.  Every length of
least total cost is traced back, taking the edit with the least initial wherever several are optimal, and the least of these audits stands.

Null roles and texts are one space, so such a turn has no legal role or is blank.  Turns are ordered by number, null first, then by role and text; equal rows
are repeats.  Rows with a null conversation id are one conversation.  A conversation of which nothing is left has zeros and an empty audit.  An
empty table gives an empty table.  Conversations are read as a sorted stream, and one at a time is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import short_batches

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
GOOD, MUST_GO, CUT = 0, 1, 2


def faults(turns: list[tuple[str, str]]) -> tuple[list[int], int, int, int]:
    """Per turn ``GOOD``, ``MUST_GO`` or ``CUT``, and how many are blank, duplicate and truncated."""
    seen: set[bytes] = set()
    kinds, counts = [], [0, 0, 0]
    for role, text in turns:
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        body = text.rstrip(SPACES)
        fault = 0 if not body else 1 if digest in seen else 2 if body[-1] not in ENDS else None
        seen.add(digest)
        if fault is not None:
            counts[fault] += 1
        kinds.append(GOOD if fault is None else CUT if fault == 2 else MUST_GO)
    return kinds, *counts


def incumbent(initials: str, kinds: list[int]) -> int:
    """The cost of a good repair found in one pass: faulty turns go, turns out of place go or (second pass) get the other role."""
    best = DELETE * len(kinds)
    for other_role in (False, True):
        cost, made, begun = 0, 0, False
        for initial, kind in zip(initials, kinds):
            if kind != GOOD:
                cost += DELETE
            elif initial == "s" and not made and not begun:
                begun = True
            elif initial == "ua"[made % 2]:
                made += 1
            elif other_role:
                cost, made = cost + REROLE, made + 1
            else:
                cost += DELETE
        cost += INSERT if made % 2 else 0
        cost += DELETE if begun and not made else 0
        best = min(best, cost)
    return best


class Alignment:
    """The table of one conversation: ``cost(i, j)`` of its last i turns and the last j symbols of ...uaua."""

    def __init__(self, initials: str, kinds: list[int]):
        self.initials, self.kinds, n = initials, kinds, len(kinds)
        self.bound = incumbent(initials, kinds)
        wide, long = self.bound // DELETE, self.bound // INSERT
        before = [0] * (n + 1)  # at least this much is paid for the first q turns
        for q, kind in enumerate(kinds):
            before[q + 1] = before[q] + (0 if kind == GOOD else min(DELETE, TRUNCATED))
        self.starts, self.rows = [], []
        for i in range(n + 1):
            most = self.bound - before[n - i]
            start = max(0, i - wide)
            row, below, below_start = [], self.rows[-1] if i else [], self.starts[-1] if i else 0
            initial, kind = (initials[n - i], kinds[n - i]) if i else ("", MUST_GO)
            for j in range(start, i + long + 1):
                least = 0 if i == j == 0 else FAR
                at = j - below_start
                if 0 <= at < len(below):
                    least = min(least, below[at] + DELETE)
                if kind != MUST_GO and 0 < at <= len(below):
                    least = min(least, below[at - 1] + self.use(initial, kind, j))
                if row:
                    least = min(least, row[-1] + INSERT)
                row.append(least if least <= most else FAR)
            while row and row[-1] == FAR:
                row.pop()
            dead = 0
            while dead < len(row) and row[dead] == FAR:
                dead += 1
            self.starts.append(start + dead)
            self.rows.append(row[dead:])

    @staticmethod
    def use(initial: str, kind: int, j: int) -> int:
        """The cost of keeping a turn, or giving it the other role, as the j-th symbol from the end."""
        return (0 if initial == ("a" if j % 2 else "u") else REROLE) + (TRUNCATED if kind == CUT else 0)

    def cost(self, i: int, j: int) -> int:
        at = j - self.starts[i]
        return self.rows[i][at] if 0 <= at < len(self.rows[i]) else FAR

    def trace(self, i: int, j: int) -> str:
        """The least audit of an optimal alignment of the last i turns and the last j symbols."""
        audit, n = [], len(self.kinds)
        while i or j:
            here = self.cost(i, j)
            if i and self.cost(i - 1, j) + DELETE == here:
                audit.append("D")
                i -= 1
            elif j and self.cost(i, j - 1) + INSERT == here:
                audit.append("I")
                j -= 1
            else:
                audit.append("K" if self.initials[n - i] == ("a" if j % 2 else "u") else "R")
                i, j = i - 1, j - 1
        return "".join(audit)

    def best(self) -> tuple[int, str]:
        """The least cost, and the least audit of that cost, over all lengths with and without a system turn."""
        n = len(self.kinds)
        # The target begins at turn q: 0 without a system turn, else the turns before q go and turn q is kept as the system turn.
        begins = [(0, 0, "")]
        for q, (initial, kind) in enumerate(zip(self.initials, self.kinds)):
            spent = DELETE * q + (TRUNCATED if kind == CUT else 0)
            if spent > self.bound:
                if DELETE * q > self.bound:
                    break
            elif initial == "s" and kind != MUST_GO:
                begins.append((spent, q + 1, "D" * q + "K"))
        found, lead = FAR, []
        for spent, q, audit in begins:
            i = n - q
            for j in range(self.starts[i], self.starts[i] + len(self.rows[i])):
                if j % 2 or (q and not j):
                    continue
                total = spent + self.cost(i, j)
                if total < found:
                    found, lead = total, []
                if total == found:
                    lead.append((audit, i, j))
        return found, min(audit + self.trace(i, j) for audit, i, j in lead)


def repaired(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits of an audit."""
    made, at = [], 0
    for edit in audit:
        if edit in "IR":
            after_user = bool(made) and made[-1][0][:1] == "u"
            made.append(("assistant" if after_user else "user", "" if edit == "I" else turns[at][1]))
        elif edit == "K":
            made.append(turns[at])
        at += edit != "I"
    return made


def examine(turns: list[tuple[int | None, str, str]]) -> tuple:
    """``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and the digest of the repaired turns."""
    numbers = {t[0] for t in turns if t[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    said = [t[1:] for t in turns]
    # A role that is the empty text has an initial of its own, which no grammar knows.
    initials = "".join(role[:1] or "\0" for role, _ in said)
    kinds, blank, duplicate, truncated = faults(said)
    illegal = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
    cost, audit = Alignment(initials, kinds).best()
    digest = hashlib.sha256()
    for k, (role, text) in enumerate(repaired(said, audit)):
        digest.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun, key, turns = False, None, []

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_conv", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        done, kind = [], batch.schema.field(0).type
        for conv, gone, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if not begun or conv != key:
                if begun:
                    done.append((key, *examine(turns)))
                begun, key, turns = True, conv, []
            if not gone:
                turns.append((turn, role, text))
        if done:
            yield made(done, kind)
    if begun:
        yield made([(key, *examine(turns))], kind)


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation of ``talks.damaged`` (or rows like it): ``_conv``, the counts, ``audit`` and ``repaired_sha256``."""
    short_batches(turns.sparkSession)
    ordered = turns.select("_conv", "_gone", "_turn", "_role", "_text").repartition("_conv").sortWithinPartitions("_conv", "_gone", "_turn", "_role", "_text")
    kind = turns.schema["_conv"].dataType.simpleString()
    return ordered.mapInArrow(_examined, f"_conv {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")
