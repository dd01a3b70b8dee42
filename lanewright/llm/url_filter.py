"""URL filter: host rules first, then a weighted vocabulary searched by one Aho-Corasick automaton.

A term counts only where it stands alone, that is where neither neighbour is an ASCII letter or digit.  One strict term
rejects an address, and so do ``soft_limit`` different soft terms.  A rule (host, path) fits its host and all subdomains
when the path starts with the rule's path; the longest rule that fits decides and the vocabulary is not asked.

A null address, or one without ``://``, has an empty host and path, fits no rule and is judged by the vocabulary
alone (null: no term, allowed).  Rows are independent; only the key columns are kept, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import lower_ascii

#: Words that mark an address as unwanted by themselves.
STRICT_TERMS = (
    "adult", "anal", "bdsm", "camgirls", "casino", "cumshot", "escort", "escorts", "hardcore", "hentai", "jackpot", "milf", "nsfw", "nude",
    "nudes", "onlyfans", "phishing", "poker", "porn", "porno", "pornhub", "roulette", "sex", "sexcam", "slots", "sportsbook", "viagra",
    "warez", "xhamster", "xnxx", "xvideos", "xxx",
)
#: Words that only count together.
SOFT_TERMS = (
    "ad", "ads", "advert", "affiliate", "affiliates", "banner", "bet", "betting", "bonus", "buy", "cheap", "click", "coupon", "coupons", "crack",
    "cracked", "dating", "deal", "deals", "discount", "download", "free", "game", "girls", "keygen", "loan", "loans", "offer", "offers",
    "pills", "pixel", "popup", "promo", "replica", "sale", "seo", "sponsored", "spam", "torrent", "track", "tracker", "tracking", "win",
)
SOFT_LIMIT = 2


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term in (*strict, *soft):
        machine.add_word(term, (term, term in strict))
    machine.make_automaton()
    return machine


def _alone(text: str, start: int, end: int) -> bool:
    outside = (text[start - 1] if start else "", text[end] if end < len(text) else "")
    return not any(c.isascii() and c.isalnum() for c in outside if c)


def hits(machine: ahocorasick.Automaton, address: str) -> tuple[int, int]:
    """Different strict and soft terms that stand alone in a lower-cased address."""
    found = {(term, strict) for last, (term, strict) in machine.iter(address) if _alone(address, last + 1 - len(term), last + 1)}
    return sum(strict for _, strict in found), sum(not strict for _, strict in found)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    return host, path


def _fits(rule: tuple[str, str, str]) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    keys: list[str],
    url: str = "url",
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: tuple[str, ...] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``keys``, ``host``, ``path``, ``n_strict``, ``n_soft``, ``rule`` (or null) and ``verdict``.

    ``rules`` are (allow or block, host, path); the longest host and path together wins, and of equal
    lengths the first in the list.
    """

    @F.pandas_udf("n_strict int, n_soft int")
    def count(addresses: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(strict, soft)
        for series in addresses:
            yield pd.DataFrame([hits(machine, x) for x in series], columns=["n_strict", "n_soft"]).astype("int32")

    safe = {f"_k{i}": key for i, key in enumerate(keys)}
    rows = pages.select(*[F.col(f"`{k}`").alias(n) for n, k in safe.items()], F.col(f"`{url}`").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path, "_found": count(F.coalesce(lower_ascii(F.col("_url")), F.lit("")))})
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = F.coalesce(*[F.when(_fits(r), F.lit(r[1] + r[2])) for r in ordered], F.lit(None).cast("string"))
    by_rule = F.coalesce(*[F.when(_fits(r), F.lit(r[0])) for r in ordered], F.lit(None).cast("string"))
    bad = (F.col("_found.n_strict") >= 1) | (F.col("_found.n_soft") >= soft_limit)
    by_terms = F.when(bad, "block").otherwise("allow")
    return rows.select(
        *safe, "host", "path", F.col("_found.n_strict").alias("n_strict"), F.col("_found.n_soft").alias("n_soft"),
        rule.alias("rule"), F.coalesce(by_rule, by_terms).alias("verdict"),
    ).withColumnsRenamed(safe)
