"""URL rules and a Bloom filter cascade, DataFrame functions only.

The cascade stores which keys of a complete universe are listed. Level 0 is a
Bloom filter of the listed keys; level 1 one of the unlisted keys that pass level
0; level 2 one of the listed keys that pass level 1; and so on until no key
passes wrongly. A key is listed if the first level that it fails has an odd
number. For keys of the universe this is exact.

Filters are arrays of 64-bit words. They enter the query as scalar subqueries,
so that judging a URL needs no join. Their bits are counted before they are
built. A cascade holds at most ``max_bits``; keys of a larger one are cut by their hash into
parts with a cascade each, and a URL asks the cascade of its part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm.common import ascii_lower, release, stored


@dataclass(frozen=True)
class Rule:
    """A rule ``host/path`` fits the host and its subdomains if the path starts with ``/path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, block before allow; null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


@dataclass
class Level:
    words: DataFrame  # one row, column ``words``: array of 64-bit words
    bits: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        tests = [
            F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1
            for place in places(key, self)
        ]
        both = tests[0]
        for test in tests[1:]:
            both = both & test
        return both


def places(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.seed * 64 + i), key), F.lit(level.bits)) for i in range(level.hashes)]


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """Bloom filter of the column ``key`` with about ``rate`` false positives.

    Bits are grouped into words by partial aggregation; the one row that gathers
    the words holds at most ``bits / 64`` of them.
    """
    hashes = max(1, round(math.log2(1 / rate)))
    level = Level(keys, 64 * math.ceil(max(1, count) * hashes / math.log(2) / 64), hashes, seed)
    spots = keys.select(F.explode(F.array(*places(F.col("key"), level))).alias("place"))
    word = F.shiftright("place", 6)
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    filled = spots.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    blank = keys.sparkSession.range(level.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    every = filled.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    gathered = every.agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))
    level.words = stored(gathered)
    return level


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def lists(self, key: Column) -> Column:
        """True for listed keys. Levels are tested only as far as the key passes."""
        verdict = F.lit(len(self.levels) % 2 == 1)  # passed every level
        for number in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(~self.levels[number].holds(key), F.lit(number % 2 == 1)).otherwise(verdict)
        return verdict


def build_cascade(universe: DataFrame, max_bits: int = 1 << 28, rate: float = 0.125) -> Cascade | None:
    """Cascade over ``universe`` (key, listed; each key once, no null key).

    The first level's rate makes as many false positives as there are listed keys
    at the next level's rate. None if the levels could hold more than ``max_bits``
    (by default 32 MB), counted before a level is built.
    """
    parts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = parts.get(True, 0), parts.get(False, 0)
    levels: list[Level] = []
    if not listed:
        return Cascade(levels)
    inside, inside_n = universe.where("listed").select("key"), listed
    outside = universe.where("NOT listed").select("key")
    now = min(0.5, max(1e-6, rate * listed / max(1, others)))
    spent, held = 0, []
    while inside_n:
        if spent + inside_n * 1.45 * max(1, round(math.log2(1 / now))) + 64 > max_bits:
            for level in levels:
                release(level.words)
            release(*held)
            return None
        level = build_level(inside, inside_n, now, len(levels))
        spent += level.bits
        levels.append(level)
        wrong = stored(outside.where(level.holds(F.col("key"))))
        held.append(wrong)
        inside, outside = wrong, inside
        inside_n, now = wrong.count(), rate
    release(*held)
    return Cascade(levels)


#: The least that a cascade may be allowed, enough for the levels of a few keys.
LEAST_BITS = 1 << 12


def part_of(key: Column, parts: int) -> Column:
    """Which part a key falls into; the hash is none that a level uses."""
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)) if parts > 1 else F.lit(0)


def build_cascades(universe: DataFrame, max_bits: int = 1 << 28, rate: float = 0.125) -> list[Cascade]:
    """Cascades over the parts of ``universe``, each within ``max_bits``; as many parts as that takes, by doubling."""
    if max_bits < LEAST_BITS:
        raise CurationError(f"a cascade needs {LEAST_BITS} bits")
    parts = 1
    while True:
        found = []
        for part in range(parts):
            keys = universe if parts == 1 else universe.where(part_of(F.col("key"), parts) == part)
            cascade = build_cascade(keys, max_bits, rate)
            if cascade is None:
                break
            found.append(cascade)
        else:
            return found
        for cascade in found:
            release(*[level.words for level in cascade.levels])
        parts *= 2


def judge_urls(
    pages: DataFrame, rules: list[Rule], *, url: str = "url", max_bits: int = 1 << 28
) -> DataFrame:
    """Judge every URL by its longest fitting rule, else by its host.

    A host is listed if one of its pages fits a block rule as its longest; pages
    that no rule fits are blocked on listed hosts and allowed elsewhere. Returns the columns of
    ``pages`` in the struct ``row`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A null URL or one without ``://`` has an empty host and path, which no rule
    fits; the empty host is a key like any other. Repeated rows are judged alike, URLs of any length whole.
    An empty table gives an empty result. The pages are read once for each part of the cascade (32 MB by default).
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    blocked = F.coalesce(F.col("fit.verdict") == "block", F.lit(False))
    universe = stored(ruled.groupBy(F.col("host").alias("key")).agg(F.max(blocked).alias("listed")))
    cascades = build_cascades(universe, max_bits)
    release(universe)

    def judged(part: int, cascade: Cascade) -> DataFrame:
        mine = ruled if len(cascades) == 1 else ruled.where(part_of(F.col("host"), len(cascades)) == part)
        verdict = F.coalesce(F.col("fit.verdict"), F.when(cascade.lists(F.col("host")), "block").otherwise("allow"))
        return mine.select("row", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))

    return reduce(DataFrame.unionByName, [judged(part, cascade) for part, cascade in enumerate(cascades)])
