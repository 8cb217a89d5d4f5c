"""URL filters: rules by host and path, and a Bloom filter cascade for all that no rule decides.

The cascade stores a list of hosts for exact membership among all hosts of the corpus: its first level is
a Bloom filter of the listed hosts, the next of those other hosts that pass it, the next of
the listed ones that pass that, and so on until none passes wrongly. A host is judged by the first level that
it does not pass. Hosts are dealt to segments by a hash, each with a cascade of its own and about `SEGMENT`
listed hosts, so that no task builds more. The segments' texts are an array in the plan (1.7 bytes for each listed host), so
pages need no join; only lists of more than `LITERALS` segments (a million hosts, 1.7 MB), which are too large to be part of a
plan, meet the pages in an equi-join on the segment.

All is DataFrame and SQL functions. A Bloom filter is text, six bits a character from '0' upward.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: (verdict, host, path), as the query fixes them.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SEGMENT, LITERALS, BITS_A_KEY, HASHES, LEVELS = 50_000, 20, 10, 4, 24


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


def _has(text: Column, place: Column) -> Column:
    byte = F.ascii(F.substring(text.cast("binary"), (F.floor(place / 6) + 1).cast("int"), F.lit(1)).cast("string")) - 48
    return F.call_function("shiftright", byte, F.pmod(place, F.lit(6)).cast("int")).bitwiseAND(F.lit(1)) == 1


class Cascade:
    """Levels of (bits, the segments' texts or None, a table of them or None)."""

    def __init__(self, segments: int) -> None:
        self.segments, self.levels = segments, []

    def segment(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.segments)).cast("int")

    def passing(self, df: DataFrame, key: str, level: int, name: str) -> DataFrame:
        """df with a column that tells whether the key passes the level."""
        bits, texts, table = self.levels[level]
        if texts is not None:
            word, made = F.get(F.array(*map(F.lit, texts)), self.segment(F.col(key))) if len(texts) > 1 else F.lit(texts[0]), df
        else:
            word, made = F.col("_text"), df.withColumn("_segment", self.segment(F.col(key))).join(table, "_segment", "left")
        test = reduce(Column.__and__, [_has(word, p) for p in _places(F.col(key), level, bits)])
        return made.withColumn(name, F.coalesce(test, F.lit(False))).drop("_segment", "_text")

    def member(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a column that is true for listed keys; exact for every key of the universe."""
        if not self.levels:
            return df.withColumn(name, F.lit(False))
        passed = [f"_pass{i}" for i in range(len(self.levels))]
        for i, p in enumerate(passed):
            df = self.passing(df, key, i, p)
        # who passes all levels is of the kind that the last one stores
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(~F.col(passed[i]), F.lit(i % 2 == 1)).otherwise(verdict)
        return df.withColumn(name, verdict).drop(*passed)


def _filter(keys: DataFrame, key: str, cascade: Cascade, level: int, n: int, literals: int) -> tuple[int, list[str] | None, DataFrame | None]:
    """A level from n keys; its segments' texts have equal lengths."""
    bits = max(60, -(-BITS_A_KEY * n // cascade.segments // 6) * 6)
    place = F.explode(F.array(*_places(F.col(key), level, bits)))
    at = keys.select(cascade.segment(F.col(key)).alias("_segment"), place.alias("p")).select("_segment", F.floor(F.col("p") / 6).alias("byte"), F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(6)).cast("int")).alias("v"))
    spark = keys.sparkSession
    blank = spark.range(bits // 6).select(F.explode(F.sequence(F.lit(0), F.lit(cascade.segments - 1))).alias("_segment"), F.col("id").alias("byte"), F.lit(0).alias("v"))
    bytes_ = at.unionByName(blank).groupBy("_segment", "byte").agg(F.bit_or("v").alias("v"))
    chars = F.transform(F.array_sort(F.collect_list(F.struct("byte", "v"))), lambda x: F.char(x["v"] + 48))
    table = bytes_.groupBy("_segment").agg(F.array_join(chars, "").alias("_text"))
    if cascade.segments <= literals:
        return bits, [r["_text"] for r in table.orderBy("_segment").collect()], None
    return bits, None, stored(table, "bloom")


def build(universe: DataFrame, key: str, listed: str, segment: int = SEGMENT, literals: int = LITERALS) -> Cascade:
    """The cascade for a table of distinct keys with a boolean column for the listed ones."""
    total = {r[listed]: r["count"] for r in universe.groupBy(listed).count().collect()}
    cascade = Cascade(max(1, -(-total.get(True, 0) // segment)))
    stores, others, n = universe.where(F.col(listed)), universe.where(~F.col(listed)), total.get(True, 0)
    for level in range(LEVELS):
        if not n:
            return cascade
        cascade.levels.append(_filter(stores, key, cascade, level, n, literals))
        wrong = stored(cascade.passing(others.select(key), key, level, "_p").where("_p").select(key), "passing")
        stores, others, n = wrong, stores, wrong.count()
    raise RuntimeError("the cascade did not close")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, segment: int = SEGMENT, literals: int = LITERALS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    The longest rule that fits decides. Where none does, the cascade of listed hosts does: a host is
    listed, and its pages are blocked, if a rule blocks any of its pages in the corpus; the rest is
    allowed. Null urls and urls without :// have an empty host and path, fit no rule and are allowed, as
    the empty host is never listed. Repeated rows and rows without an id are judged like any other. An
    empty table gives an empty result. Further columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    ruled = own.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"))
    universe = stored(ruled.groupBy("host").agg(F.coalesce(F.max(F.col("by_rule") == "block"), F.lit(False)).alias("listed")), "hosts")
    cascade = build(universe, "host", "listed", segment, literals)
    told = cascade.member(ruled, "host", "in_list")
    return told.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("in_list"), "block").otherwise("allow")).alias("verdict"))


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM q),
listed AS (SELECT DISTINCT host FROM r WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/'))
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL OR host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
