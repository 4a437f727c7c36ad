"""URL filters: host and path rules, then a Bloom filter cascade over host names. DataFrame functions only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. Null urls and urls without ``://`` have both empty. A rule ``host/path`` fits its host and all
subdomains if the path starts with the rule's; the longest rule wins. Urls that no rule fits are judged by the
listed keys, which are hosts: those of a given list, or else all hosts with some url that a block rule stops. The
first level of the cascade encodes the listed keys, the next one the keys of the corpus that the
first lets through wrongly, the next one the listed keys that those let through, and so on until none is left.
The key universe is complete (all hosts of the corpus and all listed ones), so membership is exact, without joins.
More listed keys than SHARD_KEYS are dealt by hash to several cascades, each asked about its own urls alone, so that
what a plan holds stays bounded.

Repeated rows are judged alike one by one; other columns are ignored; an empty list gives allow. An empty host (of a
null url too) is a key like any other. Urls of any length are looked at whole.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, stored

#: verdict, host and path; longer rules win over shorter ones.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Listed keys of one cascade, at about 8 bits each for a level.
SHARD_KEYS = 1_000_000
FALSE_POSITIVES = 0.02


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    name = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(text of the longest fitting rule or null, its verdict or null)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, so it is outermost
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit("/" + rest))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(word)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words of 64 bits, as a JSON list, and its shape."""

    words: str
    bits: int
    hashes: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        one, two = F.xxhash64(key, F.lit(self.seed)), F.xxhash64(F.lit(self.seed), key)
        return [F.pmod(F.shiftright(one, 8) + F.lit(i) * F.shiftright(two, 8), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(self.words), "array<bigint>")  # a literal, once planned
        found = F.lit(True)
        for at in self.places(key):
            found = found & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


def _level(keys: DataFrame, count: int, seed: int) -> Level:
    bits = 64 * max(1, math.ceil(count * -math.log(FALSE_POSITIVES) / math.log(2) ** 2 / 64))
    empty = Level("[]", bits, max(1, round(bits / count * math.log(2))), seed)
    places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = [0] * (bits // 64)
    for word, value in words.collect():  # bits / 64 rows at most
        table[word] = value
    return Level(json.dumps(table), bits, empty.hashes, seed)


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for a universe of (key, listed), each key once."""
    left = stored(universe, "url-keys")
    levels: list[Level] = []
    while True:
        inside = F.col("listed") if len(levels) % 2 == 0 else ~F.col("listed")
        count = left.filter(inside).count()
        if not count:
            return levels
        levels.append(_level(left.filter(inside), count, len(levels)))
        # the keys of this level stay in play, and so do those of the other side that it lets through
        left = stored(left.filter(inside | levels[-1].holds(F.col("key"))), "url-keys")


def member(key: Column, levels: list[Level]) -> Column:
    """Whether the key is listed; exact for keys of the universe."""
    verdict = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        verdict = F.when(level.holds(key), verdict).otherwise(F.lit(i % 2 == 1))
    return verdict


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. listed: column key, the hosts to block (default: those that block rules stop somewhere)."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    stops = F.coalesce(F.col("ruled") == "block", F.lit(False)) if listed is None else F.lit(False)
    hosts = parts.select(F.col("host").alias("key"), stops.alias("listed"))
    if listed is not None:
        hosts = hosts.union(listed.filter("key is not null").select(F.col("key").cast("string").alias("key"), F.lit(True).alias("listed")))
    universe = stored(hosts.groupBy("key").agg(F.bool_or("listed").alias("listed")), "url-universe")
    shards = max(1, -(-universe.filter("listed").count() // shard_keys))

    def judged(rows: DataFrame, levels: list[Level]) -> DataFrame:
        method = F.when(member(F.col("host"), levels), F.lit("block")).otherwise(F.lit("allow"))
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))

    if shards == 1:
        return judged(parts, cascade(universe))
    shard = lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")
    dealt, path_ = scratch_path(pages.sparkSession, "url-parts"), scratch_path(pages.sparkSession, "url-verdicts")
    parts.withColumn("shard", shard(F.col("host"))).write.partitionBy("shard").parquet(dealt)
    dealt_parts = pages.sparkSession.read.schema(T.StructType([*parts.schema.fields, T.StructField("shard", T.IntegerType())])).parquet(dealt)
    for i in range(shards):
        judged(dealt_parts.filter(F.col("shard") == i), cascade(universe.filter(shard(F.col("key")) == i))).write.mode("append").parquet(path_)
    return pages.sparkSession.read.schema(judged(parts, []).schema).parquet(path_)
