"""URL filters by Bloom filter cascades: exact membership without joins.

A cascade holds a list of keys relative to a universe, here every key that the
corpus's URLs can be looked up by. Level 1 encodes the listed keys. Its false
positives within the universe are encoded by level 2, the listed keys that pass
level 2 by level 3, and so on until a level has no false positive. The first
level that says no decides, so the answer is exact for every key of the
universe. Everything here is DataFrame operations. The finished levels follow
the list, not the corpus: small ones are binary literals in the plan, larger ones
are written as rows of 4 KB by a hash of the key, and looked up by that hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = 32768  # bits that one bitmap of Spark's bitmap functions holds

#: Up to this many bytes a level is sent along as a literal; beyond, it is a table of blocks.
LITERAL_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a prefix of the path."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _bit(data: Column, p: Column) -> Column:
    byte = F.conv(F.hex(F.substring(data, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("bigint"), F.pmod(p, F.lit(8)).cast("int")) == 1


@dataclass(frozen=True)
class Level:
    """A Bloom filter in one piece, as a literal."""

    bits: int
    hashes: int
    seed: int
    data: bytes

    def contains(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        found = F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.seed):
            found = found & _bit(F.lit(self.data), p)
        return found

    def mark(self, keys: DataFrame, name: str) -> DataFrame:
        return keys.withColumn(name, self.contains(F.col("key")))


@dataclass(frozen=True)
class BlockLevel:
    """A Bloom filter in blocks of one bitmap each: rows (block, data). A key has all its bits in one block."""

    blocks: int
    hashes: int
    seed: int
    rows: DataFrame

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-self.seed)), F.lit(self.blocks))

    def mark(self, keys: DataFrame, name: str) -> DataFrame:
        """The keys with whether their block holds them; keys are dealt evenly over blocks."""
        found = F.col("_data").isNotNull()
        for p in positions(F.col("key"), _WORD, self.hashes, self.seed):
            found = found & _bit(F.col("_data"), p)
        blocks = self.rows.select(F.col("block").alias("_block"), F.col("data").alias("_data"))
        met = keys.withColumn("_block", self.block(F.col("key"))).join(blocks, "_block", "left")
        return met.withColumn(name, F.coalesce(found, F.lit(False))).drop("_block", "_data")


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(64 * seed + j)), F.lit(bits)) for j in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    """Levels that alternately hold listed keys and false positives."""

    levels: tuple[Level | BlockLevel, ...]

    @property
    def literal(self) -> bool:
        """Whether ``contains`` can be used, as all levels are literals."""
        return all(isinstance(x, Level) for x in self.levels)

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe it was built over; null for null."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].contains(key), answer).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNotNull(), answer)

    def mark(self, keys: DataFrame, name: str) -> DataFrame:
        """Rows of ``key`` with whether it is listed, for levels of both kinds."""
        open_ = keys
        for i, level in enumerate(self.levels):
            open_ = level.mark(open_, f"_in{i}")
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(F.col(f"_in{i}"), answer).otherwise(F.lit(i % 2 == 1))
        return open_.withColumn(name, answer).drop(*[f"_in{i}" for i in range(len(self.levels))])


def _level(keys: DataFrame, n: int, rate: float, seed: int, literal_bytes: int) -> Level | BlockLevel:
    """A Bloom filter over the column ``key`` of n rows."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // 8) * 8
    hashes = max(1, round(-math.log2(rate)))
    word = F.bitmap_construct_agg(F.pmod("p", F.lit(_WORD))).alias("data")
    if bits // 8 > literal_bytes:
        level = BlockLevel(-(-bits // _WORD), hashes, seed, keys)
        at = keys.select(level.block(F.col("key")).alias("block"), F.explode(F.array(*positions(F.col("key"), _WORD, hashes, seed))).alias("p"))
        return BlockLevel(level.blocks, hashes, seed, written(at.groupBy("block").agg(word), "cascade-level"))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    maps = at.groupBy(F.floor(F.col("p") / _WORD).alias("w")).agg(word)
    data = bytearray(-(-bits // _WORD) * (_WORD // 8))
    for row in maps.toLocalIterator():  # literal_bytes at most
        data[row["w"] * (_WORD // 8) : (row["w"] + 1) * (_WORD // 8)] = row["data"]
    return Level(bits, hashes, seed, bytes(data[: bits // 8]))


def build_cascade(universe: DataFrame, rate: float = 0.01, max_levels: int = 40, literal_bytes: int = LITERAL_BYTES) -> Cascade:
    """A cascade of the keys that ``listed`` marks.

    universe: distinct keys as ``key`` (string) and ``listed`` (boolean), read
    once a level, so it should be a written table. Null keys are ignored. A list
    without keys gives a cascade that holds nothing. The bits follow the number
    of listed keys: level 1 lets ``rate`` of the universe through at most, and is
    made so strict that about as many false positives as listed keys remain.
    """
    rows = universe.where(F.col("key").isNotNull())
    sizes = {r["listed"]: r["n"] for r in rows.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = sizes.get(True, 0), sizes.get(False, 0)
    levels: list[Level | BlockLevel] = []
    inside, outside, n = rows.where("listed"), rows.where("NOT listed"), listed
    while n:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade doesn't end; are keys both listed and not?")
        strict = min(rate, listed / others) if not levels and others else 0.5 if levels else rate
        level = _level(inside, n, strict, len(levels) + 1, literal_bytes)
        levels.append(level)
        passed = level.mark(outside, "_in").where("_in").drop("_in")
        inside, outside = written(passed, "cascade-keys") if isinstance(level, BlockLevel) else passed, inside
        n = inside.count()
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    return F.transform(
        F.split(host, r"\.", -1),
        lambda part, i: F.call_function("substring_index", host, F.lit("."), i - F.size(F.split(host, r"\.", -1))),
    )


def lookup_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key by which a rule can fit: each domain with each prefix of the path that is as long as some rule's."""
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(prefixes, lambda p: F.transform(domains(host), lambda d: F.concat(d, p))))


RULE = "host string, path string, verdict string"


#: Python lists of more entries than this are made tables; shorter ones are compared in place, without a join.
SHORT_LIST = 1000


def _listed(universe: DataFrame, keys: list[str] | DataFrame) -> DataFrame:
    """The universe with whether a key is on the list."""
    if isinstance(keys, list):
        return universe.select("key", (F.col("key").isin(keys) if keys else F.lit(False)).alias("listed"))
    marked = universe.join(keys.distinct().withColumn("_l", F.lit(True)), "key", "left")  # broadcast only within Spark's own limit
    return written(marked.select("key", F.coalesce("_l", F.lit(False)).alias("listed")), "marked-keys")


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, blocked_hosts: list[str] | DataFrame, url: str = "url", literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits decides (``rule`` is its host and path); where
    none fits, ``rule`` is null and the verdict is block if the host or a parent
    domain is among ``blocked_hosts``, else allow. Three cascades hold the
    allowing rules, the blocking rules and the blocked hosts; their universe is
    every lookup key of the given pages, so the answers are exact.

    Lists may be tables of any size: rules with host, path and verdict, hosts with
    host. While all levels are literals (up to ``literal_bytes`` each), the rows
    are judged where they are. Otherwise each different lookup key is judged once,
    by a join with its block of the levels, and rows take what is known of their
    host and path.

    A null URL or one without ``://`` has an empty host and path, and no rule
    fits it. Repeated rows stay, and so do repeated rules. Columns of the input
    that are named like a result are replaced. An empty table gives an empty
    result; null hosts and paths on a list are ignored.
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > SHORT_LIST:
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], RULE)
    if not isinstance(blocked_hosts, DataFrame) and len(blocked_hosts) > SHORT_LIST:
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    if isinstance(rules, DataFrame):
        rows = rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").where("key IS NOT NULL")
        allowing, blocking = (rows.where(F.col("verdict") == v).select("key") for v in ("allow", "block"))
        both = [r["key"] for r in allowing.intersect(blocking).limit(10).collect()]
        lengths = sorted({0, *(r["n"] for r in rows.select("n").distinct().collect())})  # no more than a path has characters
    else:
        allowing, blocking = ([r.key for r in rules if r.verdict == v] for v in ("allow", "block"))
        both, lengths = set(allowing) & set(blocking), sorted({0, *(len(r.path) for r in rules)})
    if both:
        raise ValueError(f"rules both allow and block {sorted(both)}")
    hosts = blocked_hosts
    if isinstance(blocked_hosts, DataFrame):
        hosts = blocked_hosts.select(F.col("host").alias("key")).where("key IS NOT NULL")
    parts = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = parts.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
    universe = written(seen.select(F.explode(lookup_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "url-keys")
    cascades = [build_cascade(_listed(universe, keys), literal_bytes=literal_bytes) for keys in (allowing, blocking, hosts)]
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not all(c.literal for c in cascades):
        return _judge_by_key(out, seen, universe, cascades, lengths)
    allow, block, blocked = cascades
    fits = F.filter(
        F.transform(
            F.array_distinct(lookup_keys(F.col("host"), F.col("path"), lengths)),
            lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.when(allow.contains(k), "allow").when(block.contains(k), "block").alias("verdict")),
        ),
        lambda s: s["verdict"].isNotNull(),
    )
    out = out.withColumn("_best", F.array_max(fits))
    listed = F.exists(domains(F.col("host")), lambda d: blocked.contains(d))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(listed, "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": verdict}).drop("_best")


def _judge_by_key(out: DataFrame, seen: DataFrame, universe: DataFrame, cascades: list[Cascade], lengths: list[int]) -> DataFrame:
    """The rows judged through a table of the lookup keys that some list has."""
    marked = universe
    for c, name in zip(cascades, ("allow", "block", "blocked"), strict=True):
        marked = c.mark(marked, name)
    known = written(marked.where("allow OR block OR blocked"), "listed-keys")
    pairs = seen.select("host", "path", F.explode(F.array_distinct(lookup_keys(F.col("host"), F.col("path"), lengths))).alias("key")).join(known, "key")
    is_domain = F.array_contains(domains(F.col("host")), F.col("key"))  # a prefix of no length: the key is a host
    rule = F.when(F.col("allow") | F.col("block"), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.when(F.col("allow"), "allow").otherwise("block").alias("verdict")))
    judged = pairs.groupBy("host", "path").agg(F.max(rule).alias("_best"), F.max(F.col("blocked") & is_domain).alias("_listed"))
    judged = written(judged.withColumnsRenamed({"host": "_host", "path": "_path"}), "judged-hosts")
    near = (F.col("host") == F.col("_host")) & (F.substring("path", 1, max(lengths)) == F.col("_path"))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    return out.join(judged, near, "left").withColumns({"rule": F.col("_best.rule"), "verdict": verdict}).drop("_best", "_listed", "_host", "_path")
