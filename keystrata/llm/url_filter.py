"""Operator 4: URL filter by Bloom filter cascades that are exact over the corpus's keys."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import bounded_batches, fresh, scratch, stored

#: Rules as (host and path, verdict). A rule fits its host and subdomains where the path starts with its own.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts that the method blocks, with their subdomains, where no rule fits.
LISTED_NAMES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org"))
#: Bits for a key and hash functions at the first level and at the later ones.
FIRST, LATER = (10, 7), (3, 2)
#: Bits of a cascade's level; sets of keys that need more are dealt by a hash into several cascades, one pass each.
CASCADE_BITS = 1 << 26
#: Sets of keys that one cascade tells apart: rules that block, rules that allow, listed hosts.
TAGS = ("block", "allow", "listed")


def _seeds(level: int, hashes: int) -> list[int]:
    return [level * 64 + i for i in range(hashes)]


def _contains(level: int, shape: tuple[int, int, bytes], key: str) -> bool:
    """The level's Bloom filter, with the hash that Spark's xxhash64(key, seed) computes."""
    import xxhash

    bits, hashes, filled = shape
    first = xxhash.xxh64_intdigest(key.encode(), 42)
    for seed in _seeds(level, hashes):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), first)
        at = (h - (1 << 64) if h >> 63 else h) % bits
        if not filled[at >> 3] >> (at & 7) & 1:
            return False
    return True


def is_listed(levels: list[tuple[int, int, bytes]], key: str) -> bool:
    """Membership: the first level that lacks the key decides; none does: the last one's side."""
    for level, shape in enumerate(levels):
        if not _contains(level, shape, key):
            return level % 2 == 1
    return len(levels) % 2 == 1


def _level(keys: DataFrame, n: int, level: int) -> tuple[int, int, bytes]:
    """Bloom filter of one level: set bits gathered as 64-bit words by an aggregation."""
    per_key, hashes = LATER if level else FIRST
    bits = max(64, n * per_key)
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(s)), F.lit(bits)) for s in _seeds(level, hashes)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value")).toPandas()
    filled = np.zeros(-(-bits // 64), "<i8")
    filled[words["word"].to_numpy()] = words["value"].to_numpy()
    return bits, hashes, filled.tobytes()


def _passes(sent, level: int):
    @F.arrow_udf("boolean")
    def passes(keys: pa.Array) -> pa.Array:
        return pa.array([_contains(level, sent.value, k) for k in keys.to_pylist()], pa.bool_())

    return passes


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[tuple[int, int, bytes]]:
    """Levels that together tell the listed keys from all other keys of the universe, exactly.

    The first level encodes the listed keys; each further one encodes what the one before lets
    through wrongly, alternately unlisted and listed keys, until nothing is left. Both inputs have
    a column ``key``; duplicates and nulls don't matter. No listed keys: no levels.
    """
    spark = universe.sparkSession
    with scratch(spark):
        listed = stored(listed.select("key").filter("key is not null").distinct(), "cascade-listed")
        n, inside, outside = listed.count(), listed, None
        levels: list[tuple[int, int, bytes]] = []
        while n:
            levels.append(_level(inside, n, len(levels)))
            passes = _passes(spark.sparkContext.broadcast(levels[-1]), len(levels) - 1)
            if outside is None:
                outside = universe.select("key").filter("key is not null").distinct().join(listed, "key", "left_anti")
            wrong = stored(outside.filter(passes("key")), f"cascade-level-{len(levels)}")
            n = wrong.count()
            inside, outside = wrong, inside
        return levels


def with_site(pages: DataFrame, url_col: str, host: str, path: str) -> DataFrame:
    """Host and path of a url; both empty for null or where there is no "://"."""
    rest = F.when(F.col(url_col).contains("://"), F.regexp_extract(url_col, "(?s)^.*?://(.*)$", 1)).otherwise("")
    return pages.withColumns(
        {
            host: F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            path: F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        }
    )


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys under which a rule for this url may be listed, the longest first.

    A key is a host suffix of as many labels as some rule has, and a path prefix as long as some
    rule's, so the list is as short as the rules are alike.
    """
    suffixes = [F.when(F.size(F.split(host, "\\.")) >= n, F.substring_index(host, ".", -n)) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.array_distinct(F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes])))
    keyed = F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))
    return F.transform(F.array_sort(keyed), lambda x: x["key"])


def _shape(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of host labels and lengths of paths that occur in the rules."""
    host, path = F.regexp_extract("key", "^[^/]*", 0), F.regexp_extract("key", "^[^/]*(.*)$", 1)
    rules = rules.filter("key is not null")
    got = rules.agg(F.sort_array(F.collect_set(F.size(F.split(host, "\\.")))), F.sort_array(F.collect_set(F.length(path)))).first()
    return list(got[0]), list(got[1])


def _part(key: str, parts: int) -> int:
    """The part that a key belongs to: Spark's pmod(xxhash64(key), parts)."""
    import xxhash

    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % parts


def _found(sent, part: int, parts: int):
    """Of each array of keys those that a part's cascade lists."""

    @F.arrow_udf("array<string>")
    def find(some: pa.Array) -> pa.Array:
        known: dict[str, bool] = {}
        found = []
        for keys in some.to_pylist():
            for key in keys:
                if key not in known:
                    known[key] = _part(key, parts) == part and is_listed(sent.value, key)
            found.append([key for key in keys if known[key]])
        return pa.array(found, pa.list_(pa.string()))

    return find


def with_listed(pages: DataFrame, candidates: Column, listed: DataFrame, into: str) -> DataFrame:
    """Add the array of those candidate keys that are listed (column key), in the order of the candidates.

    The universe is every candidate key of the pages, found once; a cascade over it answers without
    a join. Where keys, or the wrong answers of the first level to expect, need more than
    CASCADE_BITS, keys are dealt by a hash into several cascades; each is a pass over the pages,
    written in between, so driver and tasks hold one at a time.
    """
    spark = pages.sparkSession
    with scratch(spark):
        universe = stored(pages.select(F.explode(candidates).alias("key")).distinct(), "url-universe")
        n, of_all = listed.distinct().count(), universe.count()
        parts = max(1, -(-n * FIRST[0] // CASCADE_BITS), -(-of_all * LATER[0] // (100 * CASCADE_BITS)))
        out = pages.withColumn(into, F.array().cast("array<string>"))
        for part in range(parts):
            mine = F.pmod(F.xxhash64("key"), F.lit(parts)) == part
            sent = spark.sparkContext.broadcast(build_cascade(listed.filter(mine), universe.filter(mine)))
            out = out.withColumn(into, F.concat(into, _found(sent, part, parts)(candidates)))
            if parts > 1:
                out = stored(out, "url-pass", keep=part + 1 == parts)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, url_col: str = "url") -> DataFrame:
    """All columns of pages with host, path, rule and verdict (renamed where taken).

    rules: columns key (host, then path) and verdict (block or allow); a key listed as both is
    blocked. listed_hosts: column key; these hosts and their subdomains are blocked where no rule
    fits. The three sets are told apart by a tag before each key and share one cascade over the
    pages' complete key universe.

    Null url or one without "://": host and path empty, no rule, allowed. Repeated rows: each
    judged alone. Empty table or rules: no rows, or no rule.
    """
    bounded_batches(pages.sparkSession)
    host, path, found, rule, verdict = fresh(pages, "host", "path", "found_keys", "rule", "verdict")
    sets = [rules.filter("verdict = 'block'"), rules.filter("verdict = 'allow'"), listed_hosts]
    tagged = lambda tag: lambda key: F.concat(F.lit(f"{tag}|"), key)
    listed, candidates = None, []
    for tag, keys in zip(TAGS, sets, strict=True):
        own = keys.filter("key is not null").select(tagged(tag)(F.col("key")).alias("key"))
        listed = own if listed is None else listed.unionByName(own)
        labels, lengths = _shape(keys)
        if labels:
            candidates.append(F.transform(candidate_keys(F.col(host), F.col(path), labels, lengths), tagged(tag)))
    out = with_site(pages, url_col, host, path)
    out = with_listed(out, F.concat(*candidates) if candidates else F.array().cast("array<string>"), listed, found)
    longest = lambda tag: F.substring(F.try_element_at(F.array_sort(F.filter(found, lambda k: F.startswith(k, F.lit(f"{tag}|"))), lambda a, b: F.length(b) - F.length(a)), F.lit(1)), len(tag) + 2, 1 << 30)
    blocked, allowed, by_host = map(longest, TAGS)
    block_wins = F.coalesce(F.length(blocked), F.lit(-1)) >= F.coalesce(F.length(allowed), F.lit(-1))
    fits = F.when(block_wins, blocked).otherwise(allowed)
    by_rule = F.when(fits.isNull(), F.when(by_host.isNull(), "allow").otherwise("block")).when(block_wins, "block").otherwise("allow")
    return out.withColumns({rule: fits, verdict: by_rule}).drop(found)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict for the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "key string, verdict string")
    hosts = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    return judge_urls(pages, rules, hosts).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, p, rule, verdict) AS (VALUES %s),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
         FROM s, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|\\.)(%s)\\.example\\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN fits USING (page_id)
""" % (", ".join(f"('{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{k}', '{v}')" for k, v in RULES), "|".join(LISTED_NAMES))
OP4_SQL = OP4_SQL.replace("\\\\", "\\")
