"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list entry is a canonical key: a host and the start of a path. A URL asks for the keys made of its
host and parent domains with the starts of its path, of the lengths that occur in the list. Keys that
the filter passes go to a hash join on the exact key, which removes false positives. URLs without such a
key are never shuffled. In a block of eight 64-bit words a key sets eight bits, so one key touches one
block. The filter is made once, and its words, at most a megabyte, are a constant of the plan.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter bits for each entry (about 0.3 % false positives in blocks), the most words that a filter may
#: have, and the most entries that the exact join may broadcast; longer lists are shuffled.
BITS_PER_KEY, MOST_WORDS, MOST_BROADCAST = 16, 1 << 17, 100_000
BLOCK = 8


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(_lowered(host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _place(key: Column, blocks: int) -> tuple[Column, list[tuple[int, Column]]]:
    """A key's block, and for each of the block's words the bit that the key sets there."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    return F.pmod(h, F.lit(blocks)).cast("int"), [(i, F.shiftrightunsigned(g, i * 6).bitwiseAND(F.lit(63)).cast("int")) for i in range(BLOCK)]


def bloom(keys: DataFrame, entries: int) -> tuple[Column, int]:
    """The filter's words of keys.key as a constant array<long>, and its number of blocks."""
    blocks = min(MOST_WORDS // BLOCK, max(1, 1 << math.ceil(math.log2(max(1, entries * BITS_PER_KEY / (64 * BLOCK))))))
    block, bits = _place(F.col("key"), blocks)
    each = F.explode(F.array(*(F.struct((block * BLOCK + i).alias("word"), b.alias("bit")) for i, b in bits)))
    words = keys.select(each.alias("x")).groupBy(F.col("x.word").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, x.bit)")).alias("mask"))
    held = [0] * (blocks * BLOCK)
    for r in words.collect():  # MOST_WORDS at most
        held[r.word] = r.mask
    return F.from_json(F.lit(json.dumps(held)), "array<bigint>"), blocks


def passes(key: Column, words: Column, blocks: int) -> Column:
    """Whether all of the key's bits are set in the filter."""
    block, bits = _place(key, blocks)
    places = F.array(*(F.struct((block * BLOCK + i).alias("word"), b.alias("bit")) for i, b in bits))
    return F.forall(places, lambda x: F.getbit(F.get(words, x["word"]), x["bit"]) == 1)


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """A row for each row of pages (page_id, url): page_id, host, path, rule, verdict.

    listed: host, path and verdict of each entry. An entry fits its host and all subdomains, where the
    URL's path starts with the entry's; of those that fit, the longest host with path wins, then the
    longest host, then the smallest rule and verdict. rule is host and path together, null where none
    fits, and verdict is then `default`. A null url, or one without ://, has empty host and path.
    Repeated rows give a row each; a null page_id is a value like others; other columns are not read.
    """
    listed = listed.select(_lowered(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").where("r_host <> ''")
    listed = listed.withColumn("key", F.concat("r_host", F.lit("|"), "r_path")).groupBy("key", "r_host", "r_path").agg(F.min("verdict").alias("r_verdict"))
    size = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    words, blocks = bloom(listed.select("key"), size.n)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted(size.lengths)
    starts = F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.concat(h, F.lit("|"), p))))
    asked = urls.withColumn("keys", F.filter(keys, lambda k: passes(k, words, blocks)))
    # rows alike are judged once; n brings them back
    hits = asked.where(F.size("keys") > 0).groupBy("page_id", "host", "path", "keys").agg(F.count("*").alias("n"))
    hits = hits.select("page_id", "host", "path", "n", F.explode("keys").alias("key"))
    exact = hits.join(F.broadcast(listed) if size.n <= MOST_BROADCAST else listed, "key", "left")
    best = F.when(F.col("r_host").isNotNull(), F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    judged = exact.groupBy("page_id", "host", "path", "n").agg(F.max(best).alias("best"))
    out = judged.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_")).drop("_")
    return out.union(asked.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
