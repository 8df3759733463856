"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprint, minhash, packing, pii, pipeline, sharding, suffix, toxicity, url_filter
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_NAMES = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {_LOWERED} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW g AS (PARTITION BY norm)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


_PREFERENCES = ", ".join("({}, {}, {})".format(i, *sharding.preference(x, sharding.SLOTS)) for i, x in enumerate(SHARD_NAMES))


@query(
    "op5_sharding",
    f"""
    WITH RECURSIVE prefs(s, start, step) AS (VALUES {_PREFERENCES}),
    turns(t, owner) AS (
        SELECT 0, list_transform(range({sharding.SLOTS}), lambda x: -1)
        UNION ALL
        SELECT t + 1, owner[:slot] || [s] || owner[slot + 2:]
        FROM (
            SELECT t, owner, s, list_filter(
                list_transform(range({sharding.SLOTS}), lambda j: (start + j * step) % {sharding.SLOTS}),
                lambda x: owner[x + 1] = -1)[1] AS slot
            FROM turns JOIN prefs ON s = t % {sharding.SHARDS}
            WHERE t < {sharding.SLOTS})
    ),
    placed AS (SELECT owner FROM turns WHERE t = {sharding.SLOTS}),
    slots AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents)
    SELECT doc_id, slot, format('shard-{{:02d}}', owner[slot + 1]) AS shard FROM slots, placed
    """,
)
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARD_NAMES)


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=False)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


#: Fixed by the query's contract; what fits no rule is allowed.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(
    "op10_url_filter",
    r"""
    WITH parsed AS (
        SELECT row_number() OVER () AS rn, page_id,
               coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    rules(r_host, r_path, r_verdict) AS (VALUES """
    + ", ".join(map(str, URL_RULES))
    + r"""),
    fits AS (
        SELECT rn, max_by(struct_pack(rule := r_host || r_path, verdict := r_verdict), length(r_host || r_path)) AS best
        FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rn)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (rn)
    """,
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query(
    "op1_minhash_near_dedup",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWERED}, '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: w[i + 1:i + 5])) END AS s FROM w),
    sets AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
    e AS (SELECT rep, n, unnest(s) AS g FROM sets),
    links AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    low AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
    SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
    FROM s LEFT JOIN sets ON sets.s = list_sort(s.s) LEFT JOIN low ON low.a = sets.rep
    """,
)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


@query("op2_fingerprint")
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query(
    "op8_suffix_array_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS p FROM d)),
    again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
    runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
        SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
            SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1))::INT AS fresh FROM again)) GROUP BY doc_id, run),
    cuts AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
           sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(n + 1), lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END,
               CASE WHEN i < n THEN 2 * starts[i + 1] ELSE length(h) END - CASE WHEN i = 0 THEN 0 ELSE 2 * ends[i] END)), '') END)) AS kept_sha256
    FROM d LEFT JOIN cuts USING (doc_id)
    """,
)
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(table(spark, sf_dir, "documents"), keep=False)


query("pipeline", pipeline.ORACLE_SQL)(pipeline.run)
