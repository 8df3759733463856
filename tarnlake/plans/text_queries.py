"""Registered queries: classification, entities, routing, tokens, keywords, arbitration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import arbitration, extraction, graph
from ..sources import views
from . import sql
from .registry import ORACLES, query

_S, _E, _P = (sql.hits("text", p) for p in (fixed.SEMANTIC, fixed.EPISODIC, fixed.PROCEDURAL))


@query(
    "classify_memory_type",
    f"""WITH h AS (SELECT doc_id AS id, {_S} AS s, {_E} AS e, {_P} AS p FROM documents),
    o AS (SELECT *, greatest(s, e, p) AS best, list_sort([s, e, p])[2] AS second FROM h)
    SELECT id, CASE WHEN best = second OR s = best THEN 'semantic' WHEN e = best THEN 'episodic' ELSE 'procedural' END AS memory_type,
           round(CASE WHEN best = 0 THEN 0.5 WHEN best = second THEN 0.4 ELSE least(0.95::DOUBLE, 0.6::DOUBLE + (best - second) * 0.1::DOUBLE) END, 6) AS confidence FROM o""",
)
def classify_memory_type(spark: SparkSession, d: str) -> DataFrame:
    kind = text.memory_type(F.col("text"))
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), kind.alias("k")).select("id", "k.memory_type", F.round("k.confidence", 6).alias("confidence"))


#: Sentences that the data's words are put into, so that every kind of entity occurs.
_SAID = (
    "concat('My name is ', upper(left(w, 1)), lower(substr(w, 2, 5)), 'a. ', 'She works at Acme', CASE WHEN doc_id % 2 = 0 THEN ' Labs' ELSE '' END, ' and lives in Paris, ', "
    "CASE WHEN doc_id % 3 = 0 THEN 'prefers TypeScript over Java' ELSE 'uses Docker' END, '. We talked about ', lower(w), '. Does Bob know?')"
)
_WORD = "regexp_extract(text, '([A-Za-z]+)', 1)"
_TYPED = [(fixed.PERSON, "person", 0.7), (fixed.LOCATION, "location", 0.6), (fixed.ORGANIZATION, "organization", 0.6), (fixed.PREFERENCE, "preference", 0.5), (fixed.TOPIC, "topic", 0.4)]


def _sql_pattern(x: str, p: str) -> str:
    fold = ", 'i'" if p.startswith("(?i)") else ""
    return f"regexp_extract_all({x}, {sql.text(p.removeprefix('(?i)'))}, 1{fold})"


_STOP = sql.words(fixed.ENTITY_STOPWORDS)
_RAW = " UNION ALL ".join(
    f"SELECT id, '{kind}' AS type, {sure}::DOUBLE AS confidence, {i * 100 + j} AS src, unnest({_sql_pattern('said', p)}) AS raw, generate_subscripts({_sql_pattern('said', p)}, 1) AS pos FROM said"
    for i, (ps, kind, sure) in enumerate(_TYPED)
    for j, p in enumerate(ps)
)
_VOCABULARY = ", ".join(f"({sql.text(t)}, '{k}', {c}::DOUBLE, {10_000 + i})" for i, (t, k, c) in enumerate(fixed.VOCABULARY))
_RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TYPE_RANK.items())
_ENTITIES = f"""said AS (SELECT doc_id AS id, {_SAID} AS said FROM (SELECT doc_id, {_WORD} AS w FROM documents)),
raw AS ({_RAW} UNION ALL SELECT id, type, confidence, src, term, 1 FROM said JOIN (VALUES {_VOCABULARY}) v(term, type, confidence, src) ON contains(said, term)),
clean AS (SELECT *, CASE WHEN src >= 10000 THEN raw ELSE trim(regexp_replace(trim(raw), '[.!?,;:''"]+$', '')) END AS name FROM raw),
good AS (SELECT *, lower(name) AS low, CASE type {_RANKS} END AS r FROM clean
    WHERE src >= 10000 OR length(name) >= 2 AND len(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: NOT list_contains({_STOP}, w))) > 0),
merged AS (SELECT id, low, arg_min(struct_pack(name := name, type := type, confidence := confidence), struct_pack(r := -r, src := src, pos := pos)) AS e, min(struct_pack(src := src, pos := pos)) AS place FROM good GROUP BY id, low),
entities AS (SELECT id, e.name AS name, e.type AS type, e.confidence AS confidence, row_number() OVER (PARTITION BY id ORDER BY place) AS position FROM merged)"""
#: The same over the documents' own texts.
_WHOLE = "said AS (SELECT doc_id AS id, text AS said FROM documents),\n" + _ENTITIES.split("\n", 1)[1]


def said(spark: SparkSession, d: str) -> DataFrame:
    w = views.table(spark, d, "documents").select("doc_id", F.expr(_WORD).alias("w"))
    return w.select(F.col("doc_id").alias("id"), F.expr(_SAID).alias("said"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("said"))


@query("extract_entities", f"WITH {_ENTITIES} SELECT id, name, type, confidence, position FROM entities")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(said(spark, d))


def _extracted(rows: DataFrame) -> DataFrame:
    e = rows.select("id", F.posexplode(extraction.entities(F.col("said"))).alias("position", "e"))
    return e.select("id", "e.name", "e.type", "e.confidence", (F.col("position") + 1).alias("position"))


@query("extract_entities_whole", f"WITH {_WHOLE} SELECT id, name, type, confidence, position FROM entities")
def extract_entities_whole(spark: SparkSession, d: str) -> DataFrame:
    """The entities of whole documents."""
    return _extracted(texts(spark, d))


@query(
    "extract_query_entities",
    f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, {sql.text(fixed.QUERY_ENTITY)}, 1)) AS name, generate_subscripts(regexp_extract_all(text, {sql.text(fixed.QUERY_ENTITY)}, 1), 1) AS pos FROM conversations)
    SELECT conv_id, turn, arg_min(name, pos) AS name FROM w WHERE NOT list_contains({sql.words(fixed.QUERY_STOPWORDS)}, name) GROUP BY conv_id, turn, lower(name)""",
)
def extract_query_entities(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.explode(text.query_entities(F.col("text"))).alias("name"))


@query(
    "infer_relations",
    f"""WITH {_ENTITIES} SELECT a.id, a.name AS from_name, a.type AS from_type, b.name AS to_name, b.type AS to_type,
        CASE WHEN a.type = 'person' AND b.type = 'location' THEN 'ASSOCIATED_WITH' WHEN a.type = 'person' AND b.type = 'organization' THEN 'WORKS_AT'
             WHEN a.type = 'person' AND b.type = 'preference' THEN 'HAS_PREFERENCE' ELSE 'RELATED_TO' END AS relation
    FROM entities a JOIN entities b ON a.id = b.id AND a.position < b.position""",
)
def infer_relations(spark: SparkSession, d: str) -> DataFrame:
    return extraction.relations(said(spark, d).select("id", extraction.entities(F.col("said")).alias("entities")))


@query("infer_relations_whole", ORACLES["infer_relations"].replace(_ENTITIES, _WHOLE))
def infer_relations_whole(spark: SparkSession, d: str) -> DataFrame:
    """The relations within whole documents."""
    return extraction.relations(texts(spark, d).select("id", extraction.entities(F.col("said")).alias("entities")))


@query(
    "merge_entities_and_edges",
    f"""WITH {_ENTITIES}, known AS (SELECT name, type FROM entities WHERE confidence >= 0.6 GROUP BY name, type),
    pairs AS (SELECT DISTINCT a.name AS from_name, a.type AS from_type, b.name AS to_name, b.type AS to_type,
        regexp_replace(upper(CASE WHEN a.type = 'person' THEN 'knows-of' ELSE 'seen with' END), '[^A-Z0-9_]', '_', 'g') AS relation
        FROM entities a JOIN entities b ON a.id = b.id AND a.position < b.position)
    SELECT p.* FROM pairs p WHERE (from_name, from_type) IN (SELECT (name, type) FROM known) AND (to_name, to_type) IN (SELECT (name, type) FROM known)""",
)
def merge_entities_and_edges(spark: SparkSession, d: str) -> DataFrame:
    return _merged(said(spark, d))


@query("merge_entities_and_edges_whole", ORACLES["merge_entities_and_edges"].replace(_ENTITIES, _WHOLE))
def merge_entities_and_edges_whole(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the entities of whole documents."""
    return _merged(texts(spark, d))


def _merged(rows: DataFrame) -> DataFrame:
    e = rows.select("id", extraction.entities(F.col("said")).alias("entities"))
    each = e.select("id", F.explode("entities").alias("e")).select("id", "e.name", "e.type", "e.confidence")
    known = graph.merge_entities(each.where("confidence >= 0.6"))
    r = extraction.relations(e).withColumn("relation", F.when(F.col("from_type") == "person", F.lit("knows-of")).otherwise(F.lit("seen with")))
    return graph.merge_edges(r.drop("id"), known)


@query(
    "route_query",
    f"""WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'What books has Ann read? ' || text WHEN 1 THEN 'How many times did it rain?' WHEN 2 THEN 'Name all of them' ELSE text END AS q FROM benchmark)
    SELECT item_id, CASE WHEN {sql.any_match('q', fixed.AGGREGATION)} THEN 'AGGREGATION' ELSE 'DIRECT' END AS route FROM q""",
)
def route_query(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id") % 4
    q = F.when(i == 0, F.concat(F.lit("What books has Ann read? "), F.col("text"))).when(i == 1, F.lit("How many times did it rain?")).when(i == 2, F.lit("Name all of them")).otherwise(F.col("text"))
    return views.table(spark, d, "benchmark").select("item_id", text.route(q).alias("route"))


@query("token_count", f"SELECT doc_id, {sql.token_count('text')} AS tokens FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query(
    "truncate_tokens",
    r"""SELECT doc_id, CASE WHEN len(string_split_regex(text, '\s+')) <= 38 THEN text ELSE array_to_string(string_split_regex(text, '\s+')[1:38], ' ') || '...' END AS short FROM documents""",
)
def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.truncate_tokens(F.col("text"), 50).alias("short"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), "text")


@query(
    "keyword_overlap_pairs",
    f"""WITH k AS (SELECT conv_id, turn AS id, {sql.keywords('text')} AS w FROM conversations),
    p AS (SELECT a.conv_id, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS overlap, least(len(a.w), len(b.w)) AS smaller FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.id < b.id)
    SELECT conv_id, a, b, overlap, overlap >= smaller * 0.4::DOUBLE AS same_subject FROM p WHERE overlap > 0""",
)
def keyword_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = _turns(spark, d).select("conv_id", "id", text.keywords(F.col("text")).alias("words"))
    p = arbitration.overlap_pairs(k, within=("conv_id",))
    return p.select("conv_id", "a", "b", "overlap", (F.col("overlap") >= F.least("size_a", "size_b") * F.lit(fixed.SAME_SUBJECT)).alias("same_subject"))


@query(
    "jaccard_pairs",
    f"""WITH k AS (SELECT conv_id, turn AS id, list_distinct({sql.split('lower(text)')}) AS w FROM conversations),
    p AS (SELECT a.conv_id, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS overlap, len(a.w) AS x, len(b.w) AS y FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.id < b.id)
    SELECT conv_id, a, b, round(overlap / (x + y - overlap)::DOUBLE, 6) AS jaccard FROM p WHERE overlap > 0 AND round(overlap / (x + y - overlap)::DOUBLE, 6) >= 0.1""",
)
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = _turns(spark, d).select("conv_id", "id", text.word_set(F.col("text")).alias("words"))
    p = arbitration.overlap_pairs(k, within=("conv_id",))
    j = F.round(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")), 6)
    return p.select("conv_id", "a", "b", j.alias("jaccard")).where("jaccard >= 0.1")


_VERSIONS = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' It was changed and now moved in 2024.' WHEN 2 THEN 'yes, always ' || text ELSE 'no, never ' || text END"


@query(
    "arbitrate_pairs",
    f"""WITH t AS (SELECT conv_id, turn, {_VERSIONS} AS said FROM conversations)
    SELECT a.conv_id, a.turn, {sql.arbitrate('a.said', 'b.said')} AS verdict FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def arbitrate_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_VERSIONS).alias("said"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("said").alias("after"))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", arbitration.arbitrate(F.col("said"), F.col("after")).alias("verdict"))


@query("elaborations", f"WITH t AS (SELECT doc_id, text, text || ' and more of it' AS longer FROM documents) SELECT doc_id, {sql.elaborates('text', 'longer')} AS yes, {sql.elaborates('longer', 'text')} AS back FROM t")
def elaborations(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "documents").select("doc_id", F.col("text"), F.concat(F.col("text"), F.lit(" and more of it")).alias("longer"))
    return t.select("doc_id", arbitration.elaborates(F.col("text"), F.col("longer")).alias("yes"), arbitration.elaborates(F.col("longer"), F.col("text")).alias("back"))


@query("distribute_signatures")
def distribute_signatures(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id"))
    lines = F.sort_array(F.collect_list(F.struct("turn", "text")))
    cards = c.agg(F.transform(lines, lambda x: x["text"]).alias("facts"), F.transform(lines, lambda x: F.concat(F.lit("What about "), F.left(x["text"], F.lit(40)), F.lit("?"))).alias("signatures"))
    return extraction.distribute(cards)


@query(
    "memory_cards",
    """SELECT doc_id, 'note ' || doc_id AS original, 2 AS n_facts, (doc_id % 10) / 10.0::DOUBLE AS importance, CASE WHEN doc_id % 4 < 3 THEN 'now' END AS time_expression FROM documents""",
)
def memory_cards(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are whole, wrapped in talk, fenced, or broken off."""
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"original": "note '), i, F.lit('", "importance": 0.'), (F.col("doc_id") % 10).cast("string"), F.lit(', "atomic_facts": ["a", "b, {c}"], "temporal": {"is_current": true, "time_expression": "now'))
    whole = F.concat(body, F.lit('"}}'))
    form = F.col("doc_id") % 4
    answer = F.when(form == 0, whole).when(form == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" Done."))).when(form == 2, body).otherwise(F.concat(F.regexp_replace(body, r', "temporal.*', ""), F.lit(", ")))
    cards = views.table(spark, d, "documents").select("doc_id", extraction.card(answer).alias("c"))
    return cards.select("doc_id", "c.original", F.size("c.atomic_facts").alias("n_facts"), "c.importance", "c.temporal.time_expression")
