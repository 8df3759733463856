"""Registered queries: remember, versions, forget, decay, consolidation, reports, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import arbitration, lifecycle, retrieval, state
from ..sources import views
from . import sql
from .registry import query

NEAR, LIKE = 0.40, 0.30
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query(
    "fact_dedup_tiers",
    f"""WITH {views.FACTS}, {views.queries_sql(40)}, pairs AS (
        SELECT query_id, f.id, {sql.cosine('f.embedding', 'query_embedding')} AS similarity FROM queries, facts f WHERE active_until IS NULL AND f.embedding IS NOT NULL),
    best AS (SELECT query_id, arg_min(id, struct_pack(s := -similarity, id := id)) AS closest, max(similarity) AS similarity FROM pairs WHERE similarity >= 0.25 GROUP BY query_id)
    SELECT q.query_id, closest, similarity, CASE WHEN similarity > 0.92 THEN 'skip' WHEN similarity >= 0.25 AND q.query_id % 2 = 0 THEN 'supersede' ELSE 'store' END AS action FROM queries q LEFT JOIN best USING (query_id)""",
)
def fact_dedup_tiers(spark: SparkSession, d: str) -> DataFrame:
    q = views.query_batch(spark, d, 40)
    best = retrieval.knn(q, views.facts(spark, d).where("active_until IS NULL"), 1, least=0.25)
    rows = q.select("query_id").join(best.select("query_id", F.col("id").alias("closest"), "similarity"), "query_id", "left")
    action = arbitration.fact_tier(F.col("similarity"), F.col("query_id") % 2 == 0, ambiguous=0.25)
    return rows.select("query_id", "closest", "similarity", F.when(F.col("similarity").isNull(), F.lit("store")).otherwise(action).alias("action"))


@query(
    "remember_decisions",
    f"""WITH {views.MEMORIES}, m AS (SELECT * FROM memories WHERE embedding IS NOT NULL),
    pairs AS (SELECT a.id, b.id AS other, {sql.cosine('a.embedding', 'b.embedding')} AS similarity, a.content AS new_, b.content AS old_ FROM m a JOIN m b ON b.id < a.id WHERE a.id < 120),
    near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM pairs WHERE similarity >= {LIKE}),
    judged AS (SELECT *, {sql.arbitrate('old_', 'new_')} AS verdict FROM near WHERE rank <= 5),
    g AS (SELECT id, max(similarity) AS top, arg_min(other, rank) AS closest, arg_min(verdict, rank) FILTER (WHERE verdict IN ('update', 'elaboration')) AS deciding, arg_min(other, rank) FILTER (WHERE verdict IN ('update', 'elaboration')) AS decider, count(*) FILTER (WHERE verdict = 'contradiction') AS against FROM judged GROUP BY id)
    SELECT id, CASE WHEN top >= {NEAR} THEN 'duplicate' WHEN deciding IS NOT NULL THEN deciding WHEN against > 0 THEN 'contradiction' ELSE 'new' END AS action,
        CASE WHEN top >= {NEAR} THEN closest ELSE decider END AS target, CASE WHEN top >= {NEAR} OR deciding IS NOT NULL THEN 0 ELSE against END AS conflicts FROM g""",
)
def remember_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What would become of each new memory beside all older ones."""
    m = views.memories(spark, d).where("embedding IS NOT NULL")
    new = m.where(views.asked("id", 120)).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("content").alias("new"))
    near = retrieval.knn(new, m.select("id", "embedding"), 5, least=LIKE, older=True)
    texts = near.join(new.select("query_id", "new"), "query_id").join(m.select("id", F.col("content").alias("old")), "id")
    pairs = texts.select(F.col("query_id").alias("id"), F.col("id").alias("other"), "similarity", arbitration.arbitrate(F.col("old"), F.col("new")).alias("verdict"))
    out = arbitration.remember_decision(pairs, NEAR, LIKE)
    return out.select("id", "action", "target", F.size("conflicts").alias("conflicts"))


_LOG = "log AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value, event_type FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("put")).alias("op"), "value", "event_type")


@query("latest_version", f"WITH {_LOG} SELECT id, seq, op, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM log) WHERE k = 1 AND op <> 'delete'")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(_log(spark, d))


_GONE = "gone AS (SELECT doc_id AS id FROM documents WHERE doc_id % 50 = 3 UNION ALL SELECT -1)"


def _forgotten(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    ids = views.table(spark, d, "documents").where("doc_id % 50 = 3").select(F.col("doc_id").alias("id")).union(spark.range(1).select((F.col("id") - 1)))
    m = views.memories(spark, d, vectors=False, text=False)
    f = views.facts(spark, d).drop("embedding").withColumn("superseded_by", F.col("id") + 100)
    conflicts = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("memory_a"), (F.col("doc_id") + 1).alias("memory_b"))
    e = views.mentions(spark, d).select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), "entity_id")
    e = e.union(views.facts(spark, d).select(F.lit("fact"), "id", (F.col("id") % 9).alias("entity_id")))
    return state.forget(ids, m, f, conflicts, e)


@query(
    "forget_report",
    f"""WITH {views.FACTS}, {views.MENTIONS}, {_GONE}, known AS (SELECT id FROM gone WHERE id IN (SELECT doc_id FROM documents)),
    fe AS (SELECT f.memory_id AS id, count(*) AS n FROM facts f JOIN known k ON k.id = f.memory_id GROUP BY 1), me AS (SELECT memory_id AS id, count(*) AS n FROM mentions JOIN known k ON k.id = memory_id GROUP BY 1)
    SELECT g.id, g.id IN (SELECT id FROM known) AS found, coalesce(me.n, 0) + coalesce(fe.n, 0) AS edges_removed, coalesce(fe.n, 0) AS facts_removed FROM gone g LEFT JOIN fe USING (id) LEFT JOIN me USING (id)""",
)
def forget_report(spark: SparkSession, d: str) -> DataFrame:
    return _forgotten(spark, d)["report"]


@query(
    "forget_cascade",
    f"""WITH {views.FACTS}, {views.MENTIONS}, {_GONE}
    SELECT 'memories' AS part, count(*) AS n, 0 AS nulled FROM documents WHERE doc_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'facts', count(*), count(*) FILTER (WHERE (id + 100) IN (SELECT id FROM facts WHERE memory_id IN (SELECT id FROM gone))) FROM facts WHERE memory_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'conflicts', count(*), 0 FROM documents WHERE doc_id NOT IN (SELECT id FROM gone) AND doc_id + 1 NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'mentions', (SELECT count(*) FROM mentions WHERE memory_id NOT IN (SELECT id FROM gone WHERE id IN (SELECT doc_id FROM documents))) + (SELECT count(*) FROM facts WHERE memory_id NOT IN (SELECT id FROM gone)), 0""",
)
def forget_cascade(spark: SparkSession, d: str) -> DataFrame:
    left = _forgotten(spark, d)
    out = None
    for part in ("memories", "facts", "conflicts", "mentions"):
        nulled = F.count_if(F.col("superseded_by").isNull()) if part == "facts" else F.lit(0)
        n = left[part].agg(F.count("*").alias("n"), nulled.alias("nulled")).select(F.lit(part).alias("part"), "n", F.col("nulled").cast("int").alias("nulled"))
        out = n if out is None else out.union(n)
    return out


@query("invalidate_rows", f"WITH {views.MEMORIES} SELECT id, coalesce(invalid_at, CASE WHEN id % 3 = 0 THEN {_NOW} END) IS NOT NULL AS has_end, invalid_at IS NULL AND id % 3 = 0 AS ended_now FROM memories")
def invalidate_rows(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d, vectors=False, text=False)
    out = state.invalidate(m.withColumn("before", F.col("invalid_at")), m.where("id % 3 = 0"), views.now())
    return out.select("id", F.col("invalid_at").isNotNull().alias("has_end"), (F.col("before").isNull() & F.col("invalid_at").isNotNull()).alias("ended_now"))


@query(
    "supersede_facts",
    f"""WITH {views.FACTS}, p AS (SELECT id AS old, min(id + 1) AS new_ FROM facts WHERE turn % 2 = 0 GROUP BY id)
    SELECT id, CASE WHEN active_until IS NULL THEN new_ END AS superseded_by, active_until IS NULL AND new_ IS NULL AS active FROM facts LEFT JOIN p ON old = id""",
)
def supersede_facts(spark: SparkSession, d: str) -> DataFrame:
    f = views.facts(spark, d).drop("embedding")
    pairs = f.where("turn % 2 = 0").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))
    return state.supersede(f, pairs, views.now()).select("id", "superseded_by", F.col("active_until").isNull().alias("active"))


@query("replace_contents", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'new ' || doc_id ELSE text END AS content, doc_id % 4 = 1 AS updated FROM documents")
def replace_contents(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d)
    news = m.where("id % 4 = 1").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("content"), "embedding")
    return state.replace_content(m, news, views.now()).select("id", "content", F.col("updated_at").isNotNull().alias("updated"))


_CONFLICTS = f"conflicts AS (SELECT event_id AS id, user_id AS memory_a, (user_id * 7 + event_id) % 50 AS memory_b, CASE WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'resolved' END AS resolution, ts AS created_at FROM events)"


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("memory_a"), ((F.col("user_id") * 7 + F.col("event_id")) % 50).alias("memory_b"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("pending")).otherwise(F.lit("resolved")).alias("resolution"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


@query("pending_conflicts", f"WITH {_CONFLICTS} SELECT id, memory_a, memory_b FROM conflicts WHERE resolution = 'pending' AND (memory_a = 5 OR memory_b = 5)")
def pending_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return state.pending_conflicts(_conflicts(spark, d), spark.range(5, 6)).select("id", "memory_a", "memory_b")


@query("resolve_conflicts", f"WITH {_CONFLICTS} SELECT CASE WHEN id % 10 = 0 THEN 'keep_new' ELSE resolution END AS resolution, count(*) AS n FROM conflicts GROUP BY 1")
def resolve_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = _conflicts(spark, d)
    return state.resolve(c, c.where("id % 10 = 0"), "keep_new", views.now()).groupBy("resolution").agg(F.count("*").alias("n"))


_DECAYED = f"""decayed AS (SELECT *, coalesce(coalesce(last_accessed, created_at) < {_NOW} - INTERVAL 1 DAY AND importance > 0.05 AND (expires_at IS NULL OR expires_at > {_NOW}), false) AS decayed FROM access_log),
after AS (SELECT * REPLACE (CASE WHEN decayed THEN greatest(0.05::DOUBLE, round(importance * pow(0.95::DOUBLE, date_diff('microsecond', coalesce(last_accessed, created_at), {_NOW}) / 86400000000.0::DOUBLE), 9)) ELSE importance END AS importance) FROM decayed)"""


@query("decay_importance", f"WITH {views.ACCESS_LOG}, {_DECAYED} SELECT id, decayed, round(importance, 6) AS importance FROM after")
def decay_importance(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.decay(views.access_log(spark, d), views.now()).select("id", "decayed", F.round("importance", 6).alias("importance"))


@query(
    "archive_stale",
    f"WITH {views.ACCESS_LOG}, {_DECAYED} SELECT id, coalesce(importance <= 0.05 AND (expires_at IS NULL OR expires_at > {_NOW} + INTERVAL 30 DAY), false) AS archived, importance <= 0.05 OR expires_at IS NOT NULL AS ends FROM after",
)
def archive_stale(spark: SparkSession, d: str) -> DataFrame:
    out = lifecycle.run_decay(views.access_log(spark, d), views.now())
    return out.select("id", F.coalesce("archived", F.lit(False)).alias("archived"), F.col("expires_at").isNotNull().alias("ends"))


@query("low_importance_order", f"WITH {views.ACCESS_LOG} SELECT id, importance FROM access_log WHERE importance <= 0.2 AND (expires_at IS NULL OR expires_at > {_NOW}) ORDER BY importance, last_accessed NULLS FIRST, id LIMIT 50")
def low_importance_order(spark: SparkSession, d: str) -> DataFrame:
    rows = views.access_log(spark, d).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    return lifecycle.low_importance(rows, views.now()).select("id", "importance")


_RECENT = f"""recent AS (SELECT event_id AS id, user_id, ts AS created_at, event_type AS theme, ['semantic', 'episodic', 'procedural'][event_id % 3 + 1] AS memory_type, 'event ' || event_id AS content FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR)"""


def _recent(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("semantic", "episodic", "procedural"))), (F.col("event_id") % 3 + 1).cast("int"))
    e = views.table(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("theme"), kinds.alias("memory_type"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("content"), F.lit(None).cast("timestamp_ntz").alias("expires_at"),
    )
    return e.where(F.col("created_at") > F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 48 HOURS"))


@query("recent_lookback", f"WITH {_RECENT} SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS k FROM recent WHERE created_at > TIMESTAMP '2024-01-29 00:00:00') WHERE k <= 5")
def recent_lookback(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return lifecycle.recent(_recent(spark, d), at, 24, most=5, by="user_id").select("id", "user_id")


@query("recent_episodic", f"WITH {_RECENT} SELECT id FROM recent WHERE memory_type = 'episodic' AND created_at > TIMESTAMP '2024-01-29 00:00:00' ORDER BY created_at DESC, id LIMIT 50")
def recent_episodic(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.recent(_recent(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 24, most=50, kind="episodic").select("id")


@query(
    "reflect_themes",
    f"""WITH {_RECENT}, g AS (SELECT theme, count(*) AS n, bool_or(memory_type = 'episodic') AS epi, list(content ORDER BY created_at DESC, id)[1:3] AS c FROM recent GROUP BY theme HAVING count(*) >= 2)
    SELECT theme, n, CASE WHEN epi THEN 'Based on ' || n || ' recent interactions related to "' || theme || '": ' || array_to_string(c, '. ') || '. This appears to be a recurring pattern.'
        ELSE 'Consolidated knowledge about "' || theme || '": ' || array_to_string(c, '. ') || '.' END AS insight FROM g""",
)
def reflect_themes(spark: SparkSession, d: str) -> DataFrame:
    """Themes of the lookback with their insight; only the three newest texts of a theme are carried."""
    from pyspark.sql import Window

    r = _recent(spark, d)
    newest = r.withColumn("k", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("created_at"), "id"))).where("k <= 3")
    first = newest.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]).alias("contents"))
    g = r.groupBy("theme").agg(F.count("*").alias("n"), F.collect_set("memory_type").alias("kinds")).where("n >= 2").join(first, "theme")
    return g.select("theme", "n", lifecycle.insight(F.col("theme"), F.col("n"), F.col("kinds"), F.col("contents")).alias("insight"))


@query(
    "reflect_greedy_groups",
    f"""WITH RECURSIVE w AS (SELECT conv_id AS user_id, conv_id * 100 + turn AS id, turn, unnest(regexp_extract_all(text, {sql.text(fixed.QUERY_ENTITY)}, 1)) AS name, generate_subscripts(regexp_extract_all(text, {sql.text(fixed.QUERY_ENTITY)}, 1), 1) AS pos FROM conversations),
    e AS (SELECT user_id, id, turn, lower(name) AS theme, min(pos) AS pos FROM w WHERE NOT list_contains({sql.words(fixed.QUERY_STOPWORDS)}, name) GROUP BY user_id, id, turn, lower(name)),
    t AS (SELECT user_id, theme, list(id ORDER BY turn) AS ids, min(struct_pack(turn := turn, pos := pos)) AS seen FROM e GROUP BY user_id, theme),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS k FROM t),
    steps(user_id, k, taken, own) AS (
        SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM o
        UNION ALL
        SELECT user_id, k, CASE WHEN len(free) > 1 THEN list_concat(taken, free) ELSE taken END, CASE WHEN len(free) > 1 THEN free ELSE [] END
        FROM (SELECT s.user_id, o.k, s.taken, list_filter(o.ids, lambda i: NOT list_contains(s.taken, i)) AS free FROM steps s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1))
    SELECT s.user_id, theme, (row_number() OVER (PARTITION BY s.user_id ORDER BY s.k) - 1)::INT AS position, own AS ids FROM steps s JOIN o ON o.user_id = s.user_id AND o.k = s.k WHERE len(own) > 1""",
)
def reflect_greedy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Greedy groups by shared query entities among each conversation's turns."""
    from ..functions import text

    c = views.table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("turn").alias("ord"), F.transform(text.query_entities(F.col("text")), F.lower).alias("themes"))
    return lifecycle.greedy_groups(c)


@query(
    "status_report",
    f"""WITH {views.MEMORIES}, {_CONFLICTS} SELECT 'memories: ' || memory_type AS item, count(*) AS n FROM memories GROUP BY memory_type
    UNION ALL SELECT 'memories', count(*) FROM memories UNION ALL SELECT 'entities', count(*) FROM part
    UNION ALL SELECT 'conflicts', count(*) FROM conflicts UNION ALL SELECT 'conflicts: pending', count(*) FILTER (WHERE resolution = 'pending') FROM conflicts""",
)
def status_report(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d, vectors=False, text=False)
    kinds = m.groupBy("memory_type").count().select(F.concat(F.lit("memories: "), F.col("memory_type")).alias("item"), F.col("count").alias("n"))
    c = _conflicts(spark, d).agg(F.count("*").alias("all"), F.count_if(F.col("resolution") == "pending").alias("open"))
    rows = c.select(F.explode(F.array(F.struct(F.lit("conflicts").alias("item"), F.col("all").alias("n")), F.struct(F.lit("conflicts: pending").alias("item"), F.col("open").alias("n")))).alias("r")).select("r.item", "r.n")
    total = m.agg(F.count("*").alias("n")).select(F.lit("memories").alias("item"), "n")
    entities = views.table(spark, d, "part").agg(F.count("*").alias("n")).select(F.lit("entities").alias("item"), "n")
    return kinds.union(total).union(entities).union(rows)


@query(
    "validation_errors",
    """SELECT doc_id, n_chars, array_to_string(list_filter([CASE WHEN n_chars NOT BETWEEN 0 AND 5000 THEN 'n_chars' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang' END, CASE WHEN count(*) OVER (PARTITION BY source, n_chars) > 1 THEN 'source+n_chars' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""",
)
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    t = state.check(views.table(spark, d, "documents"), {"n_chars": (0, 5000)}, {"lang": ["en", "de"]}, ["source", "n_chars"])
    return t.select("doc_id", "n_chars", F.array_join("errors", ",").alias("errors"))


@query(
    "insert_defaults",
    "SELECT doc_id AS id, 'semantic' AS memory_type, 1.0::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS importance, 'agent_observation' AS source, false AS shared, '{}' AS metadata, 0 AS access_count FROM documents",
)
def insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    new = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.lit(0.9)).alias("importance"))
    return state.insert_defaults(new, views.now()).select("id", "memory_type", "confidence", "importance", "source", "shared", "metadata", "access_count")


@query(
    "metadata_merge",
    "SELECT doc_id, 'card' AS kind, lang AS lang, 'rule' AS by_ FROM documents",
)
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "documents")
    user = F.create_map(F.lit("kind"), F.lit("user"), F.lit("lang"), F.col("lang"))
    m = state.merged_metadata(user, F.create_map(F.lit("kind"), F.lit("card")), F.create_map(F.lit("by_"), F.lit("rule")))
    return t.select("doc_id", m.alias("m")).select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("kind", "lang", "by_")))


@query(
    "sliding_consolidation",
    """WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01 00:00:00') AS b, event_type, value FROM events), x AS (SELECT b AS start, * FROM w UNION ALL SELECT b - INTERVAL 12 HOUR, * FROM w)
    SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', start) AS start_hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL""",
)
def sliding_consolidation(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import ingest

    return ingest.sliding(views.table(spark, d, "events"))
