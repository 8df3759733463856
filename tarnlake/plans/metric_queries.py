"""Registered queries: packing, retrieval quality, answers, latency, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


from ..operators import arbitration, metrics, packing
from ..sources import views
from . import sql
from .registry import ORACLES, query
from .retrieval_queries import _KNN, _Q, knn_batch_topk

_FACT_LIST = "l AS (SELECT conv_id AS query_id, conv_id * 100 + turn AS id, turn + 1 AS rank, text AS fact, round(0.9::DOUBLE - turn * 0.1::DOUBLE, 6) AS score FROM conversations)"


def _fact_list(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("text").alias("fact"), F.round(F.lit(0.9) - F.col("turn") * F.lit(0.1), 6).alias("score"))


# The same fold in SQL: used and closed grow along the list; what is taken is where they don't stop it.
_FOLD = f"""costed AS (SELECT *, '- ' || fact AS line, {sql.token_count("'- ' || fact")} AS cost, CASE WHEN score >= 0.4 THEN 0 WHEN score >= 0.2 THEN 1 END AS pass FROM l),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS k FROM costed WHERE pass IS NOT NULL),
fold(query_id, k, used, closed, taken) AS (
    SELECT DISTINCT query_id, 0::BIGINT, 0, -1, false FROM ordered
    UNION ALL
    SELECT f.query_id, f.k + 1,
        CASE WHEN f.closed >= o.pass OR o.pass = 1 AND f.used >= 185 THEN f.used WHEN f.used + o.cost <= 185 THEN f.used + o.cost ELSE f.used END,
        CASE WHEN f.closed >= o.pass OR o.pass = 1 AND f.used >= 185 THEN f.closed WHEN f.used + o.cost <= 185 THEN f.closed ELSE o.pass END,
        NOT (f.closed >= o.pass OR o.pass = 1 AND f.used >= 185) AND f.used + o.cost <= 185
    FROM fold f JOIN ordered o ON o.query_id = f.query_id AND o.k = f.k + 1),
packed AS (SELECT query_id, count(*) AS included, '## FACTS' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS context FROM fold JOIN ordered USING (query_id, k) WHERE taken GROUP BY query_id),
queries_ AS (SELECT DISTINCT query_id FROM ordered)"""


@query(
    "pack_facts",
    f"""WITH RECURSIVE {_FACT_LIST}, {_FOLD} SELECT query_id, coalesce(context, '') AS context, coalesce(included, 0) AS included, {sql.token_count("coalesce(context, '')")} AS total_tokens FROM queries_ LEFT JOIN packed USING (query_id)""",
)
def pack_facts(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_facts(_fact_list(spark, d), 200)


_MEMORY_LIST = "l AS (SELECT conv_id AS query_id, turn + 1 AS rank, text AS content, ['semantic', 'episodic', 'procedural'][turn % 3 + 1] AS memory_type, round(0.9::DOUBLE - turn * 0.1::DOUBLE, 6) AS score FROM conversations)"
_SHUT = "(f.closed >= o.pass OR o.pass = 1 AND f.used >= 135)"
_CUT = r"CASE WHEN len(string_split_regex(o.content, '\s+')) <= floor((135 - f.used) / 1.3::DOUBLE) THEN o.content ELSE array_to_string(string_split_regex(o.content, '\s+')[1:floor((135 - f.used) / 1.3::DOUBLE)::INT], ' ') || '...' END"


@query(
    "pack_memories",
    f"""WITH RECURSIVE {_MEMORY_LIST}, costed AS (SELECT *, {sql.token_count('content')} AS cost, CASE WHEN score >= 0.4 THEN 0 WHEN score >= 0.2 THEN 1 END AS pass FROM l),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS k FROM costed WHERE pass IS NOT NULL),
    fold(query_id, k, used, closed, taken) AS (
        SELECT DISTINCT query_id, 0::BIGINT, 0, -1, NULL::VARCHAR FROM ordered
        UNION ALL
        SELECT f.query_id, f.k + 1,
            CASE WHEN {_SHUT} THEN f.used WHEN f.used + o.cost <= 135 THEN f.used + o.cost WHEN 135 - f.used > 20 THEN f.used + {sql.token_count(f'({_CUT})')} ELSE f.used END,
            CASE WHEN {_SHUT} THEN f.closed WHEN f.used + o.cost <= 135 THEN f.closed ELSE o.pass END,
            CASE WHEN {_SHUT} THEN NULL WHEN f.used + o.cost <= 135 THEN o.content WHEN 135 - f.used > 20 THEN {_CUT} END
        FROM fold f JOIN ordered o ON o.query_id = f.query_id AND o.k = f.k + 1),
    parts AS (SELECT query_id, memory_type, string_agg('- ' || taken, chr(10) ORDER BY k) AS body, count(*) AS n FROM fold JOIN ordered USING (query_id, k) WHERE taken IS NOT NULL GROUP BY query_id, memory_type),
    packed AS (SELECT query_id, sum(n)::BIGINT AS included, string_agg(CASE memory_type WHEN 'semantic' THEN '## ADDITIONAL CONTEXT' WHEN 'episodic' THEN '## HISTORY' ELSE '## PROCEDURES' END || chr(10) || body, chr(10) || chr(10)
        ORDER BY CASE memory_type WHEN 'semantic' THEN 0 WHEN 'episodic' THEN 1 ELSE 2 END) AS context FROM parts GROUP BY query_id)
    SELECT query_id, coalesce(context, '') AS context, coalesce(included, 0) AS included, {sql.token_count("coalesce(context, '')")} AS total_tokens FROM (SELECT DISTINCT query_id FROM ordered) LEFT JOIN packed USING (query_id)""",
)
def pack_memories(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("semantic", "episodic", "procedural"))), (F.col("rank") - 1) % 3 + 1)
    l = _fact_list(spark, d).withColumnRenamed("fact", "content").withColumn("memory_type", kinds)  # noqa: E741
    return packing.pack_memories(l, 150)


#: Rows leave a list in order of rank: what a row that still stands takes out (kills) is out for those after it.
_LEAVING = """turns(query_id, k, gone) AS (
        SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[] FROM l
        UNION ALL
        SELECT t.query_id, t.k + 1, CASE WHEN list_contains(t.gone, l.id) OR x.ids IS NULL THEN t.gone ELSE list_concat(t.gone, x.ids) END
        FROM turns t JOIN l ON l.query_id = t.query_id AND l.rank = t.k + 1 LEFT JOIN kills x ON x.query_id = l.query_id AND x.rank = l.rank),
    last AS (SELECT query_id, arg_max(gone, k) AS gone FROM turns GROUP BY query_id)
    SELECT query_id, id, rank FROM l JOIN last USING (query_id) WHERE NOT list_contains(gone, id)"""


@query(
    "jaccard_dedup",
    f"""WITH RECURSIVE l AS (SELECT * FROM (SELECT n_chars % 97 AS query_id, doc_id AS id, list_distinct({sql.split('lower(text)')}) AS w, row_number() OVER (PARTITION BY n_chars % 97 ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 50),
    p AS (SELECT a.query_id, a.rank, b.id, len(list_intersect(a.w, b.w)) AS common, len(a.w) AS x, len(b.w) AS y FROM l a JOIN l b ON a.query_id = b.query_id AND a.rank < b.rank),
    kills AS (SELECT query_id, rank, list(id) AS ids FROM p WHERE x + y > 0 AND common >= 0.7::DOUBLE * (x + y - common) GROUP BY query_id, rank),
    {_LEAVING}""",
)
def jaccard_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lists of documents by source and length, in which copies and near copies meet."""
    t = views.table(spark, d, "documents")
    l = t.select((F.col("n_chars") % 97).alias("query_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.lit(1.0) / (F.col("doc_id") + 1)).alias("score"))  # noqa: E741
    from ..operators.retrieval import top

    return arbitration.drop_similar(top(l, 50, F.desc("score")), "content").select("query_id", "id", "rank")


@query(
    "jaccard_dedup_whole",
    f"""SELECT id FROM (WITH RECURSIVE l AS MATERIALIZED (SELECT 0 AS query_id, doc_id AS id, list_distinct({sql.split('lower(text)')}) AS w, row_number() OVER (ORDER BY doc_id) AS rank FROM documents),
    p AS (SELECT a.query_id, a.rank, b.id, len(list_intersect(a.w, b.w)) AS common, len(a.w) AS x, len(b.w) AS y FROM l a JOIN l b ON a.rank < b.rank),
    kills AS MATERIALIZED (SELECT query_id, rank, list(id) AS ids FROM p WHERE x + y > 0 AND common >= 0.7::DOUBLE * (x + y - common) GROUP BY query_id, rank),
    {_LEAVING})""",
)
def jaccard_dedup_whole(spark: SparkSession, d: str) -> DataFrame:
    """All documents beside each other: no lists, no limit on ranks."""
    return arbitration.drop_similar_anywhere(views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


@query(
    "supersession_filter",
    f"""WITH RECURSIVE f AS (SELECT conv_id AS query_id, conv_id * 100 + turn AS id, turn + 1 AS rank, CASE WHEN turn % 3 = 2 THEN 'No longer so. ' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'Deploys alpha services through gamma tools. ' ELSE '' END || left(text, 30) AS said FROM conversations),
    l AS (SELECT query_id, id, rank, {sql.keywords('said')} AS w, {sql.any_match('said', fixed.SUPERSESSION)} AS changes FROM f),
    kills AS (SELECT a.query_id, a.rank, list(b.id) AS ids FROM l a JOIN l b ON a.query_id = b.query_id AND b.rank < a.rank
        WHERE a.changes AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.4::DOUBLE * least(len(a.w), len(b.w)) GROUP BY a.query_id, a.rank),
    {_LEAVING}""",
)
def supersession_filter(spark: SparkSession, d: str) -> DataFrame:
    c = views.facts(spark, d).select(F.col("memory_id").alias("query_id"), "id", F.col("fact").alias("content"), "created_at", "turn")
    change = F.when(F.col("turn") % 3 == 2, F.lit("No longer so. ")).otherwise(F.lit(""))
    subject = F.when(F.col("turn") % 2 == 0, F.lit("Deploys alpha services through gamma tools. ")).otherwise(F.lit(""))
    said = F.concat(change, subject, F.left("content", F.lit(30)))
    c = c.withColumns({"content": said, "rank": (F.col("turn") + 1).cast("int")}).drop("turn")
    return arbitration.drop_superseded(c).select("query_id", "id", "rank")


@query(
    "supersession_filter_whole",
    ORACLES["supersession_filter"].replace("CASE WHEN turn % 3 = 2 THEN 'No longer so. ' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'Deploys alpha services through gamma tools. ' ELSE '' END || left(text, 30) AS said", "text AS said"),
)
def supersession_filter_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns, with nothing put before them."""
    c = views.facts(spark, d).select(F.col("memory_id").alias("query_id"), "id", F.col("fact").alias("content"), "created_at", (F.col("turn") + 1).cast("int").alias("rank"))
    return arbitration.drop_superseded(c).select("query_id", "id", "rank")


@query(
    "merge_context_lines",
    r"""WITH l AS (SELECT conv_id AS query_id, turn AS position, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_ FROM conversations),
    f AS (SELECT query_id, line, min(struct_pack(p := position, a := at_)) AS by_ FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '##') GROUP BY query_id, line)
    SELECT query_id, string_agg(line, chr(10) ORDER BY by_) AS context FROM f GROUP BY query_id""",
)
def merge_context_lines(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("text").alias("context"))
    return packing.merge_lines(c)


_RANKED = f"""pairs AS (SELECT query_id, e.vec_id AS id, {sql.cosine('e.embedding::DOUBLE[]', 'query_embedding')} AS similarity FROM queries, embeddings e),
k AS (SELECT * FROM (SELECT *, {_KNN} FROM pairs WHERE id <> query_id) WHERE rank <= 10),
judged AS (SELECT k.*, a.label = b.label AS relevant FROM k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.id),
totals AS (SELECT a.vec_id AS query_id, count(*) FILTER (WHERE b.vec_id IS NOT NULL) AS n_relevant FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id < 20 GROUP BY a.vec_id)"""


@query(
    "precision_recall_mrr",
    f"""WITH {_Q}, {_RANKED}, g AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5 AND relevant) AS hits, min(rank) FILTER (WHERE relevant) AS first FROM judged GROUP BY query_id)
    SELECT query_id, round(coalesce(hits, 0) / 5.0::DOUBLE, 6) AS precision_at_k, round(coalesce(hits / nullif(n_relevant, 0)::DOUBLE, 0), 6) AS recall_at_k, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, coalesce(first <= 3, false) AS in_top3
    FROM totals LEFT JOIN g USING (query_id)""",
)
def precision_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = knn_batch_topk(spark, d).select("query_id", "id", "rank")
    mine = e.select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    judged = near.join(e, "id").join(mine, "query_id").withColumn("relevant", F.col("label") == F.col("want"))
    totals = mine.where(views.asked("query_id", 20)).join(e.groupBy("label").agg(F.count("*").alias("n")), F.col("want") == F.col("label")).select("query_id", (F.col("n") - 1).alias("n_relevant"))
    return metrics.retrieval(judged, totals, 5)


_TERMS = "['the', 'zzz', left(text, 8)]"


@query(
    "noise_rejection",
    f"WITH t AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS whole FROM conversations GROUP BY conv_id), b AS (SELECT item_id, {_TERMS} AS terms FROM benchmark) SELECT conv_id, item_id, round(1 - len(list_filter(terms, lambda x: contains(whole, lower(x)))) / 3.0::DOUBLE, 6) AS noise FROM t JOIN b ON item_id = conv_id",
)
def noise_rejection(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("results"))
    b = views.table(spark, d, "benchmark").select("item_id", F.array(F.lit("the"), F.lit("zzz"), F.left("text", F.lit(8))).alias("terms"))
    return c.join(b, F.col("conv_id") == F.col("item_id")).select("conv_id", "item_id", F.round(metrics.noise_rejection(F.col("results"), F.col("terms")), 6).alias("noise"))


@query(
    "token_efficiency",
    f"WITH t AS (SELECT conv_id, turn, floor(len({sql.split('text')}) * 1.3::DOUBLE)::INT AS tokens FROM conversations) SELECT conv_id, round(coalesce(sum(tokens) FILTER (WHERE turn % 2 = 0) / nullif(sum(tokens), 0)::DOUBLE, 0), 6) AS efficiency FROM t GROUP BY conv_id",
)
def token_efficiency(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "conversations").select("conv_id", "turn", metrics.relevant_tokens(F.col("text")).alias("tokens"))
    g = t.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("turn") % 2 == 0, F.col("tokens"))), F.lit(0)).alias("a"), F.sum("tokens").alias("b"))
    return g.select("conv_id", F.round(metrics.token_efficiency(F.col("a"), F.col("b")), 6).alias("efficiency"))


_BARE = r"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query(
    "token_f1",
    f"""WITH s AS (SELECT a.conv_id * 100 + a.turn AS id, {_BARE.format(x='a.text')} AS p, {_BARE.format(x='b.text')} AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    p AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(p) AS w FROM s) GROUP BY ALL), t AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(t) AS w FROM s) GROUP BY ALL),
    c AS (SELECT id, sum(least(p.n, t.n)) AS common FROM p JOIN t USING (id, w) GROUP BY id)
    SELECT id, round(coalesce(2.0::DOUBLE * common / (len(p) + len(t)), 0), 6) AS f1 FROM s LEFT JOIN c USING (id)""",
)
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return metrics.token_f1(c.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("prediction"), "truth"))


@query(
    "answer_check",
    """WITH a AS (SELECT conv_id, turn, lower(text) AS low, [left(text, 5), 'qqq'] AS expected, ['and the', 'zzz'] AS absent FROM conversations),
    m AS (SELECT *, list_filter(expected, lambda x: NOT contains(low, lower(x))) AS missing, list_filter(absent, lambda x: contains(low, x)) AS wrong FROM a)
    SELECT conv_id, turn, round((2 - len(missing)) / 2.0::DOUBLE, 6) AS accuracy, len(missing) AS missing, len(wrong) AS violations, len(missing) = 0 AND len(wrong) = 0 AS correct FROM m""",
)
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    check = metrics.answer_check(F.col("text"), F.array(F.left("text", F.lit(5)), F.lit("qqq")), F.array(F.lit("and the"), F.lit("zzz")))
    return c.select("conv_id", "turn", check.alias("c")).select("conv_id", "turn", "c.accuracy", F.size("c.missing").alias("missing"), F.size("c.violations").alias("violations"), "c.correct")


@query(
    "string_match",
    "SELECT c.conv_id, turn, item_id, contains(lower(c.text), lower(left(b.text, 6))) AS found FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40",
)
def string_match(spark: SparkSession, d: str) -> DataFrame:
    b = views.table(spark, d, "benchmark").select("item_id", F.col("text").alias("want"))
    c = views.table(spark, d, "conversations").join(b, F.col("item_id") == F.col("conv_id") % 40)
    return c.select("conv_id", "turn", "item_id", metrics.found(F.left("want", F.lit(6)), F.array("text")).alias("found"))


@query(
    "latency_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(max(value) FILTER (WHERE r = least(floor(n * 0.95::DOUBLE), n - 1) + 1), 6) AS p95, round(max(value), 6) AS largest FROM r GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency(views.table(spark, d, "events"), "event_type", "value")


@query("category_scores", "SELECT event_type, count(*) AS n, round(avg((value > 10)::INT) * 100, 6) AS correct, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def category_scores(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    s = metrics.spread(e, ["event_type"], "value").select("event_type", "mean", "spread")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 10).cast("int")) * 100, 6).alias("correct")).join(s, "event_type")


@query("cost_per_thousand", "SELECT user_id, round(coalesce(count(*) FILTER (WHERE event_type = 'purchase') * 0.0005::DOUBLE / nullif(count(*), 0) * 1000, 0), 6) AS cost FROM events GROUP BY user_id")
def cost_per_thousand(spark: SparkSession, d: str) -> DataFrame:
    g = views.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("calls"), F.count("*").alias("operations"))
    return g.select("user_id", F.round(metrics.cost_per_thousand(F.col("calls"), F.col("operations")), 6).alias("cost"))


