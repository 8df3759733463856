"""State as an append-only log: current rows are the last versions without tombstones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """The last row of each key, unless that deletes it. max_by aggregates before the shuffle, so a key
    with very many versions costs one row a task."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return last.where(F.col(op) != "delete") if op in log.columns else last


def insert_defaults(df: DataFrame, now: Column) -> DataFrame:
    """New memories with what is missing filled in."""
    given = set(df.columns)

    def col(name: str, value: Column) -> Column:
        return (F.coalesce(F.col(name), value) if name in given else value).alias(name)

    null_time = F.lit(None).cast("timestamp_ntz")
    return df.select(
        "id", *(F.col(c) if c in given else F.lit(None).cast("long").alias(c) for c in ("agent_id", "user_id", "task_id")), "content",
        col("memory_type", F.lit("semantic")), col("confidence", F.lit(1.0)), col("importance", F.lit(0.5)), col("source", F.lit("agent_observation")),
        col("shared", F.lit(False)), col("metadata", F.lit("{}")), col("created_at", now), col("valid_at", now), col("invalid_at", null_time), col("expires_at", null_time),
        F.lit(0).alias("access_count"), null_time.alias("last_accessed"),
    )


def touch(hits: DataFrame, now: Column, confidence: Column | None = None) -> DataFrame:
    """Log rows for rows that were read: one more access for each time, at the moment."""
    return hits.groupBy("id").agg(F.count("*").alias("accesses")).select("id", F.lit("touch").alias("op"), "accesses", now.alias("at"), (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"))


def apply_touches(rows: DataFrame, touches: DataFrame) -> DataFrame:
    """Access counts and times with a log's rows added in."""
    t = touches.groupBy("id").agg(F.sum("accesses").alias("_n"), F.max("at").alias("_at"), F.max("confidence").alias("_c"))
    out = rows.join(t, "id", "left")
    new = {"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.coalesce(F.greatest("last_accessed", "_at"), "last_accessed", "_at")}
    if "confidence" in rows.columns:
        new["confidence"] = F.coalesce("_c", "confidence")
    return out.withColumns(new).drop("_n", "_at", "_c")


def _closing(rows: DataFrame, ids: DataFrame, column: str, now: Column) -> DataFrame:
    """Set an end on the rows of ids that have none."""
    due = ids.select("id").distinct().withColumn("_due", F.lit(True))
    return rows.join(due, "id", "left").withColumn(column, F.when(F.col("_due") & F.col(column).isNull(), now).otherwise(F.col(column))).drop("_due")


def invalidate(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _closing(rows, ids, "invalid_at", now)


def supersede(facts: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """pairs: old, new. Active old facts end now and name their successor (the smallest where several do)."""
    by = pairs.groupBy(F.col("old").alias("id")).agg(F.min("new").alias("_by"))
    due = F.col("_by").isNotNull() & F.col("active_until").isNull()
    own = F.col("superseded_by") if "superseded_by" in facts.columns else F.lit(None).cast("long")
    return facts.join(by, "id", "left").withColumns({"superseded_by": F.when(due, F.col("_by")).otherwise(own), "active_until": F.when(due, now).otherwise(F.col("active_until"))}).drop("_by")


def replace_content(rows: DataFrame, news: DataFrame, now: Column) -> DataFrame:
    """news: id, content, embedding. Those rows take text and vector; updated_at says when."""
    n = news.select("id", F.col("content").alias("_content"), F.col("embedding").alias("_embedding"))
    hit = F.col("_content").isNotNull()
    old = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    return rows.join(n, "id", "left").withColumns({"content": F.coalesce("_content", "content"), "embedding": F.coalesce("_embedding", "embedding"), "updated_at": F.when(hit, now).otherwise(old)}).drop("_content", "_embedding")


def resolve(conflicts: DataFrame, ids: DataFrame, resolution: str, now: Column) -> DataFrame:
    due = ids.select("id").distinct().withColumn("_due", F.lit(True))
    out = conflicts.join(due, "id", "left")
    return out.withColumns({"resolution": F.when(F.col("_due"), F.lit(resolution)).otherwise(F.col("resolution")), "resolved_at": F.when(F.col("_due"), now).otherwise(F.col("resolved_at"))}).drop("_due")


def pending_conflicts(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Open conflicts in which one of ids has a part, newest first."""
    wanted = ids.select("id").distinct()
    a = conflicts.where("resolution = 'pending'").join(wanted.withColumnRenamed("id", "memory_a"), "memory_a", "left_semi")
    b = conflicts.where("resolution = 'pending'").join(wanted.withColumnRenamed("id", "memory_b"), "memory_b", "left_semi")
    return a.unionByName(b).dropDuplicates(["id"]).orderBy(F.desc_nulls_first("created_at"), "id")


def forget(ids: DataFrame, memories: DataFrame, facts: DataFrame, conflicts: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """What is left without the memories of ids, and a report (id, found, edges_removed, facts_removed).

    Facts and conflicts go with their memory, a successor that goes is forgotten by those that name it, and
    edges of memories and facts go. mentions: kind ('memory' or 'fact'), id, entity_id.
    """
    gone = ids.select("id").distinct()
    known = memories.select("id").join(gone, "id", "left_semi")
    facts_gone = facts.join(known.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi").select("id", "memory_id")
    of_memory = mentions.where("kind = 'memory'").join(known, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    of_fact = mentions.where("kind = 'fact'").join(facts_gone, "id").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("m"))
    n_facts = facts_gone.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("facts_removed"))
    zero = F.lit(0).cast("long")
    report = gone.join(known.withColumn("found", F.lit(True)), "id", "left").join(of_memory, "id", "left").join(of_fact, "id", "left").join(n_facts, "id", "left")
    report = report.select("id", F.coalesce("found", F.lit(False)).alias("found"), (F.coalesce("n", zero) + F.coalesce("m", zero)).alias("edges_removed"), F.coalesce("facts_removed", zero).alias("facts_removed"))
    left_facts = facts.join(known.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")
    if "superseded_by" in facts.columns:
        lost = facts_gone.select(F.col("id").alias("superseded_by")).withColumn("_lost", F.lit(True))
        left_facts = left_facts.join(lost, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("_lost").isNull(), F.col("superseded_by"))).drop("_lost")
    left_conflicts = conflicts.join(known.withColumnRenamed("id", "memory_a"), "memory_a", "left_anti").join(known.withColumnRenamed("id", "memory_b"), "memory_b", "left_anti")
    nodes = known.withColumn("kind", F.lit("memory")).union(facts_gone.select("id", F.lit("fact").alias("kind")))
    return {
        "memories": memories.join(known, "id", "left_anti"), "facts": left_facts, "conflicts": left_conflicts,
        "mentions": mentions.join(nodes, ["kind", "id"], "left_anti"), "report": report,
    }


def check(df: DataFrame, ranges: dict[str, tuple[float, float]], domains: dict[str, list[str]], unique: list[str] | None = None) -> DataFrame:
    """df with `errors`: the names of columns out of range, out of their domain, or of a key that repeats.

    Keys that repeat are found by an aggregate and joined back, so a key with very many rows is no large group.
    """
    bad = [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in ranges.items()]
    bad += [F.when(~F.col(c).isin(values), F.lit(c)) for c, values in domains.items()]
    if unique:
        again = df.groupBy(*(F.col(c).alias(f"_{c}") for c in unique)).agg(F.count("*").alias("_rows")).where("_rows > 1")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unique))
        bad.append(F.when(F.col("_rows").isNotNull(), F.lit("+".join(unique))))
        df = df.join(again, same, "left")
    out = df.withColumn("errors", F.filter(F.array(*bad), lambda e: e.isNotNull()))
    return out.drop("_rows", *(f"_{c}" for c in unique)) if unique else out


def merged_metadata(*parts: Column) -> Column:
    """Maps of text put together; of a key that several have, the last one's value counts."""
    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    empty = F.create_map().cast("map<string,string>")
    return reduce(over, (F.coalesce(p, empty) for p in parts))
