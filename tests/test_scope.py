"""Searches and recalls see only what the one who asks may see."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import scope
from tarnlake.operators import retrieval
from tarnlake.plans import verbs

NOW = "2024-02-01 00:00:00"
_ROW = "agent_id long, user_id long, task_id long, shared boolean"
_QUERY = "query_agent long, query_user long, query_task long, query_shared boolean"


def plainly(agent, user, task, shared, row) -> bool:
    if agent is None and user is None and task is None and not shared:
        return True
    own = (row[0] == agent or agent is None) and (row[1] == user or user is None) and not (agent is None and user is None)
    lent = row[3] and (shared and user is not None and row[1] == user or task is not None and row[2] == task or shared and user is None and task is None)
    return bool(own or lent)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *r) for i, r in enumerate(itertools.product((1, 2, None), (1, 2), (7, 8, None), (True, False)))]
    asked = [(i, *q) for i, q in enumerate(itertools.product((None, 1, 2), (None, 1, 3), (None, 7), (None, True, False)))]
    return rows, asked


def test_scopes(spark, table):
    rows, asked = table
    want = {(q[0], r[0]) for q in asked for r in rows if plainly(*q[1:4], bool(q[4]), r[1:])}
    v = [1.0, 0.0]
    given = spark.createDataFrame([(*q, v, "apple") for q in asked], f"query_id long, {_QUERY}, query_embedding array<double>, query string")
    held = spark.createDataFrame([(*r, v, "apple pie") for r in rows], f"id long, {_ROW}, embedding array<double>, content string").repartition(3)
    assert {(r.query_id, r.id) for r in retrieval.knn(given, held, 100).collect()} == want
    assert {(r.query_id, r.id) for r in retrieval.keyword_search(given, held, 100).collect()} == want
    assert {r.query_id for r in retrieval.seeing(given, held).collect()} == {q for q, _ in want}
    assert retrieval.seeing(given, held.limit(0)).count() == 0
    open_ = given.drop(*scope.QUERY)
    assert retrieval.knn(open_, held, 100).count() == len(asked) * len(rows) and retrieval.seeing(open_, held).count() == len(asked)


def test_knn_keeps_the_best(spark):
    rng = np.random.default_rng(2)
    vectors, asked = rng.normal(size=(500, 8)).round(1), rng.normal(size=(40, 8)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.repeat(vectors[:250], 2, axis=0))], "id long, embedding array<double>").repartition(3)
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, query_embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.knn(given, rows, 7).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(asked) @ unit(np.repeat(vectors[:250], 2, axis=0)).T, 6)
    for q in range(40):
        assert [got[q, k + 1] for k in range(7)] == np.lexsort((np.arange(500), -sims[q]))[:7].tolist()


def test_recall_of_two_users(spark):
    """The same question of two users, and one who has no facts: no foreign row in any answer."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=8)
    names = {1: "Alice", 2: "Bob"}
    memories, facts = [], []
    for i in range(40):
        user, shared = 1 + i % 2, i % 10 < 2
        e = (v + rng.normal(size=8) / 5).tolist()
        memories.append((i, 1, user, None, shared, f"secret{i} of user{user} about apples with Alice", "semantic", e, 0.5, 0, "2024-01-20 00:00:00"))
        if user == 1:
            facts.append((100 + i, 1, user, None, shared, f"fact{i} of user{user} Alice likes apples", e, 0.5, "2024-01-20 00:00:00"))
    m = spark.createDataFrame(memories, f"id long, {_ROW}, content string, memory_type string, embedding array<double>, importance double, access_count long, created string").withColumn("created_at", F.col("created").cast("timestamp_ntz")).drop("created")
    f = spark.createDataFrame(facts, f"id long, {_ROW}, fact string, embedding array<double>, importance double, created string").withColumn("created_at", F.col("created").cast("timestamp_ntz")).drop("created")
    q = spark.createDataFrame([(u, "What does Alice say about apples?", v.tolist(), 1, u, None, True) for u in names], f"query_id long, query string, query_embedding array<double>, {_QUERY}")
    mm, fm = (df.select("id", F.lit("alice").alias("entity")) for df in (m, f))
    out = {r.query_id: r for r in verbs.recall(q, m, f, mm, fm, F.lit(NOW).cast("timestamp_ntz")).collect()}
    for user, other in ((1, 2), (2, 1)):
        said = json.dumps(out[user].context)
        assert f"of user{user}" in said and f"of user{other}" not in said
    assert "fact" in out[1].context and "fact" not in out[2].context
    # user 2 may see no fact: the whole budget is for memories
    assert out[2].included > 0
    touched = {r.id for r in verbs.recall_touches(q.where("query_id = 1"), m, F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert touched and all(i % 2 == 0 for i in touched)
