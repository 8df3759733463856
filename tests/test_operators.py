"""Small cases for scopes, ranking, packing, graph, state, streams and sources."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tarnlake.functions import fixed, scope, vector
from tarnlake.operators import arbitration, graph, lifecycle, metrics, packing, ranking, retrieval, state
from tarnlake.plans import verbs
from tarnlake.sources import io
from tarnlake.streaming import ingest

T = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.s for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, None, None, None]


def test_knn(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, query_embedding array<float>")
    assert [(r.id, r.similarity, r["rank"]) for r in retrieval.knn(q, rows, 2).orderBy("rank").collect()] == [(1, 1.0, 1), (3, 1.0, 2)]
    assert [r.id for r in retrieval.knn(q, rows, 9, least=0.5, other=True).collect()] == [3]
    assert retrieval.knn(q.limit(0), rows, 2).count() == 0
    assert retrieval.knn(q, rows.limit(0), 2).count() == 0


def test_scope(spark):
    s = "id long, agent_id long, user_id long, task_id long, shared boolean, expires_at timestamp_ntz, invalid_at timestamp_ntz"
    past = T
    df = spark.createDataFrame([(1, 1, 1, None, False, None, None), (2, 2, 1, None, True, None, None), (3, 2, 2, 7, True, None, None), (4, 1, 1, None, False, past, None), (5, 1, 1, None, False, None, past)], s)

    def ids(**k):
        return sorted(r.id for r in df.where(scope.visible(now(), **k)).collect())

    assert ids(agent=1, user=1) == [1]
    assert ids(agent=1, user=1, shared=True) == [1, 2]
    assert ids(user=1) == [1, 2]
    assert ids(agent=1, task=7) == [1, 3]
    assert ids(agent=1, shared=True) == [1, 2, 3]
    assert ids() == [1, 2, 3]


def test_rank_floor(spark):
    s = "query_id long, id long, similarity double, created_at timestamp_ntz, importance double, access_count long"
    df = spark.createDataFrame([(1, 1, 0.2, T, 0.5, 0), (1, 2, 0.8, T, 0.5, 0), (1, 3, 0.1, T, 0.5, 0)], s)
    assert [r.id for r in ranking.rank_memories(df, now()).collect()] == [2]
    assert ranking.rank_memories(df.limit(0), now()).count() == 0


def test_fuse(spark):
    s = "query_id long, id long, rank int"
    out = retrieval.fuse(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], s), spark.createDataFrame([(1, 2, 1), (1, 3, 2)], s)).orderBy("rank").collect()
    assert [r.id for r in out] == [2, 1, 3]
    assert out[0].similarity == 1.0 and out[0].sources == "vector+keyword"
    assert out[1].similarity < fixed.MIN_SIMILARITY


def test_pack(spark):
    s = "query_id long, id long, rank int, score double, fact string"
    rows = [(1, 1, 1, 0.9, "a b c"), (1, 2, 2, 0.8, "w " * 50), (1, 3, 3, 0.7, "d"), (1, 4, 4, 0.3, "e"), (1, 5, 5, 0.1, "f")]
    out = packing.pack_facts(spark.createDataFrame(rows, s), 40).first()
    assert out.context == "## FACTS\n- a b c\n- e" and out.included == 2
    m = spark.createDataFrame([(*r, "semantic") for r in rows], s + ", memory_type string").withColumnRenamed("fact", "content")
    out = packing.pack_memories(m, 60).first()
    assert out.included == 2 and out.context.endswith("w...")


def test_drop_similar(spark):
    s = "query_id long, id long, rank int, score double, content string"
    df = spark.createDataFrame([(1, 1, 1, 0.5, "a b c d"), (1, 2, 2, 0.9, "A b c d"), (1, 3, 3, 0.1, "x y"), (1, 4, 4, 0.1, "")], s)
    assert sorted(r.id for r in arbitration.drop_similar(df, "content").collect()) == [2, 3, 4]


def test_drop_superseded(spark):
    s = "query_id long, id long, rank int, created_at timestamp_ntz, content string"
    later = T + dt.timedelta(days=1)
    df = spark.createDataFrame([(1, 1, 1, T, "deploys services with jenkins pipelines"), (1, 2, 2, later, "switched to actions, services deploys no longer with jenkins"), (1, 3, 3, T, "eats soup")], s)
    assert sorted(r.id for r in arbitration.drop_superseded(df).collect()) == [2, 3]


def test_traverse(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = sorted((r.node, r.hops) for r in graph.traverse(spark.createDataFrame([(1,)], "node long"), e).collect())
    assert got == [(2, 1), (3, 2)]


def test_state(spark):
    log = spark.createDataFrame([(1, 1, "put", "a"), (1, 2, "put", "b"), (2, 3, "put", "c"), (2, 4, "delete", None)], "id long, seq long, op string, v string")
    assert [(r.id, r.v) for r in state.latest(log).collect()] == [(1, "b")]
    assert state.latest(log.limit(0)).count() == 0


def test_decay(spark):
    s = "id long, importance double, created_at timestamp_ntz, last_accessed timestamp_ntz, expires_at timestamp_ntz"
    df = spark.createDataFrame([(1, 0.8, T, None, None), (2, 0.8, T, T + dt.timedelta(days=10), None), (3, 0.051, T, None, None)], s)
    out = {r.id: r for r in lifecycle.run_decay(df, now()).collect()}
    assert abs(out[1].importance - 0.8 * 0.95**10) < 1e-6 and out[2].importance == 0.8
    assert out[3].importance == 0.05 and out[3].archived


def test_greedy_groups(spark):
    df = spark.createDataFrame([(1, 10, 1, ["x", "y"]), (1, 11, 2, ["x"]), (1, 12, 3, ["y", "z"]), (1, 13, 4, ["z"])], "user_id long, id long, ord int, themes array<string>")
    assert [(r.theme, r.ids) for r in lifecycle.greedy_groups(df).orderBy("position").collect()] == [("x", [10, 11]), ("z", [12, 13])]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "The cat sat", "a cat sat down")], "id long, prediction string, truth string")
    assert abs(metrics.token_f1(df).first().f1 - 0.8) < 1e-6
    lat = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "k string, v double")
    r = metrics.latency(lat, "k", "v").first()
    assert (r.p50, r.p95, r.n) == (10.5, 20.0, 20)


def test_remember_in_order(spark):
    s = "user_id long, id long, seq long, content string, embedding array<double>"
    rows = [(1, 1, 1, "likes tea", [1.0, 0.0]), (1, 2, 2, "likes tea", [1.0, 0.0]), (1, 3, 3, "hates tea", [0.9, 0.435]), (2, 4, 1, "likes tea", [1.0, 0.0]), (None, 5, 1, "x", [1.0, 0.0])]
    out = {r.id: (r.action, r.target, list(r.conflicts)) for r in verbs.remember_in_order(spark.createDataFrame(rows, s), 0.95, 0.8).collect()}
    assert out == {1: ("new", None, []), 2: ("duplicate", 1, []), 3: ("contradiction", None, [1]), 4: ("new", None, []), 5: ("new", None, [])}


def test_flatten_sessions(spark):
    doc = {"session_10": [{"speaker": "A", "text": "late"}], "session_2": [{"speaker": "B", "text": "early"}], "session_2_date_time": "May 1", "speaker_a": "A"}
    got = io.flatten_sessions(spark.createDataFrame([(1, json.dumps(doc))], "id long, conversation string")).orderBy("session", "turn").collect()
    assert [(r.session, r.text) for r in got] == [(2, "[May 1] B: early"), (10, "[] A: late")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    io.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().v == "a"
    assert "| 1 | a |" in io.markdown(df, "t")


def test_stream(spark, tmp_path):
    s = "id long, user_id long, ts timestamp, content string"
    rows = [(1, 1, T, "likes green tea a lot"), (2, 1, T, "likes green tea a lot"), (3, 2, T, "likes green tea a lot")]
    spark.createDataFrame(rows, s).write.parquet(str(tmp_path / "in"))
    stream = ingest.read(spark, str(tmp_path / "in"), s)
    ingest.append(ingest.observe(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.memory_type for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"semantic"}
    words = ingest.with_watermark(stream).withColumn("words", F.split("content", " "))
    q = ingest.dedup_by_user(words, 0.7).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    assert sorted((r.id, r.duplicate_of) for r in spark.table("dedup").collect()) == [(1, None), (2, 1), (3, None)]
    q = ingest.expiring(stream.select("id", "ts")).writeStream.format("memory").queryName("ttl").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ttl").count() == 3


def test_sliding_stream(spark, tmp_path):
    rows = [(i, T + dt.timedelta(hours=i), "a", 1.0) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = ingest.read(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double")
    q = ingest.sliding(ingest.with_watermark(stream)).writeStream.format("memory").queryName("slide").trigger(availableNow=True).outputMode("complete").start()
    q.awaitTermination()
    got = {r.start_hour: r.n for r in spark.table("slide").collect()}
    assert got[0] == 24 and got[-12] == 12


def test_embedder(spark):
    from tarnlake.functions import models

    class Lengths:
        name, dimension = "lengths", 2

        def embed(self, texts):
            return [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, content string")
    assert {r.id: r.embedding for r in models.apply_embedder(df, Lengths).collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    v = {r.id: r.v for r in df.select("id", models.hashed_embedding(F.coalesce("content", F.lit("")), 8).alias("v")).collect()}
    assert v[3] is None and abs(sum(x * x for x in v[1]) - 1) < 1e-9


def test_schedule(spark):
    import time

    from tarnlake.streaming import schedule

    ran = []
    q = schedule.every(spark, 0.01, lambda s, n: ran.append(n))
    for _ in range(100):
        if ran:
            break
        time.sleep(0.2)
    q.stop()
    assert ran
