"""Golden cases for text features."""

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.operators import arbitration, extraction


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "kind", "sure"),
    [
        ("User prefers window seats", "semantic", 0.7), ("Booked a flight yesterday", "episodic", 0.8), ("First, check the logs, then run the build", "procedural", 0.8),
        ("zebra", "semantic", 0.5), ("", "semantic", 0.5), ("She always visited", "semantic", 0.4),
    ],
)
def test_memory_type(spark, said, kind, sure):
    k = one(spark, said, text.memory_type)
    assert (k.memory_type, round(k.confidence, 6)) == (kind, sure)


@pytest.mark.parametrize(("t", "n"), [("", 0), ("a b c d e f g", 10), ("a b c d e", 7), ("  a  ", 2)])
def test_token_count(spark, t, n):
    assert one(spark, t, text.token_count) == n


def test_truncate(spark):
    assert one(spark, "a b c d e f", lambda c: text.truncate_tokens(c, 4)) == "a b c..."
    assert one(spark, "a b", lambda c: text.truncate_tokens(c, 4)) == "a b"


@pytest.mark.parametrize(("q", "route"), [("What books has Ann read?", "AGGREGATION"), ("Name all pets", "AGGREGATION"), ("When did Ann move?", "DIRECT"), ("", "DIRECT")])
def test_route(spark, q, route):
    assert one(spark, q, text.route) == route


def test_query_entities(spark):
    assert one(spark, "What does Melanie do with Bob and MELANIE or melanie? Bob!", text.query_entities) == ["Melanie", "Bob"]


def test_dated(spark):
    assert str(one(spark, "moved on 31 April 2023.", text.dated)) == "2023-05-01"
    assert one(spark, "no date", text.dated) is None


def test_entities(spark):
    found = one(spark, "My name is Alice Smith. She works at Acme and lives in Paris, likes TypeScript. About cooking.", extraction.entities)
    got = {(e.name, e.type) for e in found}
    assert {("Alice Smith", "person"), ("Paris", "location"), ("Acme", "organization"), ("TypeScript", "technology")} <= got
    assert one(spark, "", extraction.entities) == []


@pytest.mark.parametrize(
    ("old", "new", "verdict"),
    [
        ("She likes tea", "She hates tea", "contradiction"), ("It is not red", "It is not red", "contradiction"),
        ("works with python daily", "works with python daily at the office in Berlin", "elaboration"),
        ("works with python daily at the office in Berlin", "works with python daily", "update"),
        ("plays chess", "switched to checkers, currently plays that", "update"), ("plays chess", "eats soup", "new"),
    ],
)
def test_arbitrate(spark, old, new, verdict):
    df = spark.createDataFrame([(old, new)], "a string, b string")
    assert df.select(arbitration.arbitrate(F.col("a"), F.col("b")).alias("v")).first().v == verdict


@pytest.mark.parametrize(("s", "said", "action"), [(0.95, True, "skip"), (0.92, True, "supersede"), (0.92, False, "store"), (0.5, True, "store"), (0.7, True, "supersede")])
def test_fact_tier(spark, s, said, action):
    df = spark.createDataFrame([(s, said)], "s double, b boolean")
    assert df.select(arbitration.fact_tier(F.col("s"), F.col("b")).alias("v")).first().v == action


def test_distribute(spark):
    cards = spark.createDataFrame([(1, ["Ann likes tea", "Bob has a dog"], ["who has a dog", "what does Ann drink", "does Ann like tea"]), (2, [], ["x"]), (3, ["alone"], [])], "id long, facts array<string>, signatures array<string>")
    got = {(r.id, r.fact): r.hints for r in extraction.distribute(cards).collect()}
    assert got == {(1, "Ann likes tea"): ["does Ann like tea", "what does Ann drink"], (1, "Bob has a dog"): ["who has a dog"], (3, "alone"): []}
