"""Entities and relations in texts, by patterns and a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

_PATTERNS = {"person": fixed.PERSON, "location": fixed.LOCATION, "organization": fixed.ORGANIZATION, "preference": fixed.PREFERENCE, "topic": fixed.TOPIC}
_CLOSING = r"[.!?,;:'\"]+\z"
_ENTITY = "array<struct<name:string,type:string,confidence:double>>"


def _entity(name: Column, kind: str, confidence: float) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def _by_patterns(c: Column, kind: str) -> Column:
    """Names of one type, in order of pattern and place, trimmed, without those of stop words alone, each once."""
    found = F.concat(*(text.all_groups(c, p) for p in _PATTERNS[kind]))
    clean = F.transform(found, lambda n: F.trim(F.regexp_replace(F.trim(n), _CLOSING, "")))
    clean = F.filter(clean, lambda n: (F.length(n) >= 2) & F.exists(F.split(F.lower(n), r"\s+"), lambda w: ~w.isin(fixed.ENTITY_STOPWORDS)))
    return F.transform(text.first_by_case(clean), lambda n: _entity(n, kind, fixed.TYPE_CONFIDENCE[kind]))


def _by_vocabulary(c: Column) -> Column:
    """Known terms that stand anywhere in the text, in the vocabulary's order; case counts."""
    terms = F.array(*(F.when(F.contains(c, F.lit(t)), _entity(F.lit(t), kind, sure)) for t, kind, sure in fixed.VOCABULARY))
    return F.filter(terms, lambda e: e.isNotNull())


def entities(c: Column) -> Column:
    """array of struct(name, type, confidence): one for each name whatever its case, of its highest type,
    in the order in which the names first came."""
    each = F.concat(*(_by_patterns(c, k) for k in _PATTERNS), _by_vocabulary(c))
    ranks = F.create_map(*(F.lit(x) for kv in fixed.TYPE_RANK.items() for x in kv))
    keyed = F.transform(each, lambda e: F.struct(F.lower(e["name"]).alias("low"), F.try_element_at(ranks, e["type"]).alias("rank"), e.alias("e")))

    def merged(all_: Column) -> Column:
        # of a name's entries the first of the highest rank; names in order of their first entries
        names = F.array_distinct(F.transform(all_, lambda x: x["low"]))

        def best(low: Column) -> Column:
            return F.aggregate(
                F.filter(all_, lambda x: x["low"] == low),
                F.lit(None).cast("struct<low:string,rank:int,e:struct<name:string,type:string,confidence:double>>"),
                lambda a, x: F.when(a.isNull() | (x["rank"] > a["rank"]), x).otherwise(a),
            )["e"]

        return F.transform(names, best)

    return text.let(keyed, merged).cast(_ENTITY)


def relations(rows: DataFrame, key: str = "id") -> DataFrame:
    """Pairs of a row's entities in order: key, from_name, from_type, to_name, to_type, relation.

    rows: key and entities.
    """
    a = F.posexplode("entities").alias("i", "x")
    left = rows.select(key, "entities", a)
    pairs = left.select(key, "x", F.explode(F.slice("entities", F.col("i") + 2, F.size("entities"))).alias("y"))
    person = F.col("x.type") == "person"
    relation = (
        F.when(person & (F.col("y.type") == "location"), F.lit("ASSOCIATED_WITH"))
        .when(person & (F.col("y.type") == "organization"), F.lit("WORKS_AT"))
        .when(person & (F.col("y.type") == "preference"), F.lit("HAS_PREFERENCE"))
        .otherwise(F.lit("RELATED_TO"))
    )
    return pairs.select(key, F.col("x.name").alias("from_name"), F.col("x.type").alias("from_type"), F.col("y.name").alias("to_name"), F.col("y.type").alias("to_type"), relation.alias("relation"))


def distribute(cards: DataFrame) -> DataFrame:
    """Questions dealt out to a card's facts: id, fact, hints. cards: id, facts, signatures (arrays).

    First every fact takes the question left whose longer words it shares most; questions then left go to
    the fact that shares most. A card is small and stands in one row, so this runs row by row in batches.
    """
    import re
    from collections.abc import Iterator

    import pandas as pd

    def words(t: str) -> set[str]:
        return {w for w in re.split(r"\W+", t.lower(), flags=re.ASCII) if len(w) >= 3}

    def deal(facts: list[str], questions: list[str]) -> list[list[str]]:
        out: list[list[int]] = [[] for _ in facts]
        has, asks = [words(f) for f in facts], [words(q) for q in questions]
        left = list(range(len(questions)))
        for f in range(len(facts)):
            if left:
                pick = max(left, key=lambda q: (len(asks[q] & has[f]), -q))
                left.remove(pick)
                out[f].append(pick)
        for q in left:
            out[max(range(len(facts)), key=lambda f: (len(asks[q] & has[f]), -f))].append(q)
        return [[questions[q] for q in o] for o in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f, h) for i, fs, qs in zip(b["id"], b["facts"], b["signatures"], strict=True) if len(fs) for f, h in zip(fs, deal(list(fs), list(qs)), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "fact", "hints"])

    return cards.select(F.col("id").cast("long").alias("id"), "facts", "signatures").mapInPandas(run, "id long, fact string, hints array<string>")


CARD = (
    "original string, atomic_facts array<string>, categories array<string>, entities array<struct<name:string,type:string>>, query_signatures array<string>, "
    "temporal struct<is_current:boolean,supersedes:string,time_expression:string>, importance double, memory_type string"
)


def card(c: Column) -> Column:
    """A memory card out of a model's answer: as it is, else its outermost braces, else those closed where
    the answer broke off. Null where nothing helps."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    opened = F.regexp_extract(c, r"(?s)(\{.*)", 1)
    quotes = F.regexp_count(opened, F.lit(r'(?<!\\)"'))
    closed = F.concat(F.regexp_replace(opened, r"[,:\s]+\z", ""), F.when(quotes % 2 == 1, F.lit('"')).otherwise(F.lit("")))
    bare = F.regexp_replace(closed, r'"(?:[^"\\]|\\.)*"', "")
    ends = F.concat(
        F.repeat(F.lit("]"), F.greatest(F.regexp_count(bare, F.lit(r"\[")) - F.regexp_count(bare, F.lit(r"\]")), F.lit(0))),
        F.repeat(F.lit("}"), F.greatest(F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}")), F.lit(0))),
    )
    options = [c, inner, F.concat(closed, ends)]

    def parsed(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull() & F.startswith(F.trim(x), F.lit("{")), F.from_json(x, CARD))

    return F.coalesce(*map(parsed, options))
