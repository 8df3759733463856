"""Pieces of DuckDB SQL for the checks: the same rules, written for that engine."""

from __future__ import annotations

from ..functions import fixed


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text(pattern)}, 'i')"


def hits(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"{match(x, p)}::INT" for p in patterns) + ")"


def any_match(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(match(x, p) for p in patterns) + ")"


def tokens(x: str, least: int, stop: list[str]) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '\W+'), lambda w: length(w) >= {least} AND NOT list_contains({words(stop)}, w))"


def lexemes(x: str) -> str:
    return f"list_distinct({tokens(x, 2, fixed.ENTITY_STOPWORDS)})"


def keywords(x: str) -> str:
    return f"list_distinct({tokens(x, 4, fixed.KEYWORD_STOPWORDS)})"


def split(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def token_count(x: str) -> str:
    return f"ceil(len({split(x)}) * 1.3::DOUBLE)::INT"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 6)"


def recency(created: str) -> str:
    return f"exp(-0.01::DOUBLE * greatest(date_diff('microsecond', {created}, TIMESTAMP '2024-02-01 00:00:00') / 3600000000.0::DOUBLE, 0))"


ALIVE = "({p}expires_at IS NULL OR {p}expires_at > TIMESTAMP '2024-02-01 00:00:00') AND ({p}invalid_at IS NULL OR {p}invalid_at > TIMESTAMP '2024-02-01 00:00:00')"


def alive(prefix: str = "") -> str:
    return ALIVE.format(p=prefix)


def negation(a: str, b: str) -> str:
    return "(" + " OR ".join(f"({match(x, p)} AND {match(y, n)})" for p, n in fixed.NEGATIONS for x, y in ((a, b), (b, a))) + ")"


def elaborates(old: str, new: str) -> str:
    own = tokens(old, 4, fixed.ELABORATION_STOPWORDS)
    return f"(length({new}) > length({old}) AND len({own}) > 0 AND len(list_filter({own}, lambda w: contains(lower({new}), w))) >= len({own}) * 0.7::DOUBLE)"


def arbitrate(old: str, new: str) -> str:
    marks = f"{hits(new, fixed.TEMPORAL_MARKERS)}"
    return f"""CASE WHEN {negation(old, new)} THEN 'contradiction' WHEN {marks} > {hits(old, fixed.TEMPORAL_MARKERS)} AND {marks} >= 2 THEN 'update'
        WHEN {elaborates(old, new)} THEN 'elaboration' WHEN {elaborates(new, old)} THEN 'update' ELSE 'new' END"""
