"""Personal data by weak supervision, in DataFrame functions alone.

Candidates come from the strict patterns (the base) and from looser ones. Four labelers vote on each:
a checked pattern, a gazetteer, the words before it, and its shape. Votes fall into a bounded number of
patterns, and what a span looks like into a bounded number of features; their counts over all documents are
the only thing that goes to the driver. There expectation-maximisation estimates from the votes how reliable
each labeler is, and a logistic classifier of the span's own features is trained on the resulting soft
labels. Base spans always stay; a looser candidate stays if the classifier accepts it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")

# The strict patterns, made linear: a run is entered at its start, or where the last match ended (\G),
# and possessive loops don't go back where going back can't help.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every text with a match holds, as a cheap first look.
HINT = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'", "phone": "contains(text, '+')"}

LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![+0-9().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
LOOSE_HINT = {"email": "text rlike '[\\\\[(]at[\\\\])]'", "ip": "text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]'", "phone": r"text rlike '[0-9]{3}[\\x20.-][0-9]{4}'"}

#: Whether a strict match holds: parts at most 255; 13 to 19 digits passing Luhn; 9 to 15 digits.
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN (length(d) - i) % 2 = 0 THEN cast(substring(d, i, 1) AS int) "
    "WHEN cast(substring(d, i, 1) AS int) < 5 THEN 2 * cast(substring(d, i, 1) AS int) ELSE 2 * cast(substring(d, i, 1) AS int) - 9 END) % 10 = 0"
)
HOLDS = {
    "email": "true",
    "ip": r"forall(split(m, '\\.'), p -> length(ltrim('0', p)) <= 2 OR length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255')",
    "card": f"exists(array({_DIGITS}), d -> CASE WHEN length(d) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END)",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}

_TLDS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|me|co|us|uk|ca|au|nz|ie|de|at|ch|fr|be|nl|lu|es|pt|it|gr|se|no|dk|fi|pl|cz|hu|ro|ru|ua|tr|il|in|cn|jp|kr|sg|za|br|mx|ar|cl"
# Votes: 1 for personal data, -1 against, 0 none. x has kind, m (the text), before (what stands before it), strict.
_VOTE = {
    "pattern": "CASE WHEN x.strict THEN 1 WHEN x.kind = 'phone' AND x.m rlike '^\\\\(?[2-9]' THEN 1 WHEN x.kind = 'phone' THEN -1 ELSE 0 END",
    "gazetteer": (
        f"CASE x.kind WHEN 'email' THEN if(lower(x.m) rlike '[^a-z0-9-](?:{_TLDS})\\\\z', 1, -1) "
        "WHEN 'ip' THEN if(x.m rlike '^0*(?:0|127|22[4-9]|2[3-5][0-9])\\\\.', -1, 1) "
        "WHEN 'card' THEN if(x.m rlike '^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)', 1, -1) "
        "ELSE if(regexp_replace(x.m, '[^0-9]', '') rlike '(?:555|800|900)?[0-9]{7}\\\\z', 1, -1) END"
    ),
    "context": (
        "CASE WHEN lower(x.before) rlike '(?:version|release|section|chapter|figure|table|order|invoice|token|hash|isbn|sku|no[.:]?|#)[^a-z0-9]{0,3}\\\\z' THEN -1 "
        "WHEN x.kind = 'email' AND lower(x.before) rlike '(?:mail|contact|write|reach|from|cc|to)[^a-z0-9]{1,4}\\\\z' THEN 1 "
        "WHEN x.kind = 'ip' AND lower(x.before) rlike '(?:ip|address|host|server|client|from|addr)[^a-z0-9]{1,4}\\\\z' THEN 1 "
        "WHEN x.kind = 'card' AND lower(x.before) rlike '(?:card|visa|mastercard|amex|payment|cc)[^a-z0-9]{1,4}\\\\z' THEN 1 "
        "WHEN x.kind = 'phone' AND lower(x.before) rlike '(?:phone|tel|call|fax|mobile|cell|dial|text)[^a-z0-9]{1,4}\\\\z' THEN 1 ELSE 0 END"
    ),
    "shape": (
        "CASE x.kind WHEN 'email' THEN if(length(x.m) BETWEEN 6 AND 80, 1, -1) WHEN 'ip' THEN if(x.m rlike '(?:^|\\\\.)0[0-9]', -1, 1) "
        "WHEN 'card' THEN if(length(regexp_replace(x.m, '[^0-9]', '')) IN (15, 16), 1, 0) ELSE if(length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 10 AND 12, 1, 0) END"
    ),
}
#: What the classifier sees of a span, and how many values each may have: its length, how many of its characters are
#: digits, whether it has letters, which separators, what stands before it, and in how many groups its digits come.
FEATURES = {
    "length": (4, "CASE WHEN length(x.m) <= 8 THEN 0 WHEN length(x.m) <= 16 THEN 1 WHEN length(x.m) <= 32 THEN 2 ELSE 3 END"),
    "digits": (3, "CASE WHEN NOT x.m rlike '[0-9]' THEN 0 WHEN 2 * length(regexp_replace(x.m, '[^0-9]', '')) <= length(x.m) THEN 1 ELSE 2 END"),
    "letters": (2, "if(x.m rlike '[A-Za-z]', 1, 0)"),
    "separators": (8, "if(contains(x.m, '.'), 1, 0) + if(contains(x.m, '-'), 2, 0) + if(x.m rlike '[\\\\[(]', 4, 0)"),
    "before": (4, "CASE WHEN x.before = '' THEN 0 WHEN x.before rlike '[\\\\s(:<\\\\[]\\\\z' THEN 1 WHEN x.before rlike '[A-Za-z0-9]\\\\z' THEN 2 ELSE 3 END"),
    "groups": (4, "least(size(split(x.m, '[0-9]+', -1)) - 1, 3)"),
}
_SPAN = "array<struct<kind:int,start:long,end:long,m:string,before:string,strict:boolean>>"
#: Matches folded in one part; characters of a text's pieces when spans are replaced.
_PART, _STEP = 128, 1024


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str, pattern: str, hint: str, strict: bool) -> str:
    """All matches of the pattern with their places: the texts between them (split) and the matches
    (regexp_extract_all) alternate, so the lengths add up to the places, in code points."""
    p = _quoted(pattern)
    step = (
        "(a, y) -> named_struct('at', a.at + length(y.gap) + coalesce(length(y.m), 0), 'out', CASE WHEN y.m IS NULL THEN a.out ELSE "
        f"concat(a.out, array(named_struct('kind', {KINDS.index(kind)}, 'start', a.at + length(y.gap), 'end', a.at + length(y.gap) + length(y.m), 'm', y.m, 'before', right(y.gap, 40), 'strict', {str(strict).lower()}))) END)"
    )
    zipped = f"transform(arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0)), y -> named_struct('gap', y['0'], 'm', y['1']))"
    empty = f"named_struct('at', 0L, 'out', cast(array() AS {_SPAN}))"
    # a fold copies what it has at every step, so texts with very many matches are folded in parts, and the parts then
    parts = f"transform(sequence(0, size(z) div {_PART}), i -> aggregate(slice(z, i * {_PART} + 1, {_PART}), {empty}, {step}))"
    moved = "transform(r.out, x -> named_struct('kind', x.kind, 'start', x.start + o, 'end', x.end + o, 'm', x.m, 'before', x.before, 'strict', x.strict))"
    before = "aggregate(slice(ps, 1, i), 0L, (a, q) -> a + q.at)"
    whole = f"transform(array({zipped}), z -> transform(array({parts}), ps -> flatten(transform(ps, (r, i) -> transform(array({before}), o -> {moved})[0])))[0])[0]"
    held = f"filter({whole}, x -> exists(array(x.m), m -> {HOLDS[kind]}))" if strict else whole
    return f"CASE WHEN {hint} AND text rlike {p} THEN {held} ELSE cast(array() AS {_SPAN}) END"


def candidates(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and found: all candidates of a text with their votes, base ones first by kind and start."""
    text = shared.text_of(docs, *more)
    strict = "concat(" + ", ".join(_spans(k, STRICT[k], HINT[k], True) for k in KINDS) + ")"
    loose = "concat(" + ", ".join(_spans(k, LOOSE[k], LOOSE_HINT[k], False) for k in KINDS if k in LOOSE) + ")"
    voted = {k: v.replace("x.kind = 'email'", "x.kind = 0").replace("x.kind = 'ip'", "x.kind = 1").replace("x.kind = 'card'", "x.kind = 2").replace("x.kind = 'phone'", "x.kind = 3").replace("WHEN 'email'", "WHEN 0").replace("WHEN 'ip'", "WHEN 1").replace("WHEN 'card'", "WHEN 2") for k, v in _VOTE.items()}
    votes = "concat(" + ", ',', ".join(f"cast({voted[k]} AS string)" for k in LABELERS) + ")"
    features = "concat(" + ", ',', ".join(f"cast({e} AS string)" for _, e in FEATURES.values()) + ")"
    found = f"transform(concat(base, filter(loose, y -> NOT exists(base, b -> b.start < y.end AND y.start < b.end))), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'strict', x.strict, 'votes', {votes}, 'features', {features}))"
    return text.withColumns({"base": F.expr(strict), "loose": F.expr(loose)}).withColumn("found", F.expr(found)).drop("base", "loose")


@dataclass(frozen=True)
class Classifier:
    """Probability that a candidate is personal data, from its kind and features; and what made it."""

    weights: list[list[float]]  # by kind: a bias, then a weight for each value of each feature
    soft: dict[tuple[int, str], float]
    reliability: dict[tuple[int, int], float]

    def probability(self, kind: int, features: str) -> float:
        w = self.weights[kind]
        return _sigmoid(w[0] + sum(w[i] for i in _places(features)))

    def accepts(self, x: Column) -> Column:
        """Base spans stay; others need one half."""
        w = F.get(F.array(*(F.array(*map(F.lit, own)) for own in self.weights)), x["kind"])
        f, at, z = F.split(x["features"], ","), 1, F.get(w, F.lit(0))
        for i, (n, _) in enumerate(FEATURES.values()):
            z, at = z + F.get(w, F.get(f, F.lit(i)).cast("int") + at), at + n
        return x["strict"] | (z >= 0)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _places(features: str) -> list[int]:
    """Where the weights of a span's features stand."""
    out, at = [], 1
    for v, (n, _) in zip(features.split(","), FEATURES.values(), strict=True):
        out.append(at + int(v))
        at += n
    return out


def label(counts: list[tuple[int, str, int]], rounds: int = 40) -> tuple[dict[tuple[int, str], float], dict[tuple[int, int], float]]:
    """From the counts of (kind, votes) the probability that such candidates are personal data, and how reliable
    each kind's labelers are, by expectation-maximisation.

    A labeler's vote depends on the hidden truth alone. Counts are over all documents; there are at most
    len(KINDS) * 3 ** len(LABELERS) rows of them.
    """
    rows = [(kind, tuple(int(v) for v in votes.split(",")), n) for kind, votes, n in counts]
    soft = {(k, v): _sigmoid(sum(v)) for k, v, _ in rows}
    reliability: dict[tuple[int, int], float] = {}
    for kind in {k for k, _, _ in rows}:
        own = [(v, n) for k, v, n in rows if k == kind]
        total = sum(n for _, n in own)
        for _ in range(rounds):
            yes = sum(n * soft[kind, v] for v, n in own)
            prior = (yes + 1) / (total + 2)
            chance = {}
            for j in range(len(LABELERS)):
                for vote in (-1, 0, 1):
                    a = sum(n * soft[kind, v] for v, n in own if v[j] == vote)
                    b = sum(n * (1 - soft[kind, v]) for v, n in own if v[j] == vote)
                    # a vote for counts, before any data, as likelier under the truth that it names
                    chance[j, vote] = (a + (2, 1, 0.5)[1 - vote]) / (yes + 3.5), (b + (0.5, 1, 2)[1 - vote]) / (total - yes + 3.5)
            for v, _ in own:
                soft[kind, v] = _sigmoid(math.log(prior / (1 - prior)) + sum(math.log(chance[j, x][0] / chance[j, x][1]) for j, x in enumerate(v)))
        for j in range(len(LABELERS)):
            cast = sum(n for v, n in own if v[j])
            agree = sum(n * (soft[kind, v] if v[j] > 0 else 1 - soft[kind, v]) for v, n in own if v[j])
            reliability[kind, j] = (agree + 1) / (cast + 2)
    return {(k, ",".join(map(str, v))): p for (k, v), p in soft.items()}, reliability


def fit(rows: list[tuple[int, str, int, float]], rounds: int = 400) -> list[list[float]]:
    """Logistic regression for each kind: (kind, features, count, sum of soft labels) to weights."""
    out = []
    for kind in range(len(KINDS)):
        own = [(_places(f), math.log1p(n), p / n) for k, f, n, p in rows if k == kind]
        w = [0.0] * (1 + sum(n for n, _ in FEATURES.values()))
        scale = sum(x for _, x, _ in own) or 1.0
        for _ in range(rounds if own else 0):
            grad = [0.003 * x for x in w]
            for at, weight, target in own:
                g = weight / scale * (_sigmoid(w[0] + sum(w[i] for i in at)) - target)
                grad[0] += g
                for i in at:
                    grad[i] += g
            w = [a - b for a, b in zip(w, grad, strict=True)]
        out.append(w)
    return out


def train(found: DataFrame) -> Classifier:
    """found: the result of candidates(). Only counts by vote pattern, at most 324, and by kind and features, at
    most 12,288, reach the driver."""
    each = found.select(F.explode("found").alias("x"))
    soft, reliability = label([(r["kind"], r["votes"], r["count"]) for r in each.groupBy("x.kind", "x.votes").count().collect()])
    if not soft:
        return Classifier(fit([]), soft, reliability)
    known = F.create_map(*(F.lit(x) for (k, v), p in sorted(soft.items()) for x in (f"{k}:{v}", p)))
    p = F.element_at(known, F.concat(F.col("x.kind").cast("string"), F.lit(":"), F.col("x.votes")))
    rows = each.groupBy("x.kind", "x.features").agg(F.count("*").alias("n"), F.round(F.sum(F.round(p, 6)), 3).alias("p"))
    return Classifier(fit(sorted((r["kind"], r["features"], r["n"], r["p"]) for r in rows.collect())), soft, reliability)


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, spans (array of kind, start, end, strict by kind and start).

    Places are in code points, end exclusive. A null or empty text has no spans; repeated rows and null
    doc_ids give a row each; other columns are not read. Candidates are staged without texts.
    """
    spark = docs.sparkSession
    found = shared.staged(candidates(docs), shared.shared_dir(spark), "candidates")
    model = train(found)
    kept = F.filter("found", model.accepts)
    return found.select("doc_id", F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["strict"].alias("strict")))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, and spans as text."""
    spans = find(docs)
    base = F.filter("spans", lambda x: x["strict"])

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    return spans.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets, and n_chars, where there is
    one, the new length. Spans that overlap are replaced as one, named after the first. Rows, other
    columns and texts without spans stay as they are; a null text stays null.
    """
    spark = docs.sparkSession
    # candidates are found once and wait beside their rows
    inner = candidates(docs.select("doc_id", "text", F.struct("*").alias("_all")), "_all").select("_all", "found")
    inner = shared.staged(inner, shared.shared_dir(spark), "found")
    model = train(inner)
    kept = F.array_sort(F.transform(F.filter("found", model.accepts), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    merged = (
        "aggregate(_kept, cast(array() AS array<struct<start:bigint,end:bigint,kind:int>>), (a, x) -> CASE WHEN size(a) > 0 AND x.start < element_at(a, -1).end "
        "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end), 'kind', element_at(a, -1).kind))) ELSE concat(a, array(x)) END)"
    )
    # the text in pieces of _STEP characters: a gap between spans touches its own ones alone
    inner = inner.withColumn("_kept", kept).withColumn("_spans", F.when(F.size("_kept") > 0, F.expr(merged)))
    inner = inner.withColumn("_cut", F.when(F.size("_kept") > 0, F.regexp_extract_all(F.col("_all.text"), F.lit(f"(?s).{{1,{_STEP}}}"), F.lit(0))))

    def gap(start: str, end: str) -> str:
        some = f"substring(_cut[cast(k AS int)], cast(greatest({start} - k * {_STEP}, 0) + 1 AS int), cast(least({end} - k * {_STEP}, {_STEP}) - greatest({start} - k * {_STEP}, 0) AS int))"
        return f"if({end} > {start}, array_join(transform(sequence({start} div {_STEP}, ({end} - 1) div {_STEP}), k -> {some}), ''), '')"

    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    spans = f"transform(_spans, (x, i) -> concat({gap('if(i = 0, 0L, _spans[greatest(i, 1) - 1].end)', 'x.start')}, {names}[x.kind]))"
    tail = gap("element_at(_spans, -1).end", "cast(length(_all.text) AS bigint)")
    out = inner.withColumn("_clean", F.when(F.size("_kept") == 0, F.col("_all.text")).otherwise(F.expr(f"concat(array_join({spans}, ''), {tail})")))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_kept") == 0, F.col("_all.n_chars")).otherwise(F.length("_clean").cast("long"))
    return out.select(*(new[c].alias(c) if c in new else F.col("_all")[c].alias(c) for c in docs.columns))
