"""The ten operators against plain versions, and on awkward tables."""

import base64
import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tarnlake.llm import bpe, exact_dedup, fingerprint, minhash, packing, pii, queries, sharding, shared, suffix, toxicity, url_filter

import brute
from compare import same

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, duck, data):
    same(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name])


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# ---- 1 ----


def test_near_dedup(documents):
    texts = texts_of(documents)
    want = brute.near_components(texts)
    got = minhash.near_dedup(documents).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(brute.shingles(texts[i])), want[i], want[i] == i) for i in texts}


@pytest.mark.parametrize(("chunk", "block"), [(1 << 17, 1 << 18), (400, 1 << 18), (400, 400)])
def test_near_copies_of_one_text(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.integers(0, 4)):
            own[rng.integers(0, 120)] = f"x{rng.integers(0, 40)}"
        rows.append((1000 - i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.near_components(dict(rows))
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(df).collect()} == want
    assert len(set(want.values())) < 100


@pytest.mark.parametrize("chunk", [1 << 17, 100])
def test_near_dedup_of_repeated_ids(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", chunk)
    words = [[f"{c}{i}" for i in range(80)] for c in "abcd"]
    text = [" ".join(w) for w in words]
    rows = [(1, text[0]), (2, text[0] + " x"), (2, text[1]), (3, text[1] + " y"), (4, text[2]), (5, text[2] + " z"), (6, text[3])]
    got = collections.defaultdict(set)
    for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.component_id)
    assert got == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {4}, 6: {6}}


def test_confirm():
    rng = np.random.default_rng(8)
    for percent in (50, 85):
        base = rng.permutation(10**6)[:60]
        sets = []
        for i in range(300):
            own = rng.permutation(base)[: rng.integers(45, 61)] if i % 3 else rng.integers(0, 10**6, rng.integers(1, 9))
            sets.append(np.unique(np.append(own, rng.integers(0, 300, rng.integers(0, 8)))).astype(np.uint64))
        size = np.array([len(x) for x in sets])
        low = np.concatenate(sets)
        got = minhash.confirm(low // np.uint64(2), low, size, percent)  # halves that collide
        pairs = [(i, i) for i in range(len(sets))] + [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= percent * (size[i] + size[j] - n)]
        want = brute.components(pairs)
        first: dict = {}
        assert [first.setdefault(c, i) for i, c in enumerate(got.tolist())] == [want[i] for i in range(len(sets))]


def test_confirm_is_fast():
    import time

    rng = np.random.default_rng(9)
    size = np.full(8000, 60)
    low = np.stack([np.append(np.arange(54), 100 + rng.permutation(40)[:6]) for _ in size]).astype(np.uint64)
    began = time.process_time()
    minhash.confirm(low.ravel(), low.ravel(), size, 85)
    assert time.process_time() - began < 30  # of all threads; about two seconds of one clock
    print(time.process_time() - began)


def thue_morse(n=1024):
    """Two texts of letters on which any byte polynomial modulo 2**64 agrees."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_that_a_polynomial_takes_for_one(spark):
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, f"{a} {b} {a}"), (4, f"{a} {a} {a}"), (5, f"{b}\n{b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(df).collect()} == brute.near_components(dict(rows)) == {i: i for i in range(1, 6)}
    e = tiktoken_of()
    for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect():
        assert r.decoded == dict(rows)[r.doc_id] and r.ids == ",".join(map(str, e.encode_ordinary(r.decoded)))
    import tokenizers

    t = tokenizers.Tokenizer.from_file(WORDS)
    for r in packing.pack(df, WORDS).where("piece = 0").collect():
        assert [*r.ids] == [*t.encode(dict(rows)[r.doc_id]).ids, 0][:2048]
    want = brute.repeated({i: x.encode() for i, x in rows})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.substring_dedup(df, keep=False).collect()} == want
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(df).collect()}
    assert prints[3] != prints[4]


def test_near_dedup_edges(edge, nothing):
    got = collections.defaultdict(list)
    for r in minhash.near_dedup(edge).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[2] == got[3] == [(0, None, None)] or [got[i][0] for i in (1, 2, 3)] == [(0, i, True) for i in (1, 2, 3)]
    assert got[4] == [(16, 4, True)] and got[5] == [(16, 4, False)] and got[6] == [(16, 4, False)] * 2
    assert got[7][0][1:] == (7, True) and got[8][0][1:] == (7, False)
    assert sorted(got[None]) == [(0, None, True), (1, None, True)]
    assert minhash.near_dedup(nothing).count() == 0


# ---- 2 ----


def test_fingerprint(documents):
    rows = {r.doc_id: r for r in fingerprint.compare_with_next(documents).collect()}
    texts = sorted(texts_of(documents).items())
    rank = fingerprint.ranks(fingerprint.histogram(documents))
    prints = collections.defaultdict(set)
    for k, (i, t) in enumerate(texts):
        r, after = rows[i], texts[(k + 1) % len(texts)]
        edited = fingerprint._edited(t, after[1])
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        own = fingerprint.chain(fingerprint.features(np.array([0, len(edited.encode())]), np.frombuffer(edited.encode(), np.uint8), rank)[0])
        assert r.edited_fingerprint == fingerprint.written(own)
        assert r.near_next == pytest.approx(fingerprint.likeness(fingerprint.read(r.fingerprint), fingerprint.read(rows[after[0]].fingerprint)))
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited for r in rows.values()]) > 0.6
    assert np.median([r.near_next for r in rows.values()]) < 0.2


def test_entropy_levels():
    rng = np.random.default_rng(2)
    d = np.concatenate([rng.integers(97, 110, 500), np.full(200, 65), rng.integers(0, 256, 300)]).astype(np.uint8)
    got = fingerprint.levels(d)
    for i in range(len(got)):
        p = np.bincount(d[i : i + 64]) / 64
        p = p[p > 0]
        assert abs(got[i] + (p * np.log2(p)).sum() / 6 * 1000) <= 0.51


def test_fingerprint_edges(edge, nothing, spark):
    rows = fingerprint.compare_with_next(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[2].near_edited == 1.0 and by[1].near_next == 1.0 and by[3].near_next == 0.0
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 6)}) == 1
    assert by[8].near_edited < 1 and by[7].near_next > 0.9
    assert fingerprint.compare_with_next(nothing).count() == 0
    alone = fingerprint.compare_with_next(edge.where("doc_id = 4")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == brute.sha(fingerprint._edited(*[edge.where("doc_id = 4").first().text] * 2))
    assert {r.fingerprint for r in fingerprint.fingerprint(edge.where("doc_id IN (4, 6)")).collect()} == {alone.fingerprint}


# ---- 3 ----


def test_pii(documents, spark):
    odd = [
        "a@b.c-d@e.f a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1.2.3.4 0255.1.1.1", "4111 1111 1111 1111 and 4111111111111112 4111-1111", "+1 (386) 555-3733)( +123 +12345678901234567", "é 😀 a.b@c.de 😀 x@y.z",
        "@@@ a@ @b.c a@b a@b. a@b.c.", "+1+12345678 9+", "a" * 30_000 + "1" * 30_000, "",
    ]
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = texts_of(df)
    for r in pii.report(df).collect():
        base = brute.personal(texts[r.doc_id])
        n = collections.Counter(k for k, _, _ in base)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], brute.sha(line))
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_pii_learns():
    # pattern and context agree; the gazetteer votes at random
    counts = [(3, "1,1,1,1", 40), (3, "1,-1,1,1", 40), (3, "-1,1,-1,0", 50), (3, "-1,-1,-1,0", 50), (3, "1,1,0,1", 10)]
    soft, reliability = pii.label(counts)
    assert soft[3, "1,1,1,1"] > 0.5 > soft[3, "-1,-1,-1,0"]
    assert reliability[3, 0] > reliability[3, 1]
    weights = pii.fit([(3, "1,2,0,6,1,3", 50, 48.0), (3, "1,2,0,2,2,3", 50, 3.0)])
    model = pii.Classifier(weights, soft, reliability)
    assert model.probability(3, "1,2,0,6,1,3") > 0.5 > model.probability(3, "1,2,0,2,2,3")


def loose_cases(n=600):
    """Texts with one loose candidate each, and whether it is personal data."""
    rng = np.random.default_rng(12)
    out = []
    for i in range(n):
        a, b, c = rng.integers(200, 999), rng.integers(200, 999), rng.integers(1000, 9999)
        d = "".join(map(str, rng.integers(0, 10, 7)))
        name, host = ("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(2))
        lead = rng.choice(["", "please ", "or ", "then "])
        out.append((
            (f"{lead}call ({a}) {b}-{c} today", True), (f"{lead}phone: ({a}) {b}-{c}", True), (f"{lead}reach us at ({a}) {b}-{c}", True), (f"{lead}invoice no. 0{d[:2]}-{b}-{c} was paid", False), (f"{lead}order 1{d[:2]}.{b}.{c}", False),
            (f"{lead}write to {name} [at] {host} [dot] com", True), (f"{lead}mail {name}(at){host}(dot)org now", True), (f"{lead}part 0{d[:2]} {b} {c} in the list", False),
        )[i % 8])
    return out


def test_pii_added_spans(spark):
    """Precision and recall of the spans that the classifier adds to the base."""
    cases = loose_cases()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.spans != "" for r in pii.report(df).collect()}
    hit = sum(got[i] and y for i, (_, y) in enumerate(cases))
    precision, recall = hit / sum(got.values()), hit / sum(y for _, y in cases)
    print("precision", precision, "recall", recall)
    assert precision >= 0.95 and recall >= 0.95


def test_redact_long(spark):
    """Very many spans, in a text of several pieces."""
    text = "".join(f"é{i} 😀 a{i}@b.co, " + "x" * (i % 90) for i in range(3000))
    rows = [(1, text, len(text)), (2, "+1 386 555 3733@a.b", 19), (3, "4111 1111 1111 1111@x.org 1.2.3.4", 33)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    # spans that overlap are one, named after the first
    assert got == {1: re.sub(r"a\d+@b\.co", "<EMAIL>", text), 2: "<PHONE>", 3: "<CARD> <IP>"}


def test_redact(edge, spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15), (2, "none", 4), (3, None, None), (4, "joe [at] mail [dot] com, call +1 (555) 123-4567!", 48)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "mail <EMAIL> now" and got[1].n_chars == 16 and got[2].text == "none" and got[3].text is None
    assert "<PHONE>" in got[4].text
    assert pii.redact(edge).columns == edge.columns and pii.redact(edge).count() == edge.count()


def test_pii_edges(edge, nothing):
    got = {r.doc_id: r for r in pii.report(edge).collect()}
    assert got[10].n_email == 1 and got[10].n_ip == 1 and got[1].spans == ""
    assert pii.report(edge).count() == edge.count() and pii.report(nothing).count() == 0


# ---- 4 ----


def tiktoken_of():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(documents, edge):
    e = tiktoken_of()
    for df in (documents, edge):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = e.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(r.text or ""), ",".join(map(str, ids)), r.text or ""] += 1
        assert collections.Counter(map(tuple, bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect())) == want


def test_bpe_words():
    e, mine = tiktoken_of(), bpe.encoder(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(4)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "😀", "\xa0", "\u2003", "\x1c", "\x85", "!", "Ç", "×", "<|endoftext|>", "ab" * 90]
    texts = ["", "a" * 3000, " " * 500, "\n" * 300 + " x"] + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1500)]
    for t, (ids, back) in zip(texts, mine.texts(pa.array(texts)), strict=True):
        assert ids == ",".join(map(str, e.encode_ordinary(t))) and back == t.encode()


@pytest.mark.parametrize("file", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_long_words(file):
    import tiktoken

    mine = bpe.encoder(public_tokenizers.path(file), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    rng = np.random.default_rng(6)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "éàçñü", "语言模型数据"):
        words = ["".join(rng.choice(list(alphabet), n)) for n in (1, 2, 127, 129, 1000, 5000)]
        words += [alphabet[0] * 4001, alphabet[:2] * 999, (alphabet[0] * 2 + alphabet[1]) * 700]
        for t, (ids, back) in zip(words, mine.texts(pa.array(words)), strict=True):
            assert ids == ",".join(map(str, e.encode_ordinary(t))) and back == t.encode()


def test_bpe_of_tokens():
    """Every token of the vocabulary, and pairs of them, as one word."""
    e, mine = tiktoken_of(), bpe.encoder(RANKS, public_tokenizers.PATTERN)
    tokens = [t for t in mine.ranks if len(t) > 1]
    rng = np.random.default_rng(7)
    words = tokens + [tokens[i] + tokens[j] + tokens[k] for i, j, k in rng.integers(0, len(tokens), (5000, 3))]
    words = list(set(words))
    mine.learn(list(words))
    assert all(mine.words[w][0][:-1] == ",".join(map(str, e._core_bpe.encode_single_piece(w))) and mine.words[w][1] == w for w in words)
    mine.words.clear()


def test_bpe_empty(nothing):
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- 5 ----


def test_lookup_table():
    names = [f"s{i}" for i in range(20)]
    full, less = sharding.lookup_table(names, 5003), sharding.lookup_table(names[:-1], 5003)
    share = np.bincount(full, minlength=20)
    assert share.max() - share.min() <= 1
    moved = (full != less) & (full != 19)
    assert moved.mean() < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 5000)


def test_sharding_edges(edge, nothing):
    got = collections.defaultdict(set)
    for r in sharding.assign(edge, "doc_id", ["a", "b", "c"], 101).collect():
        got[r.doc_id].add((r.slot, r.shard))
    assert sharding.assign(edge, "doc_id", ["a", "b"], 101).count() == edge.count()
    assert all(len(v) == 1 for v in got.values())
    assert sharding.assign(nothing, "doc_id", ["a"], 101).count() == 0


# ---- 6 ----


def test_exact_edges(edge, nothing):
    got = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(edge, keep="largest", fan=2).collect():
        got[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(2, 3, False)] and got[2] == [(2, 3, True)]
    assert got[4] == got[5] == [(6, 4, False)] and got[6] == [(6, 4, True)] * 2
    assert sorted(got[None], key=str) == sorted([(None, 1, True), (2, 3, False)], key=str)
    assert exact_dedup.exact_dedup(edge, keep="smallest").where("doc_id = 4").first().kept
    assert exact_dedup.exact_dedup(nothing).count() == 0


# ---- 7 ----


def test_packing(documents, edge):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(WORDS)
    for df in (documents, edge):
        want, total = collections.Counter(), 0
        for r in df.select("doc_id", "text").collect():
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            for k in range(0, len(ids), 2048):
                part = ids[k : k + 2048]
                want[r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
        rows = packing.pack(df, WORDS).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            end = 0
            for offset, n in sorted(own):
                assert offset == end
                end += n
            assert end <= 2048
        assert len(bins) <= 1.1 * -(-total // 2048) + 2


def test_sum_of_squares():
    p = packing.Packer(10)
    rng = np.random.default_rng(1)
    for size in rng.integers(1, 11, 300).tolist():
        before = p.count.copy()

        def square(change):
            n = before.copy()
            for gap, d in change:
                n[gap] += d
            return int((n[1:10] ** 2).sum())

        options = [square([(size and 10 - size, 1)] if size < 10 else [])]
        options += [square([(g, -1)] + ([(g - size, 1)] if g > size else [])) for g in range(size, 10) if before[g]]
        p.place(size)
        assert int((p.count[1:10] ** 2).sum()) == min(options)


def test_packing_empty(nothing):
    assert packing.pack(nothing, WORDS, keep=False).count() == 0


# ---- 8 ----


@pytest.mark.parametrize(("shard", "rows"), [(1 << 20, 20_000), (2_000, 20_000), (2_000, 2)])
def test_suffix(spark, monkeypatch, shard, rows):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "MOST_ROWS", rows)
    rng = np.random.default_rng(9)
    base = "".join(map(chr, rng.integers(97, 123, 400)))
    texts = []
    for i in range(50):
        b = list(base)
        for _ in range(i % 4):
            b[rng.integers(0, 400)] = "#"
        texts.append("".join(b)[rng.integers(0, 100) : rng.integers(200, 400)])
    texts += ["a" * 700, "", "xy" * 200, "é" * 150, base + base, "a" * 99, base[:100], base[1:100], "\0" * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute.repeated({i: t.encode() for i, t in enumerate(texts)})
    got = suffix.substring_dedup(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in got)


def test_windows_of_a_crowded_anchor_travel_without_their_bytes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    phrase, around = letters(60), [letters(70) for _ in range(8)]
    texts = {i: letters(60) + around[i % 8] + phrase + around[i % 5] + letters(60) for i in range(200)}
    monkeypatch.setattr(suffix, "MOST_ROWS", 2)
    names, staged = [], shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, folder, name: names.append(name) or staged(df, folder, name))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.substring_dedup(df, keep=False).collect()}
    assert got == brute.repeated({i: t.encode() for i, t in texts.items()}) and any(r[1] for r in got.values())
    assert set(names) == {"anchors", "crowded"}
    # a task sends 100 windows of a run as numbers, of equal ones the first alone
    runs = [{"anchor": 1, "lo": 0, "hi": 100, "crowded": 1}]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([texts[0]] * 2), pa.array([runs] * 2)], ["doc", "text", "runs"])
    sent = pa.Table.from_batches(suffix._cut(iter([batch]))).to_pylist()
    assert [(r["kind"], r["doc"]) for r in sent] == [(0, 1)] * 101 + [(1, 2)] and all(r["raw"] is None for r in sent) and sent[-1]["more"] == 100


def test_suffix_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    base, other, short = ("".join(map(chr, rng.integers(97, 123, n))) for n in (300, 220, 90))
    rows = [(1, base), (2, base[40:200] + "!"), (2, short), (2, other), (2, other), (3, other[50:] + base[:120])]
    got = collections.defaultdict(list)
    for r in suffix.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id, r.n_bytes].append(r.n_removed)
    # texts of one doc_id are documents of their own, rows alike are one
    assert got == {(1, 300): [0], (2, 161): [160], (2, 90): [0], (2, 220): [0, 0], (3, 290): [290]}


def test_twin_hash():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse())
    data = np.concatenate([a, b, a[:5], a])
    at = np.array([0, 1024, 2053])
    h = shared.twin_hash(data, at, at + 1024)
    assert h[0] == h[2] != h[1] and (shared.span_hash(shared.prefix_hash(data), at, at + 1024) == shared.span_hash(shared.prefix_hash(data), at, at + 1024)[0]).all()


def test_suffix_documents(documents):
    want = brute.repeated({i: t.encode() for i, t in texts_of(documents).items()})
    assert {r.doc_id: tuple(r)[1:] for r in suffix.substring_dedup(documents, keep=False).collect()} == want


def test_suffix_array():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (5, 0, 60, 60, 200)] + [b"ab" * 40, b"\0\0"]
    ends = np.cumsum([len(x) + 1 for x in strings]) - 1
    text = np.frombuffer(b"".join(x + b"\0" for x in strings), np.uint8).astype(np.int64) + 1
    text[ends] = 0
    order, rank = suffix.suffix_array(text, ends)
    end = ends[np.searchsorted(ends, np.arange(len(text)))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: [10**6 + int(c) for c in text[i : end[i]]] + [int(end[i])])

    def common(i, j):
        k = 0
        while i + k < end[i] and j + k < end[j] and text[i + k] == text[j + k]:
            k += 1
        return k

    assert suffix.kasai(text, order, rank, ends).tolist() == [0] + [common(order[k - 1], order[k]) for k in range(1, len(text))]


def test_suffix_edges(edge, nothing):
    got = collections.defaultdict(list)
    for r in suffix.substring_dedup(edge).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed))
    assert got[1] == got[2] == [(0, 0)] and got[4][0][1] == 0 and got[6] == [(131, 131)] * 2
    assert got[9] == [(50_000, 49_999)]
    assert got[8][0][1] == got[7][0][0] and sorted(got[None]) == [(0, 0), (15, 0)]
    assert suffix.substring_dedup(nothing).count() == 0


# ---- 9 ----


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        own = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(5, 120))]
        bad = i % 9 == 0
        if bad:
            own[rng.integers(0, len(own))] = rng.choice(["moronic", "zqworthless"])
        rows.append((i, " ".join(own), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert 0.15 < len(out) / len(rows) < 0.25
    assert np.mean([p == y for p, y in out]) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    again = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert np.array_equal(model.weight, again.weight)


def test_toxicity_plainly(spark, documents, data):
    """Features, ratios, choice of features and scores against a plain version, on texts with accents."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    texts = texts_of(documents)
    wide = toxicity.characters(pa.array(["ÉA\tb", "", "né"]))
    assert wide[0].tolist() == [0, 4, 4, 6] and wide[1].tolist() == [233, 97, 32, 98, 110, 233]

    def counted(text):
        low = re.sub("[\t\n\v\f\r]", " ", text.lower())
        n = collections.Counter()
        for size in toxicity.GRAMS:
            for i in range(len(low) - size + 1):
                h = sum(int(toxicity.char_values()[ord(c)]) * pow(shared._P, k, 1 << 64) for k, c in enumerate(low[i : i + size]))
                n[h * (0xD6E8FEB86659FD93 + 2 * size) % (1 << 64) >> 64 - toxicity.BITS] += 1
        return {(k << toxicity.BITS) + g for g, c in n.items() for k in range(min(c, toxicity.TIMES))}

    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 and i in texts}
    seen, own = set(), {}
    for i in sorted(train):
        if (texts[i], train[i]) not in seen:
            seen.add((texts[i], train[i]))
            own[i] = counted(texts[i])
    n = collections.Counter(train[i] for i in own)
    count = {y: collections.Counter(f for i in own if train[i] == y for f in own[i]) for y in (0, 1)}
    ratio, sure = {}, {}
    for f in count[0] | count[1]:
        t, c = count[1][f], count[0][f]
        ratio[f] = np.log((t + 1) / (n[1] + 2)) - np.log((c + 1) / (n[0] + 2))
        sure[f] = abs(ratio[f]) / np.sqrt(1 / (t + 1) + 1 / (c + 1))
    model = toxicity.train(documents, spark.read.parquet(f"{data}/labels.parquet"))
    able = [f for f in ratio if sure[f] >= 2 and count[0][f] + count[1][f] > 1]
    want = sorted(sorted(able, key=lambda f: (-sure[f], f))[: toxicity.FEATURES])
    assert model.index.tolist() == want
    weight = dict(zip(want, model.weight.tolist(), strict=True))
    # a logistic regression on the ratios: a step of plain descent from its weights leaves the loss where it is
    w = {f: x / ratio[f] for f, x in weight.items()}
    rows = [(train[i], [f for f in fs if f in w]) for i, fs in own.items()]

    def loss(w, bias):
        z = [bias + sum(w[f] * ratio[f] for f in fs) for _, fs in rows]
        return sum(np.log1p(np.exp(-x if y else x)) * 0.5 / n[y] for (y, _), x in zip(rows, z, strict=True)) + 0.0005 * sum(x * x for x in w.values())

    assert loss(w, model.bias) < loss(dict.fromkeys(w, 0.0), 0.0) / 5
    got = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    for i in sorted(texts)[:60]:
        z = model.bias + sum(weight.get(f, 0.0) for f in counted(texts[i]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4)


def test_toxicity_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 500)
    rows = [(i, ("scum trash " if i % 4 == 0 else "kind words ") * 3 + f"number {i * 7919}", int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in toxicity.score(df, model).collect())


def test_toxicity_edges(edge, nothing, spark):
    labels = spark.createDataFrame([(4, 0, 0), (12, 0, 1), (11, 0, 0), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edge, labels)
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(nothing, model).count() == 0
    clean = toxicity.keep_clean(edge, model)
    assert clean.columns == edge.columns and clean.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.train(edge, labels.limit(0))
    assert {r.predicted for r in toxicity.score(edge, none).collect()} == {0}


# ---- 10 ----


def test_urls(spark):
    rules = spark.createDataFrame([("b.org", "/x", "block"), ("org", "/", "allow"), ("b.org", None, "allow"), ("c.net", "/", "block"), ("C.NET", "/", "block")], "host string, path string, verdict string")
    urls = ["http://a.b.org/xy?q", "https://B.ORG/z", "ftp://org", "http://ab.org/x", "nothing", None, "x://://y.org/a", "http://c.net/\nq#f", "http://notc.net/", "http://c.net/", "http://c.net/"]
    pages = spark.createDataFrame([(i % 10, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = collections.Counter(tuple(r) for r in url_filter.judge(pages, rules).collect())
    want = collections.Counter({
        (0, "a.b.org", "/xy", "b.org/x", "block"): 1, (1, "b.org", "/z", "b.org", "allow"): 1, (2, "org", "", None, "allow"): 1, (3, "ab.org", "/x", "org/", "allow"): 1, (4, "", "", None, "allow"): 1,
        (5, "", "", None, "allow"): 1, (6, ":", "//y.org/a", None, "allow"): 1, (7, "c.net", "/\nq", "c.net/", "block"): 1, (8, "notc.net", "/", None, "allow"): 1, (9, "c.net", "/", "c.net/", "block"): 1, (0, "c.net", "/", "c.net/", "block"): 1,
    })
    assert got == want
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_plan(spark, data):
    """The filter is made once, and URLs that it lets go aren't shuffled."""
    plan = queries.QUERIES["op10_url_filter"](spark, data)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange") <= 12 and "Subquery" not in plan and len(plan) < 40_000
    rules = spark.createDataFrame([("É.org", "/", "block"), ("STRASSE.de", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://É.ORG/x"), (2, "http://é.org/x"), (3, "http://strasse.DE/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_many_rules(spark):
    """A list long enough for a large filter, against a plain look-up."""
    rules = [(f"h{i}.org", "/a/" if i % 2 else "/", "block") for i in range(5000)]
    pages = [(i, f"http://w.h{i % 7000}.org/{'a' if i % 3 else 'b'}/{i}") for i in range(9000)]
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r.rule for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), given).collect()}
    assert got == {i: (f"h{i % 7000}.org" + ("/a/" if i % 7000 % 2 else "/") if i % 7000 < 5000 and (i % 7000 % 2 == 0 or i % 3) else None) for i, _ in pages}


def test_bloom(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    words, blocks = url_filter.bloom(keys, 3000)
    probe = spark.range(20_000).selectExpr("concat('k', id) AS key", "id < 3000 AS listed")
    from pyspark.sql import functions as F

    hit = probe.groupBy("listed").agg(F.avg(url_filter.passes(F.col("key"), words, blocks).cast("int")).alias("p"))
    rate = {r.listed: r.p for r in hit.collect()}
    assert rate[True] == 1.0 and rate[False] < 0.02
