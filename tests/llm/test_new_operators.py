"""Least squares packing, the filter audit and hard negatives against plain versions, on edge cases and on whole tables."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import EDGES, VERY_LONG, frame

from sultry.llm import filter_audit, hard_negatives, nnls_packing, packing
from sultry.llm import queries as q

SF = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")


def plain_negatives(rows):
    """rows of (id, label, vector): the contract word for word."""
    v = {i: (label, np.array([np.floor(256 * x) for x in vec], np.int64)) for i, label, vec in rows}
    out = []
    for a in sorted(i for i in v if i % 50 == 0):
        label, x = v[a]
        score = {b: int((x[: min(len(x), len(y))] * y[: min(len(x), len(y))]).sum()) for b, (_, y) in v.items()}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if b != a and v[b][0] == label][:5]:
            fit = [b for b in order if v[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(fit[:3], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row_", F.lit("x")).withColumn("norm", F.lit(1)).withColumn("cell", F.lit(2))
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, lambda c: c % 50 == 0).collect())


def test_hard_negatives_equal_brute_force(spark):
    r = random.Random(5)
    hot = [0.5] * 8
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = []
    for i in range(3000):
        vec = hot if i % 3 == 0 else [x + r.gauss(0, 0.2) for x in r.choice(base)] if i % 3 == 1 else [r.gauss(0, 3 ** r.randrange(-3, 2)) for _ in range(8)]
        rows.append((i, 1 if i % 3 == 2 and i % 4 else r.randrange(6), [float(np.float32(x)) for x in vec]))
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and len({x[0] for x in got}) > 30


def test_hard_negative_edges(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.0]), (2, 2, [0.3, 0.1]), (2, 2, [0.3, 0.1]), (3, 2, []), (4, 2, [0.3]), (5, 1, [0.0, 0.0]), (6, 2, [0.3, 5.0, 9.0]), (50, 3, [1.0, 1.0]), (100, 1, [1.0, 0.0])]
    bad = [(7, None, [1.0, 0.0]), (8, 2, None), (None, 2, [0.3, 0.1]), (9, 2, [NAN, 0.1]), (10, 2, [0.3, INF]), (11, 2, [0.3, None]), (150, 2, [INF, 1.0])]
    assert mined(spark, rows + bad) == plain_negatives(sorted(set((i, label, tuple(v)) for i, label, v in rows)))
    assert mined(spark, []) == [] and mined(spark, bad) == []


def test_pruning_leaves_out_only_rows_below_the_threshold():
    r = np.random.default_rng(3)
    centers = r.normal(size=(40, 16))
    v = np.floor(256 * (centers[r.integers(0, 40, 2000)] + 0.1 * r.normal(size=(2000, 16))))
    norms = np.sqrt((v**2).sum(axis=1))
    order = np.argsort(-norms)
    bucket = hard_negatives.Bucket(np.arange(2000), np.zeros(2000), v[order], norms[order])
    own = v[:50]
    anchors = hard_negatives.Anchors(np.arange(50), np.arange(50), np.zeros(50), own, norms[:50], [[(0, 1)]] * 50, 5)
    scores = (own @ v[order].T).astype(np.int64)
    verified = 0
    for share in (0.9, 0.6, 0.0, -0.5):
        least = share * norms[:50] * bucket.longest
        met = {a: (rows, s) for a, rows, s in bucket.candidates(anchors, least)}
        for a in range(50):
            want = np.flatnonzero(scores[a] >= least[a])
            rows, s = met.get(a, (np.zeros(0, int), np.zeros(0, int)))
            assert set(want) <= set(rows.tolist()) and (s == scores[a][rows]).all()
            verified += len(rows) if share == 0.9 else 0
    assert verified < 50 * 2000 * 0.2


def plain_audit(docs, labels):
    ids = [i for i, _, _ in docs if i is not None]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    assert len(ids) or not docs
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = brute.words(t) if t else []
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]), strict=True) if bad}
        parts[source or ""].append((fails, labels.get(i, (0, 0))))
    out = set()
    for part, rows in parts.items():
        shapley = Counter()
        found = []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                earlier = sum(f in x[0] for x in rows) - len(gone)
                found.append((part, order, step, len(left), len(gone), earlier, sum(x[0] == {f} for x in rows), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone)))
        out |= {(*x, shapley[x[1][x[2] - 1]]) for x in found}
    return out


def audit_cases():
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(90)]
    docs = [(1, None, None), (2, "", ""), (2, "", ""), (None, "", "a"), (3, "one two", "a"), (None, "one two", "a"), (4, "é" * 30 + "AB", "b"), (5, " \n", "b"), (6, "x " * 60, "b")]
    for i in range(10, 90):
        text = " ".join(r.choice(vocab) for _ in range(r.randrange(30, 90))) + r.choice(["", " $", " ABCDEFGH" * 4])
        docs += [(i, text, r.choice(["a", "b", None]))] + [(i + 1000 * k, text, r.choice(["a", "c"])) for k in range(r.choice([0, 0, 1, 3]))]
    return docs, {i: (r.randrange(2), r.randrange(2)) for i in range(1, 60)}


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_audit_equals_brute_force(spark, digest):
    docs, labels = audit_cases()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part_ string, hash_ int")
    known = spark.createDataFrame([(i, g, t) for i, (g, t) in labels.items()] + [(2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    before = filter_audit.failure_masks
    try:
        filter_audit.failure_masks = lambda *a: before(*a, digest=digest)
        rows = filter_audit.audit_filters(df, known).collect()
    finally:
        filter_audit.failure_masks = before
    assert {tuple(x) for x in rows} == plain_audit(docs, labels) and len(rows) == 600 * 4
    assert filter_audit.audit_filters(df.limit(0), known).count() == 0 and filter_audit.audit_filters(df, known.limit(0)).count() == 2400


def test_sketch_clears_only_unique_texts(spark):
    rows = spark.createDataFrame([(i % 700,) for i in range(1000)], "n int").select(F.xxhash64("n").alias("hash_"))
    seen = Counter(r.hash_ for r in rows.collect())
    for counters in (64, 1024, 1 << 14):
        left = Counter(r.hash_ for r in filter_audit.possible_repeats(rows, filter_audit.repeat_sketch(rows, counters), counters).collect())
        assert all(left[h] == n for h, n in seen.items() if n > 1) and set(left) <= set(seen)
    assert len(left) < 330


def read_packed(rows, capacity):
    """Checks the layout; pieces by document in order of start."""
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    assert padded == 0
    return by


def test_nnls_packing_whole_table(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = read_packed(q.op11_nnls_packing(spark, SF).collect(), 4096)
    assert by.keys() == docs.keys()
    for i, rows in by.items():
        ids = np.array([*t.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_nnls_packing_edges(spark):
    rows = nnls_packing.nnls_pack(frame(spark, EDGES)).collect()
    by = read_packed(rows, 4096)
    assert {r.doc_id for r in rows} == {i for i, _ in EDGES} and sum(r.length for r in by[5]) == 2 * by[5][0].doc_tokens
    assert nnls_packing.nnls_pack(frame(spark, [])).count() == 0
    long = nnls_packing.nnls_pack(frame(spark, list(VERY_LONG.items())).repartition(5)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("of")).collect()
    assert len(long) == len(VERY_LONG) and all(r.n == r.of for r in long)
    many = spark.range(3000).select("id", F.repeat(F.lit("a "), F.when(F.col("id") % 3 == 0, 11).otherwise((F.col("id") * 7919 % 401).cast("int"))).alias("t"), F.lit(0).alias("slot_"))
    read_packed(nnls_packing.nnls_pack(many.withColumnRenamed("id", "doc_id"), text="t", capacity=512).collect(), 512)


def test_words_have_the_ids_of_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), nnls_packing.WordEncoder(path)
    r = random.Random(4)
    parts = ["Hello", "it's", "ÉTÉ", "é", "́", " ", "  ", "\n", "\t", " ", "\x0b", "\x1c", "\x85", "ΑΣ", "<|endoftext|>", "<|start", "12,5", "日本語", "'s", "!!", "가", "ﬁ", "İ", "a" * 120, "​", " "]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_plan_of_combinations():
    r = random.Random(9)
    for capacity, n in ((64, 30), (4096, 900)):
        h = {x: r.randrange(1, 400) for x in r.sample(range(1, capacity + 1), n)}
        plan, sequences, rest = nnls_packing.plan_nnls(h, capacity)
        ranks, filled, streamed = defaultdict(list), Counter(), 0
        for length, first, last, seq, per, _, base in sorted(plan, key=lambda p: p[1]):
            assert (ranks[length][-1] if ranks[length] else 0) == first
            ranks[length].append(last)
            if base is None:
                for k in range(last - first):
                    filled[seq + k // per] += length
            else:
                streamed += length * (last - first)
        assert {k: v[-1] for k, v in ranks.items()} == h and streamed == rest
        assert sorted(filled) == list(range(sequences)) and set(filled.values()) == {capacity}
        assert sequences and rest < 0.8 * sum(k * v for k, v in h.items())


def test_repeat_counts_solve_the_histogram():
    lengths, repeats = nnls_packing.combinations({1: 40, 2: 30, 3: 20, 5: 7, 8: 3}, 8)
    assert ((lengths * repeats).sum(axis=1) == 8).all() and len(np.unique(np.hstack([lengths, repeats]), axis=0)) == len(lengths)
    x = nnls_packing.repeat_counts(lengths, repeats, np.array([0, 40, 30, 20, 0, 7, 0, 0, 3.0]), 2000)
    left = np.array([0, 40, 30, 20, 0, 7, 0, 0, 3]) - np.bincount(lengths.ravel(), (repeats * x[:, None]).ravel(), 9)
    gradient = (repeats * left[lengths]).sum(axis=1)
    assert (x >= 0).all() and gradient.max() < 1e-3 and np.abs(gradient * x).max() < 1e-2  # the conditions of a least squares optimum


def plain_best_fit(histogram, capacity):
    spaces = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [s for s in spaces if s >= length]
            if fit:
                spaces.remove(min(fit))
                spaces.append(min(fit) - length)
            else:
                spaces.append(capacity - length)
    return len(spaces)


def test_best_fit_plan_uses_as_many_sequences_as_best_fit():
    r = random.Random(6)
    cases = [({300: 4, 241: 3}, 1024)]
    for _ in range(1000):
        capacity = r.choice([20, 64, 100])
        cases.append(({r.randrange(1, capacity + 1): r.randrange(1, 9) for _ in range(r.randrange(1, 9))}, capacity))
    for h, capacity in cases:
        plan = packing.plan_best_fit(h, capacity)
        assert len({s + k for _, a, b, s, _ in plan for k in range(b - a)}) == plain_best_fit(h, capacity), (h, capacity)
