"""The registered queries over whole sf0.01 tables against plain versions."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from sultry.llm import quality_classifier
from sultry.llm import queries as q
from sultry.llm.url_filters import RULES, page_links

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = q.op1_url_filters(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    edges = [(r.a, r.b) for r in page_links(spark.read.parquet(f"{SF}/pages.parquet")).collect()]
    want = brute.verdicts({u for u in pages.values() if u}, edges, RULES)
    for r in got:
        host, path = brute.url(pages[r.page_id])
        rule, action = brute.rule(host, path, RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == want.get(pages[r.page_id], "allow") and (action is None or r.verdict == action)


def test_secrets(spark, docs):
    got = q.op2_secret_scans(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        found = brute.base_secrets(docs[r.doc_id])
        kinds = Counter(k for _, k, _ in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        assert r.base_sha256 == brute.sha(brute.spans(found))
        assert brute.spans(found) == ",".join(s for s in r.spans.split(",") if not s.startswith("entropy"))
        random = [s.split(":") for s in r.spans.split(",") if s.startswith("entropy")]
        assert {p for _, a, b in random for p in range(int(a), int(b))} == brute.entropy(docs[r.doc_id])


def test_shards(spark, docs):
    got = q.op3_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    by = defaultdict(list)
    for r in got:
        assert r.size == len((docs[r.doc_id] or "").encode()) + 8 and r.text_crc32 == brute.crc(docs[r.doc_id])
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    sizes = [sum(r.size for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_leaks(spark, docs):
    items = {r.item_id: brute.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in q.op4_decontamination(spark, SF).collect()}
    plain = {i: " " + " ".join(brute.words(t)) + " " for i, t in docs.items()}
    whole = {(i, b) for i, t in plain.items() for b, w in items.items() if " " + " ".join(w) + " " in t}
    most = {(i, b) for i, t in plain.items() for b, w in items.items() if sum(" " + " ".join(w[k : k + 8]) + " " in t for k in range(len(w) - 7)) >= 0.6 * (len(w) - 7)}
    assert whole and whole <= got == most


def test_chat(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    convs[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in q.op5_chat_formatting(spark, SF).collect()}
    assert got.keys() == convs.keys()
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{t}\n" for _, a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars > sum(len(t) for _, _, t in turns)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in q.op6_best_fit_packing(spark, SF).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert got.keys() == docs.keys()
    for i, rows in got.items():
        ids = np.array([*t.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and len(rows) == -(-len(ids) // 1024)
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in rows[1:])
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(bins) <= 1.01 * -(-total // 1024) + 1


def test_substrings(spark, docs):
    want = brute.dedup(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op7_substring_dedup(spark, SF).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_jaccard(spark, docs):
    want = brute.jaccard(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op8_ngram_jaccard(spark, SF).collect()}
    assert got == want and any(c != i for i, (_, c) in want.items())


def test_quality_rules(spark, docs):
    rows = q.op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(docs[r.doc_id]), r.doc_id
        assert (r.kept, r.n_lost_words) == brute.kept(docs[r.doc_id])[:2], r.doc_id
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_scores_equal_a_plain_discriminant(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    stats = {r.doc_id: np.array(r.x) for r in quality_classifier.statistics(docs).collect()}
    known = [(x, labels[i]) for i, x in stats.items() if i in labels and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (x - center) / scale
    each = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(each))

    def density(v, k):
        c = 0.9 * each[k] + 0.1 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))
        d = v - z[y == k].mean(axis=0)
        return np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d)

    for r in q.op10_quality_classifier(spark, SF).collect():
        v = (stats[r.doc_id] - center) / scale
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(density(v, 1) - density(v, 0), -30, 30)))) < 1e-6


def test_classifier(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = q.op10_quality_classifier(spark, "/root/testdata/sf0.1").collect()
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good])
    right = np.mean([p == y for _, p, y in held])
    print(auc, right)
    assert auc > 0.97 and right > 0.95
