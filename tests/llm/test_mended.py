"""Clashing working columns, constant statistics, spans of whole texts, classes of random strings, names at the start of sentences."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_edges import frame

from sultry.llm import decontamination, quality_classifier, quality_rules, secrets


def test_rules_beside_columns_with_working_names(spark):
    names = ["lines_", "words_", "grams_", "in0_", "text_", "a.b"]
    docs = frame(spark, [(1, "a b c\nshort line here"), (2, None)]).select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    rows = quality_rules.clean_lines(docs).collect()
    assert all([r[n] for n in names] == names for r in rows) and {r.doc_id: r.n_words for r in rows} == {1: 6, 2: 0}


@pytest.mark.parametrize("texts", [[None] * 12, ["the same text"] * 12, ["one text", "another text"] * 6])
def test_scores_of_constant_statistics(spark, texts):
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(12)], "doc_id long, quality int")
    rows = quality_classifier.score_quality(frame(spark, list(enumerate(texts))), labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)


def test_redaction_is_linear():
    took = []
    for n in (25_000, 100_000):
        text = "password=hunter2abcd then " * n
        began = time.process_time()
        out = secrets.redacted(text, "[S]")
        took.append(time.process_time() - began)
        assert out == "[S] then " * n
    assert took[1] < 10 * took[0] + 1


def test_recall_by_class():
    r = random.Random(21)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for chars, n, least in (("0123456789abcdefABCDEF", 40, 0.9), (low + up + num, 40, 0.99), (low + up + num + "+/", 44, 0.99), (low + num, 24, 0.9), ("ABCDEF" + num, 40, 0.99), (low + up, 40, 0.9)):
        found = sum(bool(secrets.find_spans("see " + "".join(r.choice(chars) for _ in range(n)) + " there")) for _ in range(500))
        assert found >= least * 500, (chars, n, found)


NAMES = ["Tom", "Anna", "Peter", "Lucy", "Oskar", "Mary", "Hugo", "Nora"]


@pytest.mark.parametrize("kind", ["first", "two words", "unit attached", "numbers", "values merge"])
def test_recall_of_items_by_change(spark, kind):
    r = random.Random(31)
    vocab = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "sa", "re") for b in ("ron", "den", "mar", "tis", "pol", "van", "gor", "nes")]
    items, docs = [], []
    for i in range(60):
        sentences = [[r.choice(vocab) for _ in range(r.randrange(9, 14))] for _ in range(4)]
        old, new = r.sample(NAMES, 2)
        a, b = r.sample(range(10, 99), 2)
        c, d = r.sample(range(100, 999), 2)
        say = lambda name, x, y, unit: " ".join(f"{name} {' '.join(s[:4])} {x if k % 2 else y}{unit} {' '.join(s[4:])}." if kind == "first" else f"{s[0].capitalize()} {' '.join(s[1:4])} {name} {x if k % 2 else y}{unit} {' '.join(s[4:])}." for k, s in enumerate(sentences))  # noqa: E731, B023
        item = say(old, a, b, " km")
        other = {"first": say(new, c, d, " km"), "two words": say(f"{new} Smith", a, b, " km"), "unit attached": say(old, a, b, "km"), "numbers": say(old, c, d, " km"), "values merge": say(old, c, c, " km")}[kind]
        items.append((i, item))
        docs += [(2 * i, f"before that {item} and after"), (2 * i + 1, f"before that. {other} And after")]
    docs += [(1000 + i, ". ".join(" ".join([r.choice(NAMES), *[r.choice(vocab) for _ in range(10)], str(r.randrange(99))]) for _ in range(5))) for i in range(200)]
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(2 * i, i) for i in range(60)} <= got and all(x // 2 == i for x, i in got)
    assert sum((2 * i + 1, i) in got for i in range(60)) >= 54
