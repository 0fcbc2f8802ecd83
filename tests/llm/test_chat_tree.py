"""The tree of turns against a plain one: conversations over many ranges, branches, prefixes of others, repeats and nulls."""

import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from sultry.llm import chat_tree


def conversations(seed):
    r = random.Random(seed)
    base = [("user" if i % 2 == 0 else "assistant", f"turn {r.randrange(5)}") for i in range(400)]
    out = {1: base, 2: base[:150], 3: list(base), None: base[:7]}
    for i in range(4, 40):
        n = r.choice([0, 1, 1, 2, 5, 60, 300])
        out[i] = base[:n] + [(r.choice(["user", "assistant"]), r.choice(["a", "b", "", "</s>"])) for _ in range(r.randrange(1, 6))]
    return out


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_a_plain_one(spark, many_ranges, seed):
    convs = conversations(seed)
    rows = [(c, k, role, text or None, "x") for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(5)
    assert chat_tree._bases(chat_tree._ordered(df)).count() > 2
    nodes, leaves = chat_tree.prefix_tree(df)
    nodes, leaves = nodes.collect(), leaves.collect()
    prefixes = {tuple(turns[: k + 1]) for turns in convs.values() for k in range(len(turns))}
    by = {n.node_id: n for n in nodes}
    assert len(by) == len(nodes) == len(prefixes) and {r.conv_id: r.n_turns for r in leaves} == {c: len(t) for c, t in convs.items()}
    trees = defaultdict(list)
    for n in nodes:
        trees[n.tree_id].append(n)
        above, up = [], by.get(n.parent_id)
        while up:
            above.append(up)
            up = by.get(up.parent_id)
        assert len(above) == n.depth and n.position == sum(len(a.tokens) for a in above)
        places = sorted(p for a in above for p in range(a.start, a.start + len(a.tokens)))
        given = [p for i in n.ancestors for p in range(i["start"], i["end"])]
        assert given == places and len(n.ancestors) <= 1 + len({a.segment for a in above})
    for tree in trees.values():
        at, open_ = 0, []
        for n in sorted(tree, key=lambda n: n.start):
            assert n.start == at
            at += len(n.tokens)
            while open_ and open_[-1] != n.parent_id:
                open_.pop()
            assert open_ or n.parent_id is None  # depth first: a node follows its parent or what is below that
            open_.append(n.node_id)
    deep = max(nodes, key=lambda n: n.depth)
    assert deep.depth == 399 and len(deep.ancestors) < 30


def test_digests_of_conversations(spark, many_ranges):
    convs = conversations(3)
    df = spark.createDataFrame([(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_tree.conversation_digests(chat_tree.read_turns(*chat_tree.prefix_tree(df))).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns))) and (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))
    empty = chat_tree.prefix_tree(df.where(F.lit(False)))
    assert empty[0].count() == 0 and empty[1].count() == 0 and chat_tree.read_back(*empty).count() == 0
