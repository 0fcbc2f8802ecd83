"""Chat formatting as a prefix tree of turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, text_bytes
from .packing import default_vocabulary, encoder

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Control strings of common chat templates, escaped inside roles and texts.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*)<\|im_end\|>\n", re.S)


def escape(s: str) -> str:
    """Doubles backslashes, then puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    """Undoes escape: a double backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", s)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a turn."""
    return OPEN + escape(role) + MIDDLE, escape(text), CLOSE


def parse_turn(s: str) -> tuple[str, str]:
    m = _TURN.fullmatch(s)
    return unescape(m[1]), unescape(m[2])


#: Odd bases of the two 64-bit sums that name a prefix of turns.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MOST = (1 << 64) - 1


def _turn_hashes(role: bytes, text: bytes) -> tuple[int, int]:
    """Two 64-bit hashes of a turn."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "little") + role + text)
    return both & _MOST, both >> 64


def _prefix(sums: tuple[int, int], n: int) -> str:
    """The name of a prefix of n turns: 32 hexadecimal digits."""
    return f"{sums[0]:016x}{(sums[1] + n) & _MOST:016x}"


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows (cid, role, text, part, nth, sums, before): the turns in ranges of (conversation, turn, role, text), numbered within their conversation's part of a
    range, with the sums over the turns of the part up to each, and up to the one before. Sum i adds hash i of turn k times its base to the k, so that sums of
    parts make those of the whole. A task keeps a few numbers; cid is conv_id as text, empty for null."""
    cid = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = turns.select(cid.alias("cid"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Ranges go by the beginnings of texts, as their bounds are sampled; the order within a range is by whole ones.
    dealt = rows.repartitionByRange("cid", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions("cid", "turn", "role", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, nth, sums, powers = TaskContext.get().partitionId(), None, 0, (0, 0), (1, 1)
        for batch in batches:
            out: list[list] = [[], [], []]
            for cid, role, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), text_bytes(batch.column(2)), strict=True):
                if cid != now:
                    now, nth, sums, powers = cid, 0, (0, 0), (1, 1)
                before = sums
                sums = tuple((s + h * p) & _MOST for s, h, p in zip(sums, _turn_hashes(role, text), powers, strict=True))
                powers = tuple(p * b & _MOST for p, b in zip(powers, _BASES, strict=True))
                for column, value in zip(out, (nth, b"".join(x.to_bytes(8, "little") for x in sums), b"".join(x.to_bytes(8, "little") for x in before)), strict=True):
                    column.append(value)
                nth += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["cid", "role", "text", "part", "nth", "sums", "before"])

    return dealt.select("cid", "role", "text").mapInArrow(number, "cid string, role string, text string, part int, nth long, sums binary, before binary")


def _numbers(b: bytes) -> tuple[int, int]:
    return int.from_bytes(b[:8], "little"), int.from_bytes(b[8:], "little")


def _joined(base: tuple[int, int], n: int, sums: tuple[int, int]) -> tuple[int, int]:
    """The sums over n turns with sums `base` and then those of a part."""
    return tuple((x + pow(b, n, 1 << 64) * s) & _MOST for x, b, s in zip(base, _BASES, sums, strict=True))


def _bases(ordered: DataFrame) -> DataFrame:
    """Rows (cid, part, n, base) of conversations that cover several ranges: the number and sums of the turns in earlier ones. At most two conversations of a
    range do, so that the table has a few rows for each range."""
    parts = ordered.groupBy("cid", "part").agg(F.count("*").alias("n"), F.max_by("sums", "nth").alias("sums"))
    whole = parts.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("part", "n", "sums"))).alias("parts")).where(F.size("parts") > 1)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        for cid, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, sums = 0, (0, 0)
            for r in rows:
                for column, value in zip(out, (cid, r["part"], n, b"".join(x.to_bytes(8, "little") for x in sums)), strict=True):
                    column.append(value)
                sums, n = _joined(sums, n, _numbers(r["sums"])), n + r["n"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["cid", "part", "n", "base"])

    return map_batches(whole, run, "cid string, part int, n long, base binary")


def _named(ordered: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows (cid, role, text, depth, node_id, parent_id): each turn with the names of the prefix that ends with it and of the one before."""
    rows = ordered.join(F.broadcast(bases), ["cid", "part"], "left").select("cid", "role", "text", "nth", "sums", "before", "n", "base")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        depths, nodes, parents = [], [], []
        for nth, sums, before, n, base in zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True):
            here, last = _numbers(sums), _numbers(before)
            if n:
                start = _numbers(base)
                here, last = _joined(start, n, here), _joined(start, n, last)
            depth = (n or 0) + nth
            depths.append(depth)
            nodes.append(_prefix(here, depth))
            parents.append(_prefix(last, depth - 1) if depth else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(depths, pa.int64()), pa.array(nodes, pa.string()), pa.array(parents, pa.string())], ["cid", "role", "text", "depth", "node_id", "parent_id"])

    return map_batches(rows, run, "cid string, role string, text string, depth long, node_id string, parent_id string")


def prefix_tree(turns: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of the conversations in turns (conv_id, turn, role, text).

    nodes: one row for each different prefix of turns: tree_id (its first turn's node), node_id, parent_id, depth,
    tokens (the ids of its last turn, formatted), start (place of its first token when the tree is emitted depth first,
    every shared turn once), position (position id of its first token: the tokens of its ancestors), ancestors
    (array<struct<start,end>> of emitted intervals that its tokens may attend to besides themselves, in order),
    loss_start and loss_end (its own tokens under the loss mask, none unless an assistant's), and segment and path, which read_back follows. leaves:
    conv_id, node_id and n_turns of each conversation.

    Turns are ordered by turn, then role and text; null roles and texts are empty; rows without a conv_id
    are one conversation with a null id; repeated rows are further turns; other columns are ignored; an empty table
    gives no rows.

    Prefixes are named by sums of turn hashes, which parts of a conversation add to, so that a conversation covers as many tasks as it has rows for. Equal
    ones meet by name, combined before the shuffle, so that a hot first turn is one row from each task. A conversation's key lists
    the nodes that it takes where the tree branches; a node belongs to the least key that has it, and the nodes of one key are a segment: turns
    that follow each other without a branch. Depth first is the order of (key, depth), whose sums number the tokens. Of a node's ancestors each segment is one
    interval, so that rows grow with the branches above a node, not with its depth; no task holds a tree or a conversation."""
    vocabulary = vocabulary or default_vocabulary()
    ordered = materialize(_ordered(turns.select("conv_id", "turn", "role", "text")), "turns")
    named = _named(ordered, materialize(_bases(ordered), "bases"))
    members = materialize(named.select("cid", "depth", "node_id", "parent_id"), "members")
    each = named.groupBy("node_id").agg(*[F.first(c).alias(c) for c in ("parent_id", "depth", "role", "text")])

    def tokenize(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        tokens, starts, ends = [], [], []
        for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            head, body, tail = (encode(s) for s in format_turn(role, text))
            tokens.append(head + body + tail)
            starts.append(len(head) if role == "assistant" else 0)
            ends.append(len(head) + len(body) if role == "assistant" else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.list_(pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["node_id", "parent_id", "depth", "tokens", "loss_start", "loss_end"])

    made = map_batches(each.select("node_id", "parent_id", "depth", "role", "text"), tokenize, "node_id string, parent_id string, depth long, tokens array<int>, loss_start int, loss_end int")
    made = materialize(made.withColumn("n", F.size("tokens").cast("long")), "made")
    # Keys: the first node, and the nodes that follow a branch.
    forks = made.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("k")).where("k > 1").select("parent_id")
    forks = materialize(forks, "forks")  # so that the join splits below a hot first turn
    marks = materialize(made.join(forks, "parent_id", "left_semi").select("node_id").union(made.where("parent_id is null").select("node_id")), "marks")
    keys = members.join(marks, "node_id").groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node_id"))), lambda x: x["node_id"]), "").alias("key"))
    ends = members.groupBy("cid").agg(F.max_by("node_id", "depth").alias("node_id"), F.count("*").alias("n_turns"))
    keys = materialize(keys.join(ends, "cid"), "keys")
    owner = members.join(keys.select("cid", "key"), "cid").groupBy("node_id").agg(F.min("key").alias("segment"))
    slim = made.select("node_id", "depth", "n").join(owner, "node_id").withColumn("tree_id", F.substring("segment", 1, 32))
    slim = materialize(slim.repartitionByRange("segment", "depth").withColumn("part", F.spark_partition_id()), "placed")
    sums = slim.groupBy("tree_id", "part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("tree_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("tree_id", "part", F.coalesce(earlier, F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy("tree_id", "part").orderBy("segment", "depth").rowsBetween(Window.unboundedPreceding, -1))
    places = slim.withColumn("within", F.coalesce(within, F.lit(0))).join(bases, ["tree_id", "part"])
    places = materialize(places.select("tree_id", "node_id", "segment", "depth", "n", (F.col("base") + F.col("within")).alias("start")), "places")
    # The longest conversation of a key passes all segments above its own.
    longest = keys.groupBy("key").agg(F.max_by("cid", F.struct("n_turns", "cid")).alias("cid"))
    passed = members.select("cid", "node_id").join(longest, "cid").join(places.select("node_id", "segment", "depth", "start", "n"), "node_id").where("segment <> key")
    runs = passed.groupBy("key", "segment").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.max("depth").alias("until"))
    above = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "segment", "until"))).alias("above"))
    begins = places.groupBy("segment").agg(F.min("start").alias("begin"))
    begins = materialize(begins.join(above.withColumnRenamed("key", "segment"), "segment", "left"), "segments")
    out = places.drop("n", "depth").join(begins, "segment").join(made.drop("n"), "node_id")
    up = F.coalesce("above", F.array().cast("array<struct<start:bigint,end:bigint,segment:string,until:bigint>>"))
    own = F.when(F.col("start") > F.col("begin"), F.array(F.struct(F.col("begin").alias("start"), F.col("start").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    out = out.withColumn("ancestors", F.concat(F.transform(up, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), own))
    out = out.withColumn("path", F.array_append(F.transform(up, lambda x: F.struct(x["segment"].alias("segment"), x["until"].alias("until"))), F.struct("segment", F.col("depth").alias("until"))))
    position = F.aggregate("ancestors", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    nodes = out.select("tree_id", "node_id", "parent_id", F.col("depth").cast("int").alias("depth"), "tokens", "start", position.alias("position"), "ancestors", "loss_start", "loss_end", "segment", "path")
    return nodes, keys.select(F.when(F.col("cid") != "", F.col("cid").cast("long")).alias("conv_id"), "node_id", "n_turns")


def read_turns(nodes: DataFrame, leaves: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (conv_id, depth, role, text, loss, n_chars): the turns of each conversation, decoded from the emitted tokens of its leaf and of the segments above
    it."""
    vocabulary = vocabulary or default_vocabulary()

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        read = encoder(vocabulary).decode_bytes
        out: list[list] = [[], [], [], []]
        for tokens, a, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            s = read(tokens).decode()
            role, text = parse_turn(s)
            for column, value in zip(out, (role, text, unescape(read(tokens[a:b]).decode()) if b else None, len(s)), strict=True):
                column.append(value)
        columns = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["segment", "depth", "role", "text", "loss", "n_chars"])

    nodes = materialize(nodes, "tree")
    read = map_batches(nodes.select("segment", "depth", "tokens", "loss_start", "loss_end"), decode, "segment string, depth int, role string, text string, loss string, n_chars long")
    wanted = leaves.join(nodes.select("node_id", "path"), "node_id").select("conv_id", F.explode("path").alias("p")).select("conv_id", "p.segment", "p.until")
    return materialize(wanted, "wanted").join(materialize(read, "read"), "segment").where("depth <= until").select("conv_id", "depth", "role", "text", "loss", "n_chars")


def read_back(nodes: DataFrame, leaves: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (conv_id, turns array<struct<depth, role, text, loss, n_chars>>): read_turns with each conversation in one row, for conversations that fit one."""
    row = F.struct("depth", "role", "text", "loss", "n_chars")
    return read_turns(nodes, leaves, vocabulary).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the rows of read_turns: SHA-256 of role, newline, text and newline
    of each turn, and of all text under the loss mask. A digest takes turns one after the other, so that a conversation passes through one task,
    sorted, and is not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, counts = None, None, [0, 0, 0]

        def told() -> pa.RecordBatch:
            columns = ([now], [counts[0]], [digests[0].hexdigest()], [counts[1]], [digests[1].hexdigest()], [counts[2]])
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, role, text, loss, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if digests is None or conv != now:
                    if digests:
                        yield told()
                    now, digests, counts = conv, (hashlib.sha256(), hashlib.sha256()), [0, 0, 0]
                digests[0].update(f"{role}\n{text}\n".encode())
                digests[1].update((loss or "").encode())
                counts = [counts[0] + 1, counts[1] + len(loss or ""), counts[2] + n]
        if digests:
            yield told()

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "role", "text", "loss", "n_chars")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
