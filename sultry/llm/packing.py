"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, map_batches, materialize

CAPACITY = 1024
END = 2
#: The slots of tasks and lengths are broadcast up to so many bytes of runs (32 each) and keys, else joined by shuffle.
BROADCAST_BYTES = 64 << 20

#: A run of blanks from which on the fast tokenizer may run out of stack.
LONG_BLANK = re.compile(r"\s{50000}")

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE vocabulary in two engines with the same ids: tiktoken, and the tokenizers library for texts whose
    runs of blanks are too long for the backtracking of the first."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.replace(".json", ".tiktoken"), "rb"))}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def _slow(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        self.slow = self.slow or Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, special tokens in it included."""
        if len(text) >= 50_000 and LONG_BLANK.search(text):
            return self._slow(text)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def encode_ordinary(self, text: str) -> list[int]:
        """The ids of a text that holds no special token."""
        if len(text) >= 50_000 and LONG_BLANK.search(text):
            return self._slow(text).tolist()
        return self.fast.encode_ordinary(text)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)


def encoder(path: str) -> Encoder:
    """The byte-level BPE vocabulary at `path` (its .tiktoken twin beside the .json), once a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, part, nth): the token ids of each text followed by END, cut
    into pieces of `capacity` where longer, the first piece taking what is left over. ids are little-endian
    unsigned 32-bit values. nth counts the pieces of one length within the task `part`."""
    vocabulary = vocabulary or default_vocabulary()
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(vocabulary).encode, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([4 * len(t or "") for t in texts]):
                out = defaultdict(list)
                for i in range(a, b):
                    tokens = (encode(texts[i]).astype("<u4").tobytes() if texts[i] else b"") + end
                    n = len(tokens) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        length = cuts[k + 1] - cuts[k]
                        for name, value in (("doc_id", ids[i]), ("piece", k), ("start", cuts[k]), ("length", length), ("ids", tokens[4 * cuts[k] : 4 * cuts[k + 1]]), ("part", part), ("nth", seen[length])):
                            out[name].append(value)
                        seen[length] += 1
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "part": pa.int32(), "nth": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in kinds.items()})

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows (length, first, last, sequence, offset) say that
    pieces of that length ranked first to last (exclusive) go to sequences sequence, sequence + 1, ... at offset.

    Sequences filled alike are one group. The longest length is placed first, into the tightest group that it fits: as
    the sequence just used is then the tightest, each takes as many pieces as fit before the next does. Work and rows depend on
    the number of different lengths, not on the number of documents."""
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: runs of (first sequence, count)
    free: list[int] = []
    plan, opened = [], 0

    def add(space: int, first: int, count: int) -> None:
        if space and count:
            if not groups[space]:
                insort(free, space)
            groups[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(free, length)
            if i < len(free):
                space = free[i]
                first, count = groups[space].pop()
                if not groups[space]:
                    free.pop(i)
            else:
                space = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            per = space // length
            full = min(left // per, count)
            rest = left - full * per if full < count else 0
            for sequence, n, held in ((first, full, per), (first + full, 1, rest)):
                if n and held:
                    for j in range(held):
                        plan.append((length, rank + j * n, rank + (j + 1) * n, sequence, capacity - space + j * length))
                    add(space - held * length, sequence, n)
                    rank, left = rank + n * held, left - n * held
            used = full + (rest > 0)
            add(space, first + used, count - used)
    return plan


def with_slots(pieces: DataFrame, counts: DataFrame, plan: DataFrame) -> DataFrame:
    """The pieces with rank_, their number within their length, and slot_, the row of the plan (length, first_, last_, ...) whose ranks hold it.

    `counts` has n pieces for each length and task (part). A piece's rank is its number within its task plus the counts of earlier tasks. No
    piece is shuffled unless the slots outgrow BROADCAST_BYTES."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"), "n")
    # A task's pieces of one length hold consecutive ranks; cut these runs by the plan's before meeting the pieces.
    overlap = (F.col("first_") < F.col("base_") + F.col("n")) & (F.col("last_") > F.col("base_"))
    slot = F.struct(*[c for c in plan.columns if c != "length"])
    # The plan's rows depend on the number of lengths, of which there are at most as many as a sequence has tokens.
    runs = bases.join(F.broadcast(plan), "length").where(overlap)
    runs = runs.groupBy("length", "part").agg(F.first("base_").alias("base_"), F.array_sort(F.collect_list(slot)).alias("runs_"))
    runs = materialize(runs, "slots")
    if (runs.agg(F.sum(8 * len(plan.columns) * F.size("runs_") + 48)).first()[0] or 0) <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    ranked = pieces.join(runs, ["length", "part"]).withColumn("rank_", F.col("base_") + F.col("nth"))
    holds = F.filter("runs_", lambda r: (r["first_"] <= F.col("rank_")) & (F.col("rank_") < r["last_"]))[0]
    return ranked.withColumn("slot_", holds).drop("runs_", "base_")


def sequence_of(rank: F.Column, slot: str = "slot_") -> F.Column:
    """The sequence of a ranked piece in its slot."""
    return F.expr(f"{slot}.seq_") + F.floor((rank - F.expr(f"{slot}.first_")) / F.expr(f"{slot}.per_")).cast("long")


def offset_of(rank: F.Column, slot: str = "slot_") -> F.Column:
    """The offset of a ranked piece in its sequence: so many pieces of its length come before it in the slot."""
    return F.expr(f"{slot}.offset_") + F.pmod(rank - F.expr(f"{slot}.first_"), F.expr(f"{slot}.per_")) * F.col("length")


def best_fit_pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, sequence_id, offset): all documents' pieces packed into few
    sequences of at most `capacity` tokens, without gaps from offset 0.

    The pieces are tokenised once and written to the shared folder. Only their histogram, at most `capacity`
    counts, reaches the driver, where best-fit decreasing runs over counts. A piece's rank within its length is
    its number within its task plus the counts of earlier tasks; the plan's slots join on length and rank. No
    piece is shuffled unless the slots outgrow BROADCAST_BYTES. Null and empty texts are one END token;
    repeated rows and null ids are packed like others; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, doc_id, text, vocabulary, capacity), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity) or [(0, 0, 0, 0, 0)], "length long, first_ long, last_ long, seq_ long, offset_ long").withColumn("per_", F.lit(1))
    rank = F.col("rank_")
    return with_slots(pieces, counts, plan).select("doc_id", "piece", "start", "length", "ids", sequence_of(rank).alias("sequence_id"), offset_of(rank).alias("offset"))
