"""Packing by non-negative least squares over combinations of lengths."""

from __future__ import annotations

import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, text_bytes
from .packing import offset_of, sequence_of, with_slots

CAPACITY = 4096
END = 2
#: A combination has a longest length any number of times, then another up to REPEATS times or two others, one of them among the most frequent: as many of
#: these as give about TRIED combinations to look at.
REPEATS, TRIED = 3, 200_000
ITERATIONS = 200

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of a vocabulary of lower-case words whose merges never span white space, from a memory of the ids of the words seen.

    White space is dropped before merging, so that a text's ids are those of its runs without ASCII white space. New words of letters that
    lower case alone normalises go piece by piece to the merges of tiktoken, with END_OF_WORD as the mark of a word's end, which gives the same ids faster;
    all others go to the tokenizers library. Long runs are not remembered; the memory is emptied when it has grown to MOST words."""

    MOST, LONG = 400_000, 100
    #: A byte that UTF-8 never has.
    END_OF_WORD = b"\xff"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        with open(path) as f:
            whole = json.load(f)
        # Bytes stand in the vocabulary as printable characters: themselves, or the next from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        bytes_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in whole["added_tokens"]}
        ranks = {}
        for token, i in whole["model"]["vocab"].items():
            if token not in special:
                last = token.endswith("</w>") and len(token) > 4
                ranks[bytes(bytes_of[c] for c in (token[:-4] if last else token)) + self.END_OF_WORD * last] = i
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def _fast(self, word: bytes) -> bytes | None:
        """The ids of a printable word without letters that composing or lowering changes otherwise; None for others."""
        text = word.decode("utf-8", "replace")
        if not text.isascii() and max(text) >= "\u0250" or not text.isprintable() or "\u0130" in text or "<|" in text or len(word) > self.LONG:
            return None
        low = text.lower()
        if low.isalpha():
            return array("I", self.merge(low.encode() + self.END_OF_WORD)).tobytes()
        return array("I", [i for p in self.pieces(low) for i in self.merge(p.encode() + self.END_OF_WORD)]).tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit values."""
        words = text.split()
        if len(self.known) > self.MOST:
            self.known = {}
        new = {w: self._fast(w) for w in set(words).difference(self.known)}
        slow = [w for w, ids in new.items() if ids is None]
        if slow:
            found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in slow], add_special_tokens=False)
            new.update((w, array("I", e.ids).tobytes()) for w, e in zip(slow, found, strict=True))
        long = {w: ids for w, ids in new.items() if len(w) > self.LONG}
        self.known.update((w, ids) for w, ids in new.items() if w not in long)
        return b"".join(map(self.known.__getitem__, words) if not long else [long[w] if w in long else self.known[w] for w in words])


def word_encoder(path: str) -> WordEncoder:
    """The vocabulary at `path`, once a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def window_pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, part, nth): the ids of each text followed by END, in windows of `capacity` and what is left over.
    nth counts the pieces of one length within the task `part`."""
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = word_encoder(vocabulary).encode, TaskContext.get().partitionId(), Counter()
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "part": pa.int32(), "nth": pa.int64()}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in chunks([len(t) for t in texts]):
                out = defaultdict(list)
                for i in range(a, b):
                    tokens = encode(texts[i]) + end
                    n = len(tokens) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        for name, value in zip(kinds, (ids[i], start, length, tokens[4 * start : 4 * (start + length)], n, part, seen[length]), strict=True):
                            out[name].append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in kinds.items()})

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, part int, nth long")


def combinations(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and repeats, three of each a row (0 where unused), of the shallow combinations that fill `capacity` exactly and that the histogram can
    pay for at least once: a longest length m times, and beside it nothing, another length up to REPEATS times, or two others, one of them common."""
    lengths = np.array(sorted(histogram), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    count[lengths] = [histogram[n] for n in lengths.tolist()]
    times = np.minimum(capacity // lengths, count[lengths])
    a = np.repeat(lengths, times)
    m = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + 1
    left = capacity - a * m
    none = np.zeros_like(a)
    parts = [np.stack([a, none, none, m, none, none], 1)[left == 0]]
    for k in range(1, REPEATS + 1):
        b = left // k
        good = (left > 0) & (left % k == 0) & (b < a) & (count[b] >= k)
        parts.append(np.stack([a, b, none, m, none + k, none], 1)[good])
    for c in sorted(histogram, key=lambda n: (-histogram[n], n))[: max(1, TRIED // len(a))]:
        b = np.maximum(left - c, 0)
        good = (b > 0) & (b < a) & (c < a) & (b != c) & (count[b] >= 1)
        parts.append(np.stack([a, b, none + c, m, none + 1, none + 1], 1)[good])
    rows = np.concatenate(parts)
    # The two shorter lengths of a row in order, so that no combination comes twice.
    turned = (rows[:, 2] > rows[:, 1])[:, None]
    rows = np.unique(np.where(turned, rows[:, [0, 2, 1, 3, 5, 4]], rows), axis=0) if len(rows) else rows.reshape(0, 6)
    return rows[:, :3], rows[:, 3:]


def repeat_counts(lengths: np.ndarray, repeats: np.ndarray, target: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """The non-negative x that minimises the squares of (repeats of each length in x combinations - target[length]), by accelerated projected
    gradient steps on columns of unit norm."""
    norm = np.sqrt((repeats**2).sum(axis=1))
    weight = repeats / norm[:, None]
    forward = lambda y: np.bincount(lengths.ravel(), (weight * y[:, None]).ravel(), len(target))
    back = lambda r: (weight * r[lengths]).sum(axis=1)
    # The largest eigenvalue by power iteration gives the step.
    y = np.ones(len(lengths))
    for _ in range(20):
        y = back(forward(y))
        y /= np.linalg.norm(y)
    step = 1 / (1.05 * np.linalg.norm(back(forward(y))))
    x = ahead = np.zeros(len(lengths))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0, ahead - step * back(forward(ahead) - target))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, x = new + (before - 1) / t * (new - x), new
    return x / norm


def plan_nnls(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int, int | None]], int, int]:
    """(plan, sequences, rest): rows (length, first, last, seq, per, offset, base), the number of sequences that combinations fill, and the
    number of tokens that they leave.

    Pieces ranked first to last (exclusive) of a length go to sequences seq, seq + 1, ..., `per` to each. The counts of the least
    squares solution are rounded down, then up where pieces remain, and then combinations take what they still can. What remains has base, its
    place in a stream of tokens that is cut where a sequence is full. Everything depends on the histogram of at most `capacity` lengths."""
    if not histogram:
        return [], 0, 0
    lengths, repeats = combinations(histogram, capacity)
    target = np.zeros(capacity + 1)
    for n, k in histogram.items():
        target[n] = k
    left = Counter(histogram)
    used: Counter[int] = Counter()
    if len(lengths):
        x = repeat_counts(lengths, repeats, target)
        order = np.argsort(-x, kind="stable")
        rows = [[(n, r) for n, r in zip(ls, rs, strict=True) if r] for ls, rs in zip(lengths.tolist(), repeats.tolist(), strict=True)]
        whole, up = np.floor(x + 1e-6).astype(np.int64), np.ceil(x - 1e-2).astype(np.int64)
        for wanted in (whole, up, None):
            for i in order.tolist():
                most = min(left[n] // r for n, r in rows[i])
                take = most if wanted is None else min(most, int(wanted[i]) - used[i])
                if take > 0:
                    used[i] += take
                    for n, r in rows[i]:
                        left[n] -= r * take
    plan, sequences, rank = [], 0, Counter()
    for i, n in used.items():
        offset = 0
        for length, r in rows[i]:
            plan.append((length, rank[length], rank[length] + r * n, sequences, r, offset, None))
            rank[length] += r * n
            offset += r * length
        sequences += n
    rest = 0
    for length in sorted(left, reverse=True):
        if left[length]:
            plan.append((length, rank[length], rank[length] + left[length], 0, 1, 0, rest))
            rest += length * left[length]
    return plan, sequences, rest


def nnls_pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset): every token of all documents once, in sequences of at most `capacity`
    tokens, without gaps from offset 0. All sequences but the last few are full, and these have a power of two of tokens each, so that nothing is padded.

    Texts are tokenised once and written to the shared folder in windows of `capacity`. Their histogram, at most `capacity` counts, reaches the
    driver, where combinations of lengths that fill a sequence are enumerated and least squares say how often to use each. Pieces take the planned slots
    by their rank within their length, in a join. Pieces that no combination takes form one stream in order of length, which is cut
    greedily: wherever a sequence is full, and at the end into powers of two. A piece is cut there only, so that few documents are.

    Null and empty texts are one END token; repeated rows and null ids are packed like others; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    pieces = materialize(window_pieces(docs, doc_id, text, vocabulary or word_vocabulary(), capacity), "windows")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, sequences, rest = plan_nnls(histogram, capacity)
    plan = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0, None)], "length long, first_ long, last_ long, seq_ long, per_ long, offset_ long, base_ long")
    placed = with_slots(pieces, counts, plan.withColumnRenamed("base_", "stream_"))
    # Where the stream is cut at its end: the binary digits of what does not fill a sequence.
    bounds = [rest - rest % capacity]
    for bit in reversed(range(capacity.bit_length())):
        if rest % capacity >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    ends = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.col("slot_.stream_") + (F.col("rank_") - F.col("slot_.first_")) * F.col("length")
    placed = placed.withColumn("from_", at).withColumn("to_", at + F.col("length"))
    full = (F.floor(F.col("from_") / capacity) + 1).cast("long") * capacity
    inside = lambda b: (b > F.col("from_")) & (b < F.col("to_"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("from_"), F.filter(F.concat(F.when(full < bounds[0], F.array(full)).otherwise(F.array().cast("array<bigint>")), ends), inside), F.array("to_"))))
    cuts = F.when(F.col("from_").isNull(), F.array(F.lit(0).cast("long"), F.col("length"))).otherwise(cuts)
    segments = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = placed.withColumn("s_", F.explode(segments(cuts)))
    a, n = F.col("s_.a"), F.col("s_.b") - F.col("s_.a")
    skip = a - F.coalesce("from_", F.lit(0))
    last = F.size(F.filter(ends, lambda b: b <= a)) - 1  # which of the last sequences
    stream_seq = sequences + F.when(a < bounds[0], F.floor(a / capacity)).otherwise(bounds[0] // capacity + last).cast("long")
    stream_offset = F.when(a < bounds[0], a % capacity).otherwise(a - F.element_at(ends, F.greatest(last, F.lit(0)) + 1))
    rank, streamed = F.col("rank_"), F.col("from_").isNotNull()
    return cut.select(
        "doc_id",
        (F.col("start") + skip).alias("start"),
        n.alias("length"),
        F.expr("substring(ids, cast(4 * (s_.a - coalesce(from_, 0)) + 1 as int), cast(4 * (s_.b - s_.a) as int))").alias("ids"),
        "doc_tokens",
        F.when(streamed, stream_seq).otherwise(sequence_of(rank)).alias("sequence_id"),
        F.when(streamed, stream_offset).otherwise(offset_of(rank)).alias("offset"),
    )
