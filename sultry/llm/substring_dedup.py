"""Substring deduplication by De Bruijn compaction of repeated token windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, chunks, map_batches, materialize, maybe_in, signed, text_bytes, word_hashes
from .components import connected_components

SPAN = 50


def _least_at(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive values, the leftmost of equal ones."""
    least, at, n = values, np.arange(len(values), dtype=np.int32), 1
    while n < w:
        step = min(n, w - n)
        m = len(least) - step
        later = least[step:] < least[:m]
        least, at, n = np.where(later, least[step:], least[:m]), np.where(later, at[step:], at[:m]), n + step
    return at


def bundles(tokens: np.ndarray, ends: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Edges of the De Bruijn graph, the windows of `span` tokens, in bundles: (doc, first, count, anchor, path).

    A window's anchor is its k-mer (half a window long) of least hash, the leftmost of equal ones. Consecutive
    windows with one anchor occurrence are an unbranched piece of the document's walk. anchor and path are hashes of the
    k-mer and of all tokens that the bundle covers. Equal windows have equal anchors."""
    k = span // 2
    n = len(tokens) - span + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 5
    roll = Rolling(tokens)
    grams = roll.windows(k)
    anchor = _least_at(grams, span - k + 1)
    p = np.arange(n)
    doc = np.searchsorted(ends, p, "right")
    valid = p + span <= ends[doc]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | begins[1:]
    start = np.flatnonzero(begins)
    count = np.flatnonzero(stops) - start + 1
    return doc[start], start, count, signed(grams[anchor[start]]), signed(roll.spans(start, start + count - 1 + span))


def _bundle_rows(docs: DataFrame, span: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2))
        for a, b in chunks([len(t) for t in texts]):
            words = [t.split() for t in texts[a:b]]
            ends = np.cumsum([len(w) for w in words])
            doc, first, count, anchor, path = bundles(word_hashes([w for ws in words for w in ws]), ends, span)
            begin = np.concatenate([[0], ends])[doc]
            columns = (ids[a + doc], keys[a + doc], (first - begin).astype(np.int32), count.astype(np.int32), anchor, path)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "row", "first", "n", "anchor", "path"])

    return map_batches(docs, run, "doc_id long, row long, first int, n int, anchor long, path long")


def _lists(column: pa.ListArray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of a column of lists of structs, and its fields as flat arrays."""
    values = column.flatten()
    lengths = np.diff(column.offsets.to_numpy()) if column.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in column])
    return np.concatenate([[0], np.cumsum(lengths)]), [values.field(values.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _looked_up(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Rows (doc_id, row, kind, anchor, id, nth, first, n, key) read at source coordinates: for kind 0 a digest of the words of a compacted
    path, for kind 1 the hash of each window of a branching bundle. wanted: (row, at array<struct>)."""
    names = ["doc_id", "row", "kind", "anchor", "id", "nth", "first", "n", "key"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2))
        offsets, (kind, anchor, ident, first, n) = _lists(batch.column(3), "kind", "anchor", "id", "first", "n")
        for a, b in chunks([len(t) for t in texts], 1 << 21):
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i in range(a, b):
                words, at = texts[i].split(), np.arange(offsets[i], offsets[i + 1])
                whole, parts = at[kind[at] == 0], at[kind[at] == 1]
                digests = [hashlib.blake2b(b" ".join(words[first[k] : first[k] + n[k] - 1 + span]), digest_size=8).digest() for k in whole]
                key = np.frombuffer(b"".join(digests), np.int64)
                each = np.repeat(parts, n[parts])
                nth = np.arange(len(each)) - np.repeat(np.cumsum(n[parts]) - n[parts], n[parts])
                if len(each):
                    start = first[each] + nth
                    key = np.concatenate([key, signed(Rolling(word_hashes(words)).spans(start, start + span))])
                both = np.concatenate([whole, each]).astype(np.int64)
                row = (np.full(len(both), ids[i]), np.full(len(both), keys[i]), kind[both], anchor[both], ident[both], np.concatenate([np.zeros(len(whole), np.int64), nth]), first[both], n[both], key)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            columns = [pa.array(np.concatenate(x)).cast(t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    # Rows that repeat a document are read alike, and count once.
    joined = docs.join(wanted, "row").select("doc_id", "row", "text", "at")
    return map_batches(joined, run, "doc_id long, row long, kind int, anchor long, id long, nth int, first int, n int, key long")


def compacted_paths(occurrences: DataFrame) -> DataFrame:
    """Maximal nonbranching paths of repeated bundles as rows (row, id, first, n).

    occurrences: (row, first, n, anchor, total) of unbranched anchors. Two anchors are linked where each always
    follows the other; chains of links become one path by joins, named by its least anchor, and each
    occurrence of a path becomes one span of its document."""
    here = occurrences.select("row", (F.col("first") + F.col("n")).alias("next"), F.col("anchor").alias("a"), F.col("total").alias("ta"))
    there = occurrences.select("row", F.col("first").alias("next"), F.col("anchor").alias("b"), F.col("total").alias("tb"))
    steps = here.join(there, ["row", "next"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    links = materialize(steps.where("n = ta and n = tb and a <> b").select("a", "b"), "unary")
    names = connected_components(links).select(F.col("node").alias("anchor"), F.col("component").alias("id"))
    inner = links.select(F.col("b").alias("anchor"), F.lit(True).alias("inner"))
    # One join with a row for each anchor, which splits where an anchor has many occurrences.
    chained = materialize(names.join(inner, "anchor", "left"), "chained")
    named = occurrences.join(chained, "anchor", "left")
    heads = F.count_if(F.col("inner").isNull()).over(Window.partitionBy("row").orderBy("first"))
    named = named.select("row", "first", "n", F.coalesce("id", "anchor").alias("id"), heads.alias("span"))
    return named.groupBy("row", "span").agg(F.first("id").alias("id"), F.min("first").alias("first"), F.sum("n").cast("int").alias("n")).drop("span")


def repeated_windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows (row, first, n, mask): runs of n windows from word `first` on, of which those whose bit is set in mask (all where it is null)
    also start in a document with a smaller id. docs: doc_id, row, text; row stands for an id and a text.

    Bundles of windows meet on their anchor; anchors of a single document end there. Equal bundles of an anchor are one edge
    of the graph, known by its least document. An anchor with one edge only is unbranched: consecutive ones
    compact into long paths, each verified by a digest of its words at its source coordinates. At the other anchors
    the windows of each edge are looked up once, where its least document has them, and meet by hash, so
    that an edge learns the least document of each of its windows, and its other occurrences from it.

    What all occurrences of an anchor share is aggregated in each task first and written; occurrences only ever meet one row for their anchor in a
    join, whose larger side Spark splits where an anchor is hot (it cannot where the other side is an aggregate of the same stage)."""
    rows = materialize(_bundle_rows(docs, span), "bundles")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = materialize(shared, "shared")
    # Dealt by document, not by anchor, rows that repeat a document go.
    met = materialize(rows.join(shared, "anchor").repartition("row", "first").dropDuplicates(["row", "first"]), "met")
    edges = met.groupBy("anchor", "path").agg(F.min(F.struct("doc_id", "row", "first")).alias("rep"), F.count("*").alias("total"), F.first("n").alias("n"))
    edges = materialize(edges, "edges")
    branching = materialize(edges.groupBy("anchor").agg((F.count("*") > 1).alias("branching"), F.sum("total").alias("total")), "anchors")
    met = materialize(met.join(branching, "anchor"), "kinds")
    paths = compacted_paths(met.where("not branching"))
    reps = edges.join(branching.where("branching").select("anchor"), "anchor").select(F.col("rep.row").alias("row"), F.struct(F.lit(1).alias("kind"), "anchor", F.col("path").alias("id"), F.col("rep.first").alias("first"), "n").alias("w"))
    wanted = paths.select("row", F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor"), "id", "first", "n").alias("w")).union(reps)
    wanted = materialize(wanted.groupBy("row").agg(F.collect_list("w").alias("at")), "wanted")
    there = maybe_in(docs, "row", wanted).where("maybe_").drop("maybe_")
    found = materialize(_looked_up(there, wanted, span), "looked")
    spans = found.where("kind = 0")
    least = spans.groupBy("id", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    least = materialize(least, "least")
    whole = spans.join(least, ["id", "key"]).where("doc_id > lo").select("row", "first", "n", F.lit(None).cast("long").alias("mask"))
    windows = found.where("kind = 1").select("doc_id", "anchor", F.col("id").alias("path"), "nth", "key")
    lows = windows.groupBy("anchor", "key").agg(F.min("doc_id").alias("lo"))
    known = windows.join(lows, ["anchor", "key"]).groupBy("anchor", "path", "nth").agg(F.min("lo").alias("lo"))
    known = materialize(known.groupBy("anchor", "path").agg(F.collect_list(F.struct("nth", "lo")).alias("los")), "known")
    each = met.where("branching").join(known, ["anchor", "path"])
    bits = F.aggregate(F.filter("los", lambda x: x["lo"] < F.col("doc_id")), F.lit(0).cast("long"), lambda acc, x: acc + F.pow(F.lit(2.0), x["nth"]).cast("long"))
    return whole.union(each.select("row", "first", "n", bits.alias("mask")).where("mask > 0")).distinct()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each document without the words covered by a window of `span`
    consecutive words that also starts in a document with a smaller doc_id; kept words are joined by one space.

    Windows are judged on the input. Null and empty texts have no words; a text shorter than a window loses none;
    rows with null ids are returned whole; rows that repeat a doc_id and its text all lose the same; a doc_id with several texts
    is several documents, none of which has the smaller id, and each row loses words of its own text; an empty table gives no rows; other columns are ignored. A passage that many documents share
    meets by grouped minima and joins on its hash, never as pairs. Documents that surely lose nothing are not shuffled."""
    if span > 126:
        raise ValueError("a bundle's windows are a mask of 63 bits")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim = slim.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "text")
    gone = repeated_windows(slim.where("doc_id is not null"), span)
    cuts = materialize(gone.groupBy("row").agg(F.collect_list(F.struct("first", "n", F.coalesce("mask", F.lit(-1)).alias("mask"))).alias("cuts")), "cuts")
    no_cuts = F.array().cast("array<struct<first:int,n:int,mask:bigint>>")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = text_bytes(batch.column(1))
        offsets, (first, n, mask) = _lists(batch.column(2), "first", "n", "mask")
        for a, b in chunks([len(t) for t in texts]):
            out: list[list] = [[], [], []]
            for i in range(a, b):
                words, at = texts[i].split(), slice(offsets[i], offsets[i + 1])
                f, m, bits = first[at].astype(np.int64), n[at].astype(np.int64), mask[at]
                edge = np.zeros(len(words) + 1, np.int64)
                some = bits >= 0
                starts, lasts = f[~some], f[~some] + m[~some] - 1 + span
                if some.any():
                    row, j = np.nonzero((bits[some][:, None] >> np.arange(63)) & 1)
                    starts, lasts = np.concatenate([starts, f[some][row] + j]), np.concatenate([lasts, f[some][row] + j + span])
                np.add.at(edge, np.minimum(starts, len(words)), 1)
                np.add.at(edge, np.minimum(lasts, len(words)), -1)
                lost = (np.cumsum(edge)[:-1] > 0).tolist()
                kept = [w for w, x in zip(words, lost, strict=True) if not x]
                for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                    column.append(value)
            kept = pa.array(out[2], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])

    marked = maybe_in(slim.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.col("row"))), "row", cuts)
    cut = marked.where("maybe_").join(cuts, "row", "left").select("doc_id", "text", F.coalesce("cuts", no_cuts).alias("cuts"))
    rest = marked.where("not maybe_").select("doc_id", "text", no_cuts.alias("cuts"))
    return map_batches(cut.union(rest), run, "doc_id long, n_words long, n_removed long, kept string")
