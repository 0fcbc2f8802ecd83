"""Sharding by histogram sort. Native: DataFrame functions only."""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_LOWEST = -(1 << 63)
#: A range within a shard has about so many bytes, up to MOST_PARTS ranges a shard; larger ones spill when sorted.
RANGE_BYTES, MOST_PARTS = 128 << 20, 512


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _pair(position: int) -> tuple[int, int]:
    """Key and tie of a place in the order, a 128-bit number."""
    return (position >> 64) + _LOWEST, (position & ((1 << 64) - 1)) + _LOWEST


def _position(key: int, tie: int) -> int:
    return ((key - _LOWEST) << 64) + tie - _LOWEST


def _bucket(edges: list[int]) -> Column:
    """How many of the sorted edges are at most (key_, tie_): first among every 64th of them, then among the 64 that follow."""
    if not edges:
        return F.lit(0)
    table = lambda xs: F.from_json(F.lit(json.dumps([dict(zip("kt", _pair(x), strict=True)) for x in xs])), "array<struct<k:bigint,t:bigint>>")
    below = lambda xs: F.size(F.filter(xs, lambda e: (e["k"] < F.col("key_")) | ((e["k"] == F.col("key_")) & (e["t"] <= F.col("tie_")))))
    if len(edges) <= 64:
        return below(table(edges))
    coarse = F.greatest(below(table(edges[::64])) - 1, F.lit(0))
    return F.transform(F.array(coarse), lambda c: c * 64 + below(F.slice(table(edges), c * 64 + 1, F.lit(64))))[0]


def find_splitters(keyed: DataFrame, targets: list[float], slack: list[float], probes: int = 7) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """For each target the place in the order of (key_, tie_) with the nearest number of bytes in rows before it, within its
    slack where the rows allow; and the exact (bytes, rows) before each place ever counted.

    keyed: key_ bigint, tie_ bigint, size_ bigint. Every round counts the bytes and rows between all open probes in one
    aggregation, with the least and greatest place there, so the driver only gets one row for each probe, and each open bracket shrinks by the number
    of probes and to the rows in it, until its target is met or the bracket holds rows of one place only."""
    ends = lambda: (F.min(F.struct("key_", "tie_")), F.max(F.struct("key_", "tie_")))
    low, high, *total = keyed.agg(*ends(), F.sum("size_"), F.count("*")).first()
    if low is None:
        return [0] * len(targets), {}
    known: dict[int, tuple[int, int]] = {_position(*low): (0, 0), _position(*high) + 1: tuple(total)}
    first = True
    while True:
        edges = sorted(known)
        ask: set[int] = set()
        for t, s in zip(targets, slack, strict=True):
            i = bisect_left(edges, t, key=lambda e: known[e][0])
            a, b = edges[max(0, i - 1)], edges[min(i, len(edges) - 1)]
            if min(abs(known[a][0] - t), abs(known[b][0] - t)) <= s or b - a <= 1:
                continue
            n = max(probes, 4 * len(targets)) if first else probes
            ask |= {x for j in range(1, n + 1) if a < (x := a + (b - a) * j // (n + 1)) < b}
            # The same probes with their ties left out, so that keys without ties are met at their own place.
            ask |= {x for j in range(1, n + 1) if a < (x := a + (b - a) * j // (n + 1) >> 64 << 64) < b} or {(a + b) // 2}
        ask -= known.keys()
        first = False
        if not ask:
            break
        order = sorted(ask)
        rows = keyed.groupBy(_bucket(order).alias("b")).agg(*ends(), F.sum("size_"), F.count("*")).collect()
        got = {r[0]: r for r in rows}
        size = count = 0
        for j in range(len(order) + 1):
            if j:
                known[order[j - 1]] = (size, count)
            if j in got:
                _, least, most, more, many = got[j]
                known[_position(*least)] = (size, count)
                size, count = size + more, count + many
                known[_position(*most) + 1] = (size, count)
    edges = sorted(known)
    chosen = []
    for t in targets:
        i = bisect_left(edges, t, key=lambda e: known[e][0])
        near = [e for e in (edges[max(0, i - 1)], edges[min(i, len(edges) - 1)])]
        chosen.append(min(near, key=lambda e: (abs(known[e][0] - t), e)))
    return chosen, known


def _with_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """Adds key_ and, as the order of equal keys, tie_: a hash of the text, and of nonce_ where there is one."""
    tie = F.xxhash64(F.coalesce(text, F.lit("")), *[c for c in ("nonce_",) if c in df.columns])
    return df.withColumn("key_", F.coalesce(F.col(key).cast("bigint"), F.lit(_LOWEST))).withColumn("tie_", tie)


def histogram_sort(df: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", tolerance: float = 0.001, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The input's rows and columns plus shard (0 to n_shards - 1) and slot (gapless from 0 in each shard, in
    order of the key); shards hold near equal bytes.

    Histogram sort: a narrow (key, tie, bytes) table is written once; exact bytes below candidate boundaries are
    counted over all partitions, and the probes are refined until each splitter is within `tolerance` of a
    shard's bytes. Each shard is cut by further splitters into ranges of about `range_bytes` (8 to MOST_PARTS a shard), whose row counts are
    then known exactly, so one exchange by range suffices and no task holds a whole shard. Null keys
    sort first; rows of one key are ordered by a hash of the text, so that a key or null ids with many texts split between shards. Where so many rows agree in
    key and text that a splitter is missed, the rows are written to the shared folder with a number each, and that
    breaks the ties. Null texts count 8 bytes; an empty table gives no rows. Columns shard, slot, key_, tie_, range_ and nonce_ are replaced."""
    df = df.drop("shard", "slot", "key_", "tie_", "range_", "nonce_")
    columns = df.columns

    def split(df: DataFrame) -> tuple[DataFrame, list[int], dict[int, tuple[int, int]], int, bool]:
        keyed = materialize(_with_keys(df, key, text).select("key_", "tie_", text_size(F.col(text)).alias("size_")), "keys")
        total = keyed.agg(F.sum("size_")).first()[0] or 0
        parts = min(MOST_PARTS, max(8, -(-total // (n_shards * range_bytes))))
        n = n_shards * parts
        targets = [total * i / n for i in range(1, n)]
        share = total / n_shards
        # No row can be cut, and rows are small beside a shard of any size that matters.
        slack = [share * tolerance if i % parts == 0 else share / parts / 4 for i in range(1, n)]
        chosen, known = find_splitters(keyed, targets, slack)
        largest = keyed.agg(F.max("size_")).first()[0] or 0
        missed = any(i % parts == 0 and abs(known[e][0] - t) > max(s, largest) for i, (e, t, s) in enumerate(zip(chosen, targets, slack, strict=True), 1) if known)
        return df, chosen, known, parts, missed

    df, chosen, known, parts, missed = split(df)
    if missed:
        df, chosen, known, parts, _ = split(materialize(df.withColumn("nonce_", F.monotonically_increasing_id()), "numbered"))
    starts = [i // parts for i in range(len(chosen) + 1)]
    offsets = [0, *(known[e][1] if known else 0 for e in chosen)]
    first_of: dict[int, int] = {}
    for s, o in zip(starts, offsets, strict=True):
        first_of.setdefault(s, o)
    base = [o - first_of[s] for s, o in zip(starts, offsets, strict=True)]
    ranged = _with_keys(df, key, text).withColumn("range_", _bucket(chosen))
    at = F.col("range_") + 1
    ordered = Window.partitionBy("range_").orderBy("key_", "tie_")
    literal = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), kind)
    return (
        ranged.withColumn("shard", F.element_at(literal(starts, "array<int>"), at))
        .withColumn("slot", F.row_number().over(ordered) - 1 + F.element_at(literal(base, "array<bigint>"), at))
        .select(*columns, "shard", "slot")
    )
