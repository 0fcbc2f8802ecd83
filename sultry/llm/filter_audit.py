"""Filter interaction audit: what each order of five document filters removes, from additive counts of failure masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Counters of the sketch for each text, hash functions, and the most counters: a sketch of 2^27 bits is 2^21 rows of 64, whatever the number of texts.
COUNTERS, HASHES, MOST_COUNTERS = 16, 2, 1 << 27
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"


def text_flags(texts: DataFrame) -> DataFrame:
    """Adds mask_: bits 0 to 3 for the filters A to D that text_, which goes, fails. Each whole text is looked at once, where it is read."""
    names = [c for c in texts.columns if c != "text_"]
    slim = texts.select(*names, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for t in text_bytes(batch.column(batch.num_columns - 1)):
                words = t.split()
                points = len(t) if t.isascii() else len(t.decode())
                capitals = len(t) - len(t.translate(None, _CAPITALS))
                masks.append(
                    (len(words) < LEAST_WORDS)
                    + 2 * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
                    + 4 * (100 * capitals > MOST_CAPITALS * points)
                    + 8 * (len(t.translate(None, _SIGNS)) < len(t))
                )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(masks, pa.int32())], [*names, "mask_"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{fields}, mask_ int")


def _slots(counters: int) -> list[Column]:
    """The counters that a text adds to: one for each hash function."""
    return [F.pmod(F.xxhash64("hash_", F.lit(i)), F.lit(counters)) for i in range(HASHES)]


def repeat_sketch(hashes: DataFrame, counters: int) -> DataFrame:
    """Rows (word, bits) of the merged counting sketch: bit i of word w is set where counter 64 * w + i is two or more. Tasks count their own
    texts first and the counts are summed, so that copies of one text move once a task."""
    counts = hashes.select(F.explode(F.array(*_slots(counters))).alias("at")).groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    return counts.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def possible_repeats(rows: DataFrame, sketch: DataFrame, counters: int) -> DataFrame:
    """The rows whose counters are all two or more. The others' texts are unique for sure. The sketch has at most MOST_COUNTERS / 64 rows."""
    kept = rows
    for i, slot in enumerate(_slots(counters)):
        words = sketch.select(F.col("word").alias(f"word{i}_"), F.col("bits").alias(f"bits{i}_"))
        kept = kept.withColumn("at_", slot).withColumn(f"word{i}_", (F.col("at_") / 64).cast("long"))
        kept = kept.join(F.broadcast(words), f"word{i}_").where(F.getbit(f"bits{i}_", (F.col("at_") % 64).cast("int")) == 1)
    return kept.select(*rows.columns)


def first_copies(texts: DataFrame, doc_id: str) -> DataFrame:
    """Rows (hash_, text_, least) of the texts, whole, that occur twice or more, with their least id. text_ is null where it is the only text with its
    hash, as then the hash stands for it. Tasks reduce their own copies before texts are shuffled."""
    groups = texts.groupBy("hash_", "text_").agg(F.min(doc_id).alias("least"), F.count("*").alias("n"))
    groups = materialize(groups, "groups")
    shared = groups.groupBy("hash_").agg(F.count("*").alias("texts")).where("texts > 1").select("hash_", F.lit(True).alias("shared"))
    return groups.where("n > 1").join(shared, "hash_", "left").select("hash_", F.when(F.col("shared"), F.col("text_")).alias("text_"), "least")


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", digest: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """Rows (id_, part_, mask), one for each document: bits 0 to 4 for the filters A to E that it fails.

    A counting Bloom sketch over the hashes of all texts, summed over tasks, clears the texts that are surely unique; only the whole texts of
    the others are shuffled, grouped, and give the exact least id of each. Ids above it fail E. The sketch has COUNTERS counters for each text up to
    MOST_COUNTERS; a fuller one clears fewer texts, with the same result."""
    texts = docs.select(F.col(doc_id).alias("id_"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    texts = texts.withColumn("hash_", digest("text_"))
    rows = materialize(text_flags(texts), "flags")
    counters = min(MOST_COUNTERS, 1 << max(10, (COUNTERS * rows.count() - 1).bit_length()))
    sketch = materialize(repeat_sketch(rows.select("hash_"), counters), "sketch")
    least = materialize(first_copies(possible_repeats(texts.select("id_", "text_", "hash_"), sketch, counters), "id_"), "first")
    alone, clash = least.where("text_ is null").drop("text_"), least.where("text_ is not null")
    fails = lambda df: df.select("id_", "part_", (F.col("mask_") + F.when(F.col("id_") > F.col("least"), 16).otherwise(0)).alias("mask"))
    if clash.isEmpty():
        return fails(rows.join(alone, "hash_", "left"))
    # Different texts with one hash, hardly ever any, are told apart by the texts themselves.
    hashes = clash.select("hash_").distinct()
    told = texts.join(hashes, "hash_", "left_semi").join(clash, ["hash_", "text_"], "left")
    return fails(rows.join(hashes, "hash_", "left_anti").join(alone, "hash_", "left")).union(fails(text_flags(told)))


def orders() -> list[tuple[int, str, int, bool, bool]]:
    """(mask, filter_order, step, has, met): for each mask of failed filters and every order of the filters, step by step, whether the step's filter is
    among the failed, and whether one of those applied before is."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out += [(mask, "".join(order), step, mask & bit != 0, mask & before != 0) for mask in range(1 << len(FILTERS))]
            before |= bit
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each value of `part`, each of
    the 120 orders of filters A to E and each step, counts being of documents within the part.

    Each document has a mask of the filters that it fails, its part and its labels; counts of these, which add up, are all that the orders need:
    a step removes the masks with its bit and none of the bits before. A document's removals over all orders go evenly to the filters it
    fails. The table of orders has 600 rows for each of 32 masks.

    Null texts are empty; a null part is the empty string; null ids fail E never and have no label; repeated rows count each, and equal ids are not
    smaller than each other; of several labels of one document each counts where it is 1 once; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    masks = materialize(failure_masks(docs, doc_id, text, part), "masks")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id_")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = masks.join(materialize(known, "labels"), "id_", "left")
    n = F.count("*").alias("n")
    counts = materialize(marked.groupBy("part_", "mask").agg(n, F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")), "counts")
    plan = spark.createDataFrame(orders(), "mask int, filter_order string, step int, has boolean, met boolean")
    has, met = F.col("has"), F.col("met")
    total = lambda when, c, name: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long").alias(name)
    share = F.lit(factorial(len(FILTERS))) * F.col("n") / F.bit_count("mask")
    steps = counts.join(F.broadcast(plan), "mask")  # 600 rows for each of a part's at most 32 masks, which are summed at once
    return steps.groupBy(F.col("part_").alias("part"), "filter_order", "step").agg(
        total(~has & ~met, "n", "kept"),
        total(has & ~met, "n", "removed"),
        total(has & met, "n", "redundant"),
        total(has & (F.bit_count("mask") == 1), "n", "unique_fails"),
        total(has & ~met, "good", "good_lost"),
        total(has & ~met, "toxic", "toxic_lost"),
        F.sum(F.when(has, share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )
