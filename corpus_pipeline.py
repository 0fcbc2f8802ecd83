"""Corpus cleaning as five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sultry.llm.common import materialize, maybe_in, shared_dir, ship
from sultry.llm.decontamination import find_leaks
from sultry.llm.ngram_jaccard import jaccard_components
from sultry.llm.packing import best_fit_pack
from sultry.llm.quality_rules import clean_lines
from sultry.llm.secrets import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with row_, a hash of id and text: rows that agree in both are one document, and a doc_id with two texts is two."""
    return docs.select(*COLUMNS).withColumn("row_", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose row_ is not in rows. Only those that may be are shuffled."""
    marked = maybe_in(keyed, "row_", rows)
    rest = marked.where("maybe_").join(rows, "row_", "left_anti").select(*keyed.columns)
    return marked.where("not maybe_").select(*keyed.columns).union(rest)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines. Null and empty texts fail; repeated rows are judged alike;
    null ids, other columns' nulls and ties do not matter; an empty table stays empty; columns beside the documents' own go."""
    kept = clean_lines(docs.select(*COLUMNS)).where("kept")
    changed = F.col("n_lost_words") > 0
    return kept.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.when(changed, F.length("cleaned").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each component of ones linked by a Jaccard index of 0.8 over five words.

    Rows that agree in doc_id and text are copies too, of which one stays (whichever, if other columns differ); a doc_id with several texts
    is several documents, each judged by its own text; null ids count as greatest. Documents without words link with nothing and all stay.
    An empty table stays empty; columns beside the documents' own go."""
    ship(spark)
    keyed = _keyed(docs)
    parts = jaccard_components(keyed.select("row_", "text"), doc_id="row_", n=5, least=80).where("n_shingles > 0")
    ids = keyed.groupBy("row_").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    known = materialize(parts.select(F.col("doc_id").alias("row_"), "component_id").distinct().join(ids, "row_"), "rows")
    first = known.groupBy("component_id").agg(F.min_by("row_", F.struct(F.col("id").isNull(), "id", "row_")).alias("first"))
    first = materialize(first, "first")  # so that the join splits where a component is hot
    judged = materialize(known.join(first, "component_id").select("row_", (F.col("row_") == F.col("first")).alias("stays"), "copies"), "judged")
    kept = _without(keyed, judged.where("not stays or copies > 1").select("row_"))
    copied = judged.where("stays and copies > 1").select("row_")
    single = maybe_in(keyed, "row_", copied).where("maybe_").join(copied, "row_", "left_semi").select(*keyed.columns).dropDuplicates(["row_"])
    return kept.select(*COLUMNS).union(single.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Each row is judged by its own text, also where ids are null or repeated; null and
    empty texts hold nothing; either table may be empty; columns beside the documents' own go."""
    ship(spark)
    keyed = _keyed(docs)
    leaks = find_leaks(keyed.select("row_", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="row_").select(F.col("doc_id").alias("row_")).distinct()
    return _without(keyed, materialize(leaks, "leaks")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark. Null and empty texts stay as they are; repeated rows are treated alike; an empty
    table stays empty; columns beside the documents' own go."""
    ship(spark)
    out = redact(docs.select(*COLUMNS).withColumn("was_", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("was_"))
    return out.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 tokens. Null and empty texts are one end token; null ids and repeated
    rows are packed like others; an empty table gives no rows."""
    ship(spark)
    return best_fit_pack(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]

#: SQL can't express the tokens of the last stage nor the components of the second in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(ship(spark))}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
