"""Writers: each writes through Spark's committer into the shared folder, or a given path, and returns what it wrote, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_dir


def _path(df: DataFrame, path: str | None, name: str) -> str:
    return path or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(where)


def snapshot_json(ranked: DataFrame, path: str | None = None, most: int = 1000) -> DataFrame:
    """One JSON document of a ranked list, keys in order. A document is one value: a list of more than `most` rows is an error."""
    if ranked.limit(most + 1).count() > most:
        raise ValueError(f"a snapshot is one document of at most {most} rows")
    rows = ranked.select(F.struct(*sorted(ranked.columns)).alias("r"))
    doc = rows.agg(F.to_json(F.struct(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(F.col("r.rank").alias("rank"), "r"))).alias("rows"))).alias("value"))
    path = _path(ranked, path, "snapshot")
    doc.coalesce(1).write.text(path)
    return ranked.sparkSession.read.text(path)


def history_csv(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows ordered by all columns over range partitions, as CSV with a header."""
    path = _path(rows, path, "history")
    rows.orderBy(*rows.columns).write.csv(path, header=True)
    return rows.sparkSession.read.csv(path, header=True)


def partitioned(rows: DataFrame, by: list[str], path: str | None = None) -> DataFrame:
    """JSON lines in one folder for each value of `by`, in files of at most a million rows."""
    path = _path(rows, path, "shards")
    rows.repartition(*by).write.partitionBy(*by).option("maxRecordsPerFile", 1_000_000).json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def region_shards(rows: DataFrame, cell: list[str], path: str | None = None) -> DataFrame:
    """One shard of rows for each (country, state), with `local`, the number from 0 of a row's climate cell among those that its shard uses."""
    used = rows.where(F.coalesce(*cell).isNotNull() & F.col("tenths").isNotNull()).groupBy("country", "state").agg(F.array_sort(F.collect_set(F.struct(*cell))).alias("cells_"))
    place = F.when(F.col("tenths").isNotNull(), F.array_position("cells_", F.struct(*cell)) - 1).cast("int")
    local = rows.join(used, ["country", "state"], "left").withColumn("local", place).drop("cells_")
    return partitioned(local, ["country", "state"], path)


def redirect_shards(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Redirects in one shard for each country, named by 16 hexadecimal digits of its SHA-256; two countries of one name are an error."""
    named = rows.withColumn("shard", F.substring(F.sha2("country", 256), 1, 16))
    names = named.groupBy("shard").agg(F.min("country").alias("a_"), F.max("country").alias("b_"))
    checked = names.select("shard", F.when(F.col("a_") == F.col("b_"), F.lit(True)).otherwise(F.raise_error(F.lit("two countries have one shard name")).cast("boolean")).alias("ok_"))
    return partitioned(named.join(checked, "shard").where("ok_").drop("ok_"), ["shard"], path)


def sitemaps(parts: DataFrame, base: str, path: str | None = None) -> DataFrame:
    """XML url entries in one folder for each (country, part), named country-part."""
    entry = F.concat(F.lit("<url><loc>"), F.lit(base), F.col("path"), F.lit("</loc></url>"))
    path = _path(parts, path, "sitemaps")
    parts.select(F.concat_ws("-", "country", "part").alias("member"), entry.alias("value")).repartition("member").write.partitionBy("member").text(path)
    return parts.sparkSession.read.schema("value string, member string").text(path)


def _point(spark: SparkSession, pointer: str, target: str) -> None:
    """Makes the file `pointer` name `target`, by a rename over the old one: readers see either."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs
    new = f"{pointer}-{uuid.uuid4().hex}"
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out = files.Path(new).getFileSystem(conf).create(files.Path(new))
    out.write(target.encode())
    out.close()
    rename = getattr(files, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files.FileContext.getFileContext(files.Path(pointer).toUri(), conf).rename(files.Path(new), files.Path(pointer), over)


def sitemap_set(pages: DataFrame, base: str, root: str) -> DataFrame:
    """Writes the url entries of pages (member, path) in one folder for each member, then an index of the members that are there, and then lets
    `root`/current name this version. Whoever reads meanwhile, or after a run that failed, finds the version before, whole."""
    spark, version = pages.sparkSession, uuid.uuid4().hex
    loc = lambda kind, path: F.concat(F.lit(f"<{kind}><loc>{base}"), path, F.lit(f"</loc></{kind}>"))
    folder = f"{root}/{version}"
    pages.select("member", loc("url", F.col("path")).alias("value")).repartition("member").write.partitionBy("member").text(f"{folder}/members")
    members = spark.read.schema("value string, member string").text(f"{folder}/members").select("member").distinct()
    members.orderBy("member").select(loc("sitemap", F.concat(F.lit("/sitemaps/"), "member", F.lit(".xml"))).alias("value")).write.text(f"{folder}/index")
    _point(spark, f"{root}/current", version)
    return read_sitemaps(spark, root)


def read_sitemaps(spark: SparkSession, root: str) -> DataFrame:
    """Rows (member, value) of the current version, its index as a member of that name."""
    folder = f"{root}/{spark.read.text(f'{root}/current').first()[0]}"
    members = spark.read.schema("value string, member string").text(f"{folder}/members").select("member", "value")
    return members.union(spark.read.text(f"{folder}/index").select(F.lit("index"), "value"))


def search_index(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Entries of a search index as JSON lines."""
    path = _path(rows, path, "index")
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def upsert(table: str, rows: DataFrame, keys: list[str], order: str, by: str) -> DataFrame:
    """Puts rows into a Parquet table partitioned by `by`, the latest by `order` of each key staying. Only the partitions that have new rows are
    read, merged in the shared folder and overwritten."""
    spark = rows.sparkSession
    whole = rows
    if _exists(rows, table):
        touched = rows.select(by).distinct()
        whole = rows.unionByName(spark.read.schema(rows.schema).parquet(table).join(touched, by, "left_semi"))
    rest = [c for c in rows.columns if c not in keys]
    latest = whole.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)
    merged = materialize(latest, "merged")
    merged.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(table)
    return spark.read.schema(rows.schema).parquet(table)


def content_addressed(docs: DataFrame, column: str, path: str | None = None) -> DataFrame:
    """Each document under the SHA-256 of its bytes, in folders by the first two digits; a name that is there already is not written again."""
    path = _path(docs, path, "objects")
    new = docs.select(F.sha2(column, 256).alias("name"), F.col(column).alias("value")).dropDuplicates(["name"]).withColumn("prefix", F.substring("name", 1, 2))
    if _exists(docs, path):
        new = materialize(new.join(docs.sparkSession.read.schema(new.schema).parquet(path), ["prefix", "name"], "left_anti").select(*new.columns), "objects")
    new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
    return docs.sparkSession.read.schema(new.schema).parquet(path)
