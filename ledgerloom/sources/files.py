"""Folders of documents and the records that stand beside them. Spark lists and reads; only helpers of paths are local."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import path_stem

DOCUMENTS = "*.{png,jpg,jpeg,pdf,PNG,JPG,JPEG,PDF}"
SKIPPED = (".git", ".venv", "node_modules", "__pycache__", ".pytest_cache", "dist", "build")


def dataset_path(name: str, root: str | None = None, must_exist: bool = False) -> str:
    """A path as it is if it looks like one, else that folder below the root, or below the working folder where only that is there; without a root the name."""
    looks = os.path.isabs(name) or name.startswith((".", "~")) or "/" in name or "://" in name
    found = name if looks or not root else f"{root.rstrip('/')}/{name}"
    if "://" not in found:
        if found != name and not os.path.exists(found) and os.path.exists(name):
            found = os.path.abspath(name)
        if must_exist and not os.path.exists(os.path.expanduser(found)):
            raise FileNotFoundError(found)
    return found


def _there(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size, content) of the images and PDFs right in a folder, in order of path; content is read only where it is used. A folder that is not there has none."""
    if not _there(spark, folder):
        return spark.createDataFrame([], "path string, modified timestamp, size long, content binary")
    found = spark.read.format("binaryFile").option("pathGlobFilter", DOCUMENTS).option("recursiveFileLookup", "false").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content").orderBy("path")


def records(spark: SparkSession, folder: str, schema: str = "map<string,string>") -> DataFrame:
    """(stem, content, record) of the JSON files in a folder, one each; a file that is no JSON has a null record."""
    raw = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return raw.select(path_stem(F.col("path")).alias("stem"), "content", F.from_json("content", schema).alias("record"))


def paired(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents with the record of the same stem, if there is one."""
    return found.withColumn("stem", path_stem(F.col("path"))).join(truth, "stem", "left")


def canonical_records(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, record) of the JSON records in a folder: of annotated values those that are present, of others the values as they are."""
    from ledgerloom.operators.truth import canonical_json

    return records(spark, folder).select("stem", canonical_json(F.col("content")).alias("record"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, file) of a subset's manifest: ``{"buckets": {name: [file, ...]}}``."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "buckets map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m.buckets").alias("bucket", "files")).select("bucket", F.explode("files").alias("file"))


def subset(found: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the documents that are chosen, each once; the chosen names without a document)."""
    names = chosen.select("file").distinct()
    named = found.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return named.join(names, "file", "left_semi").drop("file"), names.join(named.select("file"), "file", "left_anti")


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON summaries as rows."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the text files below a folder, without those of tools and builds."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    x = raw.select(below.alias("path"), F.col("value").alias("text"))
    return x.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def demo(spark: SparkSession) -> DataFrame:
    """(doc_id, page_no, text): a made-up invoice of one page."""
    text = "Harbor Street Animal Clinic\nInvoice Number: HS-2041\nInvoice Date: 2024-03-05\nBill To: Jordan Lee\nRecheck visit 1 45.00 45.00\nBlood test 2 30.00 60.00\nSubtotal: 105.00\nTax: 8.40\nTotal: 113.40"
    return spark.createDataFrame([("demo", 0, text)], "doc_id string, page_no int, text string")


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database; filters and columns reach it as SQL."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def sql(spark: SparkSession, text: str, **named) -> DataFrame:
    """SQL over the session's tables with named parameters."""
    return spark.sql(text, args=named)


def write_artifacts(results: DataFrame, folder: str) -> None:
    """A JSON record a result, in folders by dataset."""
    results.write.mode("append").partitionBy("dataset").json(folder)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)
