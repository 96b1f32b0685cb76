"""File hashes against a manifest, and what each source delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, bytes, sha256) of all files below it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = root.getFileSystem(conf).makeQualified(root).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    return files.select(F.substr(path, F.lit(len(base.rstrip("/")) + 2)).alias("path"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): ok, mismatch, missing or extra, for every file of either side."""
    found = digests.select("path", F.col("sha256").alias("_found"))
    wanted = manifest.select("path", F.col("sha256").alias("_wanted"))
    state = (F.when(F.col("_found").isNull(), "missing").when(F.col("_wanted").isNull(), "extra")
             .when(F.col("_found") == F.col("_wanted"), "ok").otherwise("mismatch"))
    return found.join(wanted, "path", "full").select("path", state.alias("state"))


def provenance(files: DataFrame) -> DataFrame:
    """Per source: number of files, bytes and an order-free digest of its (path, hash) pairs."""
    return files.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
        F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "sha256"), 256), 1, 12), 16, 10)
              .cast("decimal(38,0)")).cast("string").alias("digest"))


def dataset_info(records: DataFrame, commit: str | None) -> DataFrame:
    """One row: data version (first 12 characters of the source commit) and split sizes."""
    return records.agg(*[
        F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "ood_val")]).select(
        F.lit(commit[:12] if commit else "bilinmiyor").alias("version"), "train", "val", "ood_val")
