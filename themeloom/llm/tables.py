"""What the operators of this subpackage share: input columns, hash remainders, free names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; null keys give null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text), null texts as empty ones; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20,
           rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ``rows`` rows whose text stays near ``limit`` bytes, uncopied.

    What a task computes per byte then takes bounded memory; only one text that is longer by
    itself makes a longer run.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = texts.fill_null("").cast(pa.large_binary()) if texts.null_count else texts
    lengths = pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit or i - first >= rows:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def by_id(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``docs`` joined on doc_id with ``listed``, whose columns get names that docs doesn't have.

    Rows without a doc_id match nothing.
    """
    names = {c: free_name(docs, f"listed_{c}") for c in listed.columns}
    listed = listed.select(*[F.col(c).alias(n) for c, n in names.items()])
    return docs.join(listed, docs["doc_id"].cast("long") == listed[names["doc_id"]], how)
