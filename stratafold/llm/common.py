"""What the training-data operators share: words, shared tables, Arrow rows.

Conventions of every operator here
----------------------------------
* A null text is the empty text; a null ``doc_id`` is an ordinary value that equals nothing.
* Input columns beyond those an operator reads are dropped, or passed through untouched by
  filters, so names that clash with its own are harmless.
* Repeated rows are scored once each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.state import settle

__all__ = ["WORD", "batch", "fold", "read_table", "settle", "sized", "strings", "texts", "tokenizer_path", "utf8"]

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, parts: int) -> F.Column:
    """crc32 of an id's decimal text, modulo ``parts``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts), F.lit(0)).cast("int")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, nulls as empty texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """An Arrow string column as UTF-8 rows; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose ``column`` holds about ``most`` bytes, so that memory follows bytes and not rows."""
    for b in batches:
        if not b.num_rows:
            continue
        n = max(1, b.num_rows * most // max(1, b.column(column).nbytes))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)
