"""What the operators share: reading their tables, walking Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.session import cut, prepare  # noqa: F401  (cut is imported from here by the operators)

#: Rows of an Arrow batch that are Python objects at one time.
SLICE = 128
#: The column of row keys.
ROW = "_row_key"
_kept: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names: what else a table holds cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under this name; it keeps one thing at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, name: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, so that few texts are Python objects at once. A worker serves many
    operators one after another: what it keeps under other names than ``name`` goes."""
    for other in [x for x in _kept if x != name]:
        del _kept[other]
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def keyed(df: DataFrame) -> DataFrame:
    """The rows with a key of their own in column ``ROW``, not negative: the place in their Parquet file and
    the file's hash. Rows that do not come straight from such files are written first."""
    place = F.shiftrightunsigned(F.xxhash64("_metadata.file_path"), 2).bitwiseXOR(F.col("_metadata.row_index"))
    try:
        return df.withColumn(ROW, place)
    except AnalysisException:
        return cut(df.withColumn(ROW, F.monotonically_increasing_id()), "row-keys")


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits_for(rows: int, per_part: int, least: int) -> int:
    """Bits that number enough parts for each to hold about per_part rows."""
    return max(least, int(np.ceil(np.log2(max(1, rows / per_part)))))
