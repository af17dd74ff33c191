"""An answer as JSON documents: the rows, and one row that says what was asked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_meta(df: DataFrame, query: str, params: dict) -> DataFrame:
    meta = {"query": query, **{k: v for k, v in params.items() if v not in (None, "", [], ())}, "columns": df.columns}
    return df.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "value string")


def result_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in column order, NULLs written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_result(df: DataFrame, path: str, query: str, params: dict) -> None:
    """``<path>/rows`` holds the answer, ``<path>/meta`` its one-line description, written last."""
    result_rows(df).write.mode("overwrite").text(f"{path}/rows")
    result_meta(df, query, params).write.mode("overwrite").text(f"{path}/meta")
