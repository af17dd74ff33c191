"""Reading OTLP JSON lines: shipped batches and any text that holds export requests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.schemas import RAW, full
from tracehold.session import nothing

_PIECE = 1 << 20
_LISTS = ('"arrayValue"', '"kvlistValue"')
_NEST = f"(?:{'|'.join(_LISTS)})"


def line_signal(line: Column) -> Column:
    """The one signal a line carries, or NULL when it carries none, several, or is not JSON."""
    has = {s: F.get_json_object(line, f"$.{c}").isNotNull() for s, c in cv.RESOURCE_COLUMN.items()}
    n = sum((h.cast("int") for h in has.values()), F.lit(0))
    out = F.when(n != 1, None)
    for s, h in has.items():
        out = out.when(h, s)
    return out


def line_status(line: Column, max_bytes: int = cv.MAX_LINE_BYTES) -> Column:
    """blank, oversized, malformed or ok, in the order a reader decides."""
    return (F.when(F.octet_length(line) > max_bytes, "oversized").when(F.btrim(line, F.lit(" \t\r\n\v\f")) == "", "blank")
            .when(line_signal(line).isNull(), "malformed").otherwise("ok"))


def clean_line(line: Column) -> Column:
    """A line without the carriage return some writers end it with."""
    return F.regexp_replace(line, "\r$", "")


def nesting(lines: DataFrame, column: str = "line", most: int = cv.MAX_NESTING) -> int:
    """How many levels of lists and maps the deepest attribute value on some lines has: 2 at least, ``most``
    at most. Only lines with more than two lists or maps are read closely, token by token on the JVM."""
    line = F.col(column)
    some = F.contains(line, F.lit(_LISTS[0])) | F.contains(line, F.lit(_LISTS[1]))  # a plain search first: most lines have none
    many = lines.filter(some & (F.size(F.regexp_extract_all(line, F.lit(_NEST), F.lit(0))) > 2))
    # Open objects as a text, a list or map as one m and any other as one o; a name marks the object after it.
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("named"), F.lit(0).alias("deepest"))

    def step(at: Column, token: Column) -> Column:
        closed = F.substring(at["open"], F.lit(1), F.greatest(F.length(at["open"]) - 1, F.lit(0)))
        held = F.when(token == "{", F.concat(at["open"], F.when(at["named"], "m").otherwise("o"))).when(token == "}", closed).otherwise(at["open"])
        return F.struct(held.alias("open"), token.rlike(f"^(?:{_NEST})$").alias("named"), F.greatest(at["deepest"], F.length(F.replace(held, F.lit("o")))).alias("deepest"))
    tokens = F.regexp_extract_all(line, F.lit(r'[{}]|"(?:\\.|[^"\\])*"'), F.lit(0))
    found = many.agg(F.max(F.aggregate(tokens, start, step)["deepest"]).alias("deepest")).first().deepest
    return min(most, max(2, found or 0))


def parse_lines(lines: DataFrame, signal: str, column: str = "line", whole: bool = False, depth: int = 2) -> DataFrame:
    """Lines that carry a signal, parsed by its fixed schema next to the frame's other columns. A ``whole``
    parse reads ``depth`` levels of lists and maps, see ``nesting``."""
    schema = full(signal, depth) if whole else RAW[signal]
    name = cv.RESOURCE_COLUMN[signal]
    # A generator rather than a filter: a filter on the parsed column would be pushed below the
    # projection and every line parsed twice.
    parsed = F.filter(F.array(F.from_json(column, schema)[name]), lambda x: x.isNotNull())
    return lines.select(*[c for c in lines.columns if c != column], F.explode(parsed).alias(name))


def empty_raw(spark: SparkSession, signal: str) -> DataFrame:
    return nothing(spark, RAW[signal]).withColumn("file", F.lit("").cast("string"))


def read_lines(spark: SparkSession, paths: Sequence[str], skip_corrupt: bool = True, recurse: bool = True) -> DataFrame:
    """``line, file`` of text or gzip files. A damaged file is skipped, so it never blocks the rest."""
    return (spark.read.option("recursiveFileLookup", str(recurse).lower())
            .option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("ignoreMissingFiles", "true")
            .text(list(paths)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))


def read_batches(spark: SparkSession, signal: str, paths: Sequence[str], skip_corrupt: bool = True,
                 max_bytes: int = cv.MAX_OBJECT_BYTES, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A signal's batches as nested rows with their ``file``, without malformed and oversized lines (which
    ``unreadable_lines`` gives). ``only`` picks lines by their file before any is parsed."""
    if not paths:
        return empty_raw(spark, signal)
    lines = read_lines(spark, paths, skip_corrupt).filter(F.octet_length("line") <= max_bytes)
    return parse_lines(lines if only is None else only(lines), signal)


def unreadable_lines(spark: SparkSession, signal: str, paths: Sequence[str], max_bytes: int = cv.MAX_OBJECT_BYTES) -> DataFrame:
    """``file, status, line`` of the lines of whole batches that carry no record: malformed (or of another
    signal) or oversized."""
    line, carried = F.col("line"), F.col("carried")
    read = F.array_compact(F.array(*[F.when(F.get_json_object(line, f"$.{c}").isNotNull(), s) for s, c in cv.RESOURCE_COLUMN.items()]))
    # A generator, as in parse_lines: a status that is a column is worked out for the filter and again for
    # the answer, each time with every look into the line that it names.
    lines = read_lines(spark, paths, skip_corrupt=False).select("file", "line", F.explode(F.array(F.when(F.octet_length(line) <= max_bytes, read))).alias("carried"))
    own = (F.size(carried) == 1) & (F.get(carried, F.lit(0)) == signal)
    blank = F.btrim(line, F.lit(" \t\r\n\v\f")) == ""
    status = F.when(carried.isNull(), "oversized").when(own, "ok").when(blank, "blank").otherwise("malformed")
    return lines.select("file", status.alias("status"), "line").filter("status IN ('malformed', 'oversized')")


def _gzip_whole(content: bytes) -> bool:
    """Whether every gzip member of a file ends where it says, read piece by piece."""
    left = memoryview(content)
    try:
        while len(left):
            member = zlib.decompressobj(wbits=31)
            while len(left) and not member.eof:
                piece, left = left[:_PIECE], left[_PIECE:]
                member.decompress(piece, _PIECE)
                while member.unconsumed_tail:
                    member.decompress(member.unconsumed_tail, _PIECE)
            if not member.eof:
                return False
            if member.unused_data:
                left = memoryview(member.unused_data + bytes(left))
    except zlib.error:
        return False
    return len(content) > 0


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(b.num_rows):
            yield pa.record_batch([b.column("path").slice(at, 1), pa.array([_gzip_whole(b.column("content")[at].as_py())])], ["path", "whole"])


def whole_files(spark: SparkSession, paths: Sequence[str], pattern: str = "*.jsonl.gz") -> DataFrame:
    """``path, whole`` of gzip files: whether each can be read to its end. A file is a task's value, so
    this is for batches, whose size the shipper bounds."""
    content = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(paths))
               .select(F.col("_metadata.file_path").alias("path"), "content"))
    return content.mapInArrow(_whole, "path string, whole boolean")


def list_files(spark: SparkSession, paths: Sequence[str], pattern: str = "*") -> DataFrame:
    """``path, size, modified`` of the files under some paths, listed by Spark without reading them."""
    if not paths:
        return nothing(spark, "path string, size bigint, modified timestamp")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
