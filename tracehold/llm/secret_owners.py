"""Secret scans weighed by ownership over the whole corpus, in Spark's own functions only.

Three kinds of base spans come from patterns. A fourth kind, ``blob``, is any long token of mixed
letters and digits; on its own it says little, so the corpus decides: the hashes of all candidate values
are counted by distinct repositories and owners. A value that many owners hold is a copied example, one
that a few hold looks live. Owner-specific blobs are added to the base spans; base spans always stay and
carry the same judgement in counts.

Spans are found within their row: the text split by a pattern gives the gaps, the matches the rest, and
positions are running sums of their lengths. Only hashes with their owners, and a row for each span, are
shuffled. Counts are of distinct (hash, repository, owner), combined before the shuffle, so a value in
every document costs no more than its owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import cut

#: Owners from which on a value counts as copied.
COPIED = 3
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is long enough, so that the shortest match need not be filtered afterwards.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
BLOB = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "blob")


def found(text: Column, kind: str, pattern: str, value: Column | None = None) -> Column:
    """The leftmost non-overlapping matches: start, kind's place, end (code points), kind and value."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, hit: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(gaps, F.size(acc["out"]) + 1))
        end = start + F.length(hit)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,place:int,end:int,kind:string,value:string>>")
    spans = F.reduce(hits, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _value(span: Column) -> Column:
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 1)).otherwise(span["value"])


def candidates(text: Column) -> Column:
    """All base spans, then blobs that meet none of them, each with its value."""
    valued = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), _value(s).alias("value")))
    assign = F.filter(valued(found(text, "assign", ASSIGN)), lambda s: F.length(s["value"]) >= 8)
    return F.array_sort(F.concat(assign, found(text, "access", ACCESS), found(text, "hex", HEX)))


def blobs(text: Column, base: Column) -> Column:
    mixed = lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]")
    return F.filter(found(text, "blob", BLOB), lambda s: mixed(s) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", copied: int = COPIED) -> DataFrame:
    """A row for each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_copied
    (spans whose value fewer than ``copied`` owners hold, and the others), most_owners and most_repositories
    (of the row's values, the most owners and the most repositories that hold one; 0 without any). Owners
    decide, as one owner's forks of a secret are still one owner's; repositories show how far it went.

    A repository is an owner's name with the ``repository`` column; an unknown owner counts as one more
    owner. Null and empty texts have no spans. Repeated rows are scanned each, and add nothing to the
    counts of owners. An empty table gives no rows."""
    c = lambda name: F.col(f"`{name}`")
    base = docs.select(c(doc_id).alias("doc_id"), F.coalesce(c(text), F.lit("")).alias("text"), F.coalesce(c(owner).cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(c(repository).cast("string"), F.lit("")).alias("repository"))
    base = base.withColumn("base", candidates(F.col("text"))).withColumn("blobs", blobs(F.col("text"), F.col("base")))
    # written once: from here on texts are gone and the row's number stays what it is
    rows = cut(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", "base", "blobs"), "secrets")
    spans = rows.select("row", "owner", "repository", F.explode(F.concat("base", "blobs")).alias("span")).withColumn("hash", F.xxhash64("span.value"))
    held = spans.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = spans.join(held, "hash").groupBy("row").agg(
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
        F.count_if(F.col("owners") < copied).alias("n_live"), F.count_if((F.col("owners") >= copied) & (F.col("span.kind") != "blob")).alias("n_copied"),
        F.collect_list(F.when((F.col("owners") < copied) & (F.col("span.kind") == "blob"), F.col("span"))).alias("added"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.join(judged, "row", "left").select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"))
