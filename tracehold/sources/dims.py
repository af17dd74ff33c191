"""Side inputs: run manifests, registries, the erasure list, pinned names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions.otel import row
from tracehold.functions.text import registry_version
from tracehold.schemas import REGISTRY, RUN_MANIFEST


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
            .text(path).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file")))


def run_manifests(docs: DataFrame) -> DataFrame:
    """``run, valid, lane, ...`` of documents ``value, run``: a manifest must name its own run and a lane."""
    m = docs.withColumn("m", F.from_json("value", RUN_MANIFEST))
    valid = ((F.octet_length("value") <= cv.MAX_MANIFEST_BYTES) & F.col("run").rlike(cv.WRITER_NAME)
             & (F.col("m.run") == F.col("run")) & (F.coalesce("m.lane", F.lit("")) != ""))
    return m.select("run", F.coalesce(valid, F.lit(False)).alias("valid"), "m.lane", "m.harness", "m.focus", "m.item", "m.step",
                    F.when(F.col("m.run_quota_bytes") > 0, F.col("m.run_quota_bytes")).otherwise(cv.DEFAULT_RUN_BUDGET).alias("budget"))


def read_run_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every run's manifest; the file name is the run."""
    return run_manifests(_documents(spark, path).withColumn("run", F.regexp_replace("file_name", r"\.json$", "")))


def registry_names(docs: DataFrame) -> DataFrame:
    """``tool, version, kind, name, metric, limit, is_template, sha`` of registry documents ``value``.

    ``kind`` is attribute, standard, span, event, metric or limit. A limit on a metric's use of an
    attribute overrides the attribute's own.
    """
    r = docs.withColumn("sha", F.sha2("value", 256)).withColumn("r", F.from_json("value", REGISTRY)).filter("r.tool IS NOT NULL")
    base = r.select(F.col("r.tool").alias("tool"), F.col("r.version").alias("version"), "sha", "r")
    own = F.transform(F.col("r.attributes"), lambda a: F.struct(
        F.lit("attribute").alias("kind"),
        F.when(F.startswith(a["type"], F.lit("template[")), F.concat(F.regexp_replace(a["id"], r"\.<key>$", ""), F.lit(".")))
        .otherwise(a["id"]).alias("name"),
        F.lit(None).cast("string").alias("metric"), F.try_element_at(a["annotations"], F.lit(cv.CARDINALITY)).try_cast("int").alias("limit"),
        F.coalesce(F.startswith(a["type"], F.lit("template[")), F.lit(False)).alias("is_template")))

    def plain(kind: str, names):
        return F.transform(names, lambda n: F.struct(
            F.lit(kind).alias("kind"), n.alias("name"), F.lit(None).cast("string").alias("metric"),
            F.lit(None).cast("int").alias("limit"), F.lit(False).alias("is_template")))
    own_limits = F.transform(F.filter(F.col("r.attributes"), lambda a: F.try_element_at(a["annotations"], F.lit(cv.CARDINALITY)).isNotNull()),
                             lambda a: row(
                                 id=a["id"], n=F.try_element_at(a["annotations"], F.lit(cv.CARDINALITY)).try_cast("int")))
    uses = F.flatten(F.transform(F.col("r.metrics"), lambda m: F.transform(m["attributes"], lambda u: F.struct(
        F.lit("limit").alias("kind"), u["name"].alias("name"), m["name"].alias("metric"),
        F.coalesce(F.when(u["cardinality"] > 0, u["cardinality"]),
                   F.get(F.filter(own_limits, lambda o: o["id"] == u["name"]), F.lit(0))["n"]).alias("limit"),
        F.lit(False).alias("is_template")))))
    shape = "array<struct<kind:string,name:string,metric:string,limit:int,is_template:boolean>>"
    every = F.concat(*[F.coalesce(x.cast(shape), F.array().cast(shape)) for x in (
        own, plain("standard", F.col("r.standard_attributes")), plain("span", F.col("r.spans.name")),
        plain("event", F.col("r.events.name")), plain("metric", F.col("r.metrics.name")), uses)])
    return base.select("tool", "version", "sha", F.explode(every).alias("n")).select(
        "tool", "version", "n.kind", "n.name", "n.metric", "n.limit", "n.is_template", "sha").filter(
        (F.col("kind") != "limit") | F.col("limit").isNotNull())


def read_registries(spark: SparkSession, path: str) -> DataFrame:
    return registry_names(_documents(spark, path))


def registry_conflicts(names: DataFrame) -> DataFrame:
    """Tools with two different registries for one version (build metadata aside)."""
    return (names.select("tool", registry_version(F.col("version")).alias("version"), "sha").distinct()
            .groupBy("tool", "version").agg(F.count(F.lit(1)).alias("registries")).filter("registries > 1"))


def misdeclared(names: DataFrame) -> DataFrame:
    """Tools that declare an attribute outside their own prefix; their registries are refused whole."""
    own = names.filter(F.col("kind") == "attribute")
    good = F.startswith("name", F.concat("tool", F.lit("."))) & (F.length("name") > F.length("tool") + 1)
    return own.groupBy("tool", "version").agg(F.bool_and(good).alias("ok"), F.min(F.when(~good, F.col("name"))).alias("name")).filter(
        ~F.col("ok")).select("tool", "version", "name")


def accepted_names(names: DataFrame) -> DataFrame:
    return names.join(misdeclared(names).select("tool", "version"), ["tool", "version"], "left_anti")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    line = F.btrim("value", F.lit(" \t\r\n"))
    return spark.read.text(path).select(line.alias("entry")).filter((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))


def read_erasure(spark: SparkSession, path: str, most: int | None = 10_000) -> list[str]:
    """The handles to mask, each once. The list becomes part of every plan that masks: one over ``most`` is
    refused, never cut; ``None`` takes a list of any length that the driver holds."""
    entries = _entries(spark, path).distinct()
    got = sorted(r.entry for r in (entries if most is None else entries.limit(most + 1)).collect())
    if most is not None and len(got) > most:
        raise ValueError(f"{path}: over {most} handles")
    for h in got:
        if " " in h or "\t" in h:
            raise ValueError(f"{path}: a handle has no spaces: {h!r}")
    return got


def read_pinned_names(spark: SparkSession, path: str) -> DataFrame:
    """Attribute names a vendor is known to send, one per line, as a one-column frame."""
    return _entries(spark, path).select(F.col("entry").alias("name")).distinct()
