"""Accepting, versioning and gated publishing of tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tesora.operators.contracts import Split, side_by_side
from tesora.operators.temporal import AGGREGATE_KEY, mark_aggregates

# Status transitions and the mapping fields a contract covers.
TRANSITIONS = {
    "candidate": ("connected", "rejected"),
    "connected": ("validated", "rejected"),
    "validated": ("connected", "rejected"),
    "rejected": ("candidate",),
}
CONTRACT_FIELDS = ("columns", "category", "period_format", "separator", "encoding")


# ---- canonical sink ----------------------------------------------------------


def write_canonical(canonical: DataFrame, quarantine: DataFrame, profile: DataFrame, path: str) -> None:
    """Canonical rows by category and year in a stable order, next to quarantine and profile.

    Ranges over the unique key give tasks of similar size even when one category
    holds most rows, and few files per folder.
    """
    out = canonical.withColumn("_year", F.year("period_start"))
    (
        out.repartitionByRange("category_code", "_year", "municipality_id", "period_start")
        .sortWithinPartitions("category_code", "_year", "municipality_id", "period_start")
        .write.mode("overwrite")
        .partitionBy("category_code", "_year")
        .parquet(f"{path}/canonical")
    )
    quarantine.write.mode("overwrite").parquet(f"{path}/quarantine")
    profile.write.mode("overwrite").json(f"{path}/profile")


# ---- versions ----------------------------------------------------------------


@dataclass(frozen=True)
class Accepted:
    version: str
    log: DataFrame


def accept_version(
    df: DataFrame,
    quality: DataFrame,
    *,
    dataset: str,
    root: str,
    accepted_at: str,
    source_name: str,
    source_digest: str,
    entities: int,
    period: str,
) -> Accepted:
    """Write a history version, point the active row at it, and append the acceptance log.

    ``quality`` is the one-row quality of the validation; a rejected table writes nothing.
    """
    spark = df.sparkSession
    status = quality.first()["quality"]
    if status == "REJECTED":
        raise ValueError(f"{dataset}: validation rejected the table")
    version = f"{root}/history/{dataset}/accepted_at={accepted_at}"
    df.write.mode("errorifexists").parquet(version)
    rows = spark.read.parquet(version).count()
    entry = spark.createDataFrame(
        [
            (accepted_at, dataset, source_name, source_digest, status, rows, len(df.columns), entities, period, version)
        ],
        "accepted_at string, dataset_key string, source_filename string, source_sha256 string, quality_status string, "
        "rows long, columns int, municipalities long, period string, history_path string",
    )
    entry.write.mode("append").parquet(f"{root}/intake_log")
    return Accepted(version, entry)


def active_versions(log: DataFrame) -> DataFrame:
    """Newest accepted version per dataset."""
    newest = log.groupBy("dataset_key").agg(
        F.max_by(F.struct("accepted_at", "history_path", "rows"), F.col("accepted_at")).alias("v")
    )
    return newest.select("dataset_key", "v.*")


def read_active(spark: SparkSession, root: str, dataset: str, fallback: DataFrame | None = None) -> DataFrame:
    """The active version if one was accepted, otherwise the built-in table."""
    try:
        log = spark.read.parquet(f"{root}/intake_log").where(F.col("dataset_key") == dataset)
        row = active_versions(log).first()
    except AnalysisException:
        row = None
    if row is not None:
        return spark.read.parquet(row["history_path"])
    if fallback is None:
        raise ValueError(f"{dataset}: no version")
    return fallback


def resolve_versions(uploaded: DataFrame, built_in: DataFrame, *, dataset: str = "dataset_key") -> DataFrame:
    """Per dataset the uploaded row if present, otherwise the built-in one."""
    both = uploaded.withColumn("priority", F.lit(0)).unionByName(built_in.withColumn("priority", F.lit(1)))
    best = both.groupBy(dataset).agg(F.min_by(F.struct(*both.columns), F.col("priority")).alias("v")).select("v.*")
    mode = F.when(F.col("priority") == 0, "uploaded").otherwise("built_in")
    return best.withColumn("mode", mode).drop("priority")


def recent_log(log: DataFrame, *, order: Sequence[str], limit: int = 10) -> DataFrame:
    """Newest entries first."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


# ---- contract drift ----------------------------------------------------------


def mapping_digest(*fields: Column) -> Column:
    """Digest of a mapping's fields, as one column."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(f.cast("string"), F.lit("null")) for f in fields])), 256)


def config_digest(config: Mapping) -> str:
    """The fields of one source setting as stable text, to be digested."""
    return json.dumps({k: config.get(k) for k in CONTRACT_FIELDS}, sort_keys=True, ensure_ascii=False)


def contract_drift(current: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sources whose mapping changed while the schema version stayed the same.

    Both tables: source, schema_version, contract_digest.
    """
    known = contracts.select("source", "schema_version", F.col("contract_digest").alias("known_digest"))
    joined = current.join(known, ["source", "schema_version"], "left")
    changed = F.col("known_digest").isNotNull() & (F.col("known_digest") != F.col("contract_digest"))
    state = F.when(changed, "DRIFTED").when(F.col("known_digest").isNull(), "NEW").otherwise("SAME")
    return joined.select("source", "schema_version", state.alias("contract_state"))


# ---- gated publish -----------------------------------------------------------


def publish_status(sources: DataFrame, *, allow_partial: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``fresh``, ``partial`` or ``stale`` from accepted and quarantined sources, and whether to publish."""
    counts = sources.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "accepted").alias("accepted")
    )
    status = (
        F.when(F.col("accepted") == 0, "stale")
        .when(F.col("accepted") < F.col("sources"), "partial")
        .otherwise("fresh")
    )
    go = (F.col("status") == "fresh") | ((F.col("status") == "partial") & F.lit(allow_partial))
    return counts.withColumn("status", status).withColumn("publish", go)


@dataclass(frozen=True)
class Published:
    status: str
    rows: int
    path: str | None
    sources: DataFrame


CONTRACTS = "source string, schema_version string, contract_digest string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _drifted(spark: SparkSession, root: str, mappings: Mapping[str, Mapping]) -> tuple[DataFrame, set[str]]:
    """This run's contracts, and the feeds whose mapping changed under the same version (a row per feed)."""
    rows = [(feed, str(m.get("schema_version", "1")), config_digest(m)) for feed, m in mappings.items()]
    current = spark.createDataFrame(rows, CONTRACTS).withColumn("contract_digest", F.sha2("contract_digest", 256))
    if not rows or not _exists(spark, f"{root}/contracts"):
        return current, set()
    known = spark.read.schema(CONTRACTS).parquet(f"{root}/contracts").distinct()
    states = contract_drift(current, known).where(F.col("contract_state") == "DRIFTED").collect()
    return current, {row["source"] for row in states}


def publish_aggregates(
    spark: SparkSession,
    scans: Mapping[str, Split | Exception],
    *,
    root: str,
    run_id: str,
    allow_partial: bool = False,
    mappings: Mapping[str, Mapping] | None = None,
) -> Published:
    """Accept or quarantine each source on its own, publish the union, keep the last good otherwise.

    ``scans`` holds the outcome of reading each source: a split, or the error.
    ``mappings`` holds the configuration a source was read by; one that changed
    while its ``schema_version`` stayed the same is drift, and its scan is not
    even run. A source is accepted when it has rows and no quarantined one. The
    rows of all sources are marked and staged in one pass; one aggregate over
    the staged table gives the driver what it decides on. The accepted rows
    become current by one appended pointer row, so a failed run leaves the
    previous table, and the known contracts, as they were.
    """
    contracts, drifted = _drifted(spark, root, mappings or {})
    clean, bad = None, None
    for feed, scan in scans.items():
        if isinstance(scan, Exception) or feed in drifted:
            continue
        rows = scan.clean.withColumn("feed", F.lit(feed))
        aside = scan.quarantine.select(F.lit(feed).alias("feed"), "reason_code")
        clean = rows if clean is None else clean.unionByName(rows)
        bad = aside if bad is None else bad.unionByName(aside)
    found, staged = {}, None
    if clean is not None:
        place = f"{root}/staged/{run_id}"
        marked = mark_aggregates(clean, within=["feed"]).unionByName(bad, allowMissingColumns=True)
        marked.write.mode("errorifexists").partitionBy("feed").parquet(place)
        staged = spark.read.schema(marked.schema).parquet(place)
        # one row per feed
        per_feed = staged.groupBy("feed").agg(
            F.count_if(F.col("reason_code").isNull()).alias("good"), F.min("reason_code").alias("problem")
        )
        found = {row["feed"]: row for row in per_feed.collect()}
    outcome = []
    for feed, scan in scans.items():
        row = found.get(feed)
        if feed in drifted:
            problem = "CONTRACT_DRIFT"
        else:
            problem = str(scan) if isinstance(scan, Exception) else "EMPTY" if row is None else row["problem"]
        state = "accepted" if problem is None else "quarantined"
        outcome.append((feed, state, row["good"] if problem is None else 0, problem))
    sources = spark.createDataFrame(outcome, "source string, status string, rows long, error string")
    accepted = [feed for feed, state, _, _ in outcome if state == "accepted"]
    status = "stale" if not accepted else "partial" if len(accepted) < len(outcome) else "fresh"
    path, rows = None, 0
    if status == "fresh" or (status == "partial" and allow_partial):
        merged = staged.where(F.col("feed").isin(*accepted)).drop("feed", "reason_code")
        # every row passed the rules in its source; what is left is a key that two sources share
        shared = merged.groupBy(*AGGREGATE_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        if shared.first() is not None:
            status = "stale"
        else:
            path, rows = f"{root}/versions/{run_id}", sum(n for _, _, n, _ in outcome)
            merged.write.mode("errorifexists").parquet(path)
            pointer = spark.createDataFrame([(run_id, path, rows)], "run_id string, path string, rows long")
            pointer.write.mode("append").parquet(f"{root}/current")
            if mappings:
                contracts.where(F.col("source").isin(*accepted)).write.mode("append").parquet(f"{root}/contracts")
    report = sources.withColumn("run_status", F.lit(status)).withColumn("run_id", F.lit(run_id))
    report.write.mode("append").parquet(f"{root}/status")
    return Published(status, rows, path, sources)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The table of the newest published run."""
    newest = spark.read.parquet(f"{root}/current").agg(F.max_by("path", "run_id").alias("path")).first()["path"]
    return spark.read.parquet(newest)


# ---- source registry ---------------------------------------------------------


def check_transitions(events: DataFrame) -> DataFrame:
    """Every status event of a source with the previous status and the rule it breaks, if any.

    ``events``: source_id, seq (without gaps), status, actor, evidence,
    artifact_sha256, validation_report. The previous status is found by a self join on the
    sequence number, so a source with very many events is not one task's work.
    """
    prior = events.select("source_id", (F.col("seq") + 1).alias("seq"), F.col("status").alias("previous"))
    pairs = F.create_map(*[x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]))])
    start = events.groupBy("source_id").agg(F.min("seq").alias("first_seq"))
    joined = events.join(prior, ["source_id", "seq"], "left").join(start, "source_id")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    allowed = F.when(F.col("previous").isNull(), F.lit(True)).otherwise(
        F.array_contains(F.try_element_at(pairs, F.col("previous")), F.col("status"))
    )
    problem = (
        F.when(~F.col("status").isin(*TRANSITIONS), "UNKNOWN_STATUS")
        .when(F.col("previous").isNull() & (F.col("seq") != F.col("first_seq")), "SEQUENCE_GAP")
        .when(F.col("previous").isNotNull() & (blank("actor") | blank("evidence")), "MISSING_EVIDENCE")
        .when(~F.coalesce(allowed, F.lit(False)), "TRANSITION_NOT_ALLOWED")
        .when((F.col("status") == "connected") & blank("artifact_sha256"), "MISSING_DIGEST")
        .when((F.col("status") == "validated") & blank("validation_report"), "MISSING_REPORT")
    )
    return joined.select("source_id", "seq", "previous", "status", problem.alias("problem"))


def current_status(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def source_overview(configured: DataFrame, manifest: DataFrame) -> DataFrame:
    """Configured sources with manifest file counts and the latest download."""
    seen = manifest.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("manifest_files"), F.max("downloaded_at").alias("last_download")
    )
    joined = configured.join(seen, "source_id", "left")
    files = F.coalesce("manifest_files", F.lit(0))
    return joined.withColumns(
        {"manifest_files": files, "status": F.when(files > 0, "DOWNLOADED").otherwise("CONFIGURED")}
    )


def overview_counts(configured: DataFrame, manifest: DataFrame) -> DataFrame:
    """Configured sources, manifest files and sources with files, as one row."""
    return side_by_side(
        configured.agg(F.count(F.lit(1)).alias("configured_sources")),
        manifest.agg(F.count(F.lit(1)).alias("manifest_files"), F.count_distinct("source_id").alias("raw_sources")),
    )
