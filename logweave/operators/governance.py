"""Registries, releases, seals and state logs, as tables and checks over them.

Each check returns the rows that break it, so an empty result is a pass; require() turns it into an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.vocabulary import PROTOCOL_STATES, PROTOCOL_STEPS, REGISTRY_FIELDS, REGISTRY_STATUSES

RELEASE_FILES = ("RELEASE_LOCKED", "thresholds.json", "calibration.json", "model_hashes.json", "release_manifest.json")
RELEASE_INPUTS = RELEASE_FILES[1:]
CHECKPOINTS = "checkpoints/%.pt"


class Violation(RuntimeError):
    """A rule was broken."""


def require(found: DataFrame, what: str, show: int = 5) -> None:
    """Raises Violation with the first few rows if there are any."""
    if rows := found.limit(show).collect():
        raise Violation(f"{what}: {'; '.join(str(r.asDict()) for r in rows)}")


def registry_violations(entries: DataFrame, id_col: str = "dataset_id") -> DataFrame:
    """(dataset_id, violation) of registry rows: a field missing, a status unknown, a target whose labels aren't for evaluation only."""
    has = set(entries.columns)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) if c in has else F.lit(c) for c in sorted(REGISTRY_FIELDS)]))
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    found = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields "), F.array_join(missing, ","))),
        F.when(~col("status").isin(*REGISTRY_STATUSES), F.concat(F.lit("invalid status "), col("status"))),
        F.when((col("role") == "target_test") & ~col("allowed_label_usage").eqNullSafe(F.lit("evaluation_only_p1")), F.lit("target label usage must be evaluation_only_p1")),
    ))
    return entries.select(id_col, F.explode(found).alias("violation"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry kept as JSON lines, one dataset each. An empty or invalid one raises."""
    entries = spark.read.schema(", ".join(f"{c} string" for c in ("dataset_id", *REGISTRY_FIELDS, "local_path"))).json(path)
    if entries.isEmpty():
        raise Violation("the registry is empty")
    require(registry_violations(entries), "registry")
    return entries


def file_hashes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, bytes, sha256) of files, which Spark reads whole, one to a task's row; up to 2 GB each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release_selection(entries: DataFrame, hashes: DataFrame | None = None, variant: str = "strict", excluded: tuple[str, ...] = (), strict_excluded: tuple[str, ...] = ()) -> DataFrame:
    """Datasets of a release: none of tier target, none of `excluded`, in the strict variant none of `strict_excluded`; with the local file's hash if known."""
    out = entries.where(~F.col("tier").eqNullSafe(F.lit("target")) & ~F.col("dataset_id").isin(*excluded, *(strict_excluded if variant == "strict" else ()), ""))
    if hashes is None:
        return out.withColumn("local_sha256", F.lit(None).cast("string"))
    return out.join(hashes.select(F.col("path").alias("local_path"), F.col("sha256").alias("local_sha256")), "local_path", "left")


def missing_artifacts(files: DataFrame, required: tuple[str, ...] = RELEASE_FILES, checkpoints: str | None = None) -> DataFrame:
    """(name) of required files, and of the pattern of checkpoints, that a listing (path) lacks. Names count from a path's end."""
    names = files.sparkSession.createDataFrame([(n,) for n in (*required, *([checkpoints] if checkpoints else []))], "name string")
    have = names.join(files.select("path"), F.expr("concat('/', path) like concat('%/', name)"), "left_semi")
    return names.exceptAll(have)


def lock_release(spark: SparkSession, root: str) -> DataFrame:
    """Hashes of a complete release's files; raises if one is missing. Whoever calls writes them beside a RELEASE_LOCKED marker."""
    found = file_hashes(spark, root)
    require(missing_artifacts(found, RELEASE_INPUTS, CHECKPOINTS), "release lacks")
    return found


def seal(predictions: DataFrame, release_files: DataFrame, release_id: str) -> DataFrame:
    """(status, release_id, path, sha256) of prediction files (path, sha256); raises unless the release is locked and complete."""
    require(missing_artifacts(release_files), "release isn't locked, it lacks")
    return predictions.select(F.lit("PREDICTIONS_SEALED").alias("status"), F.lit(release_id).alias("release_id"), "path", "sha256")


def tampered(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """(path, reason): sealed files that are gone or changed, and rows that aren't sealed. `now`: path, sha256."""
    both = sealed.join(now.select("path", F.col("sha256").alias("found")), "path", "left")
    reason = F.when(~F.col("status").eqNullSafe(F.lit("PREDICTIONS_SEALED")), "not_sealed").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return both.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def illegal_transitions(log: DataFrame, key: str, state: str, order: list[str], steps: tuple = PROTOCOL_STEPS, first: str | None = PROTOCOL_STATES[0]) -> DataFrame:
    """Rows of a state log whose state may not follow the one before, with that as `previous`; a key starts from `first`, or anywhere if that is None."""
    w = W.partitionBy(key).orderBy(*order)
    moved = log.withColumn("previous", F.lag(state).over(w) if first is None else F.coalesce(F.lag(state).over(w), F.lit(first)))
    legal = F.lit(False)
    for a, b in steps:
        legal = legal | ((F.col("previous") == a) & (F.col(state) == b))
    return moved.where(F.col("previous").isNotNull() & ~legal)


def run_summary(manifests: DataFrame) -> DataFrame:
    """One row a stage: input and output counts, rejected, and whether the hash of what it read is that of what was written."""
    made = manifests.select(F.col("output_path").alias("input_path"), F.col("output_sha256").alias("made"))
    out = manifests.join(made.dropDuplicates(["input_path"]), "input_path", "left")
    return out.select("stage", "input_count", "output_count", "rejected_count", F.coalesce(F.col("made") == F.col("input_sha256"), F.col("made").isNull()).alias("upstream_unchanged"))
