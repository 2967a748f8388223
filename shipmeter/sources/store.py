"""The keyed store of pull-request records.

Every load appends the new and changed rows; a read takes the latest version per
key.  An upsert therefore reads only keys and hashes of what is stored and writes
only what changed, however large the repository is.  Dropping a repository
appends a mark that hides its older versions.  ``compact`` writes the current
rows to a new place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipmeter import KEYS
from shipmeter.functions.hashing import pr_change_hash
from shipmeter.schemas import CI_RUN, PULL_REQUEST, conform
from shipmeter.session import materialize

VERSION = T.StructType(
    PULL_REQUEST.fields
    + [
        T.StructField("ci_digest", T.StringType()),
        T.StructField("ci_run_count", T.LongType()),
        T.StructField("_cache_hash", T.StringType()),
        T.StructField("_cached_at", T.TimestampType()),
    ]
)
#: A stored CI run; ``_cached_at`` names the version of the pull request it belongs to.
RUNS = T.StructType(
    [
        T.StructField("repository", T.StringType()),
        T.StructField("pr_number", T.LongType()),
        T.StructField("ordinal", T.LongType()),
        *CI_RUN.fields,
        T.StructField("_cached_at", T.TimestampType()),
    ]
)
_CLEARS = T.StructType(
    [T.StructField("repository", T.StringType()), T.StructField("_cleared_at", T.TimestampType())]
)


def storable(rows: DataFrame) -> DataFrame:
    """Rows with a key that are merged or have CI runs."""
    has_ci = F.coalesce(F.col("ci_run_count"), F.lit(0)) > 0
    return rows.where(F.col("pr_number").isNotNull() & (F.col("merged_at").isNotNull() | has_ci))


def with_ci(prs: DataFrame, digests: DataFrame, keys=KEYS) -> DataFrame:
    """Records with count and digest of their runs.  A full join, so runs without a
    record still get a minimal one."""
    return prs.join(digests, list(keys), "full_outer")


def with_hash(rows: DataFrame) -> DataFrame:
    """The hash covers the CI digest: new runs on an unchanged PR are a change."""
    return rows.withColumn("_cache_hash", pr_change_hash(F.col("ci_digest")))


def latest(versions: DataFrame, keys=KEYS) -> DataFrame:
    """The last version per key.  The rank is cut before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_cached_at"), "_cache_hash")
    return versions.withColumn("_v", F.row_number().over(order)).where(F.col("_v") == 1).drop("_v")


def action(stored_hash: Column, new_hash: Column) -> Column:
    return (
        F.when(new_hash.isNull(), "keep")
        .when(stored_hash.isNull(), "insert")
        .when(stored_hash == new_hash, "skip")
        .otherwise("update")
    )


def last_of_each(incoming: DataFrame, keys=KEYS, order: str | None = None) -> DataFrame:
    """One incoming row per key: the last by ``order``, ties by the greater hash."""
    by = [F.desc(order)] if order else []
    rank = Window.partitionBy(*keys).orderBy(*by, F.desc("_cache_hash"))
    return incoming.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") == 1).drop("_n")


def changes(stored: DataFrame, incoming: DataFrame, keys=KEYS) -> DataFrame:
    """The incoming rows that are new or differ from their stored version."""
    known = stored.select(*keys, F.col("_cache_hash").alias("_known"))
    return (
        incoming.join(known, list(keys), "left")
        .where(F.col("_known").isNull() | (F.col("_known") != F.col("_cache_hash")))
        .drop("_known")
    )


def merge(stored: DataFrame, incoming: DataFrame, keys=KEYS) -> DataFrame:
    """The whole table after an upsert, with what happened to each key."""
    keys = list(keys)
    others = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*others).alias("_old"))
    new = last_of_each(incoming, keys).select(*keys, F.struct(*others).alias("_new"))
    both = old.join(new, keys, "full_outer")
    chosen = action(F.col("_old._cache_hash"), F.col("_new._cache_hash"))
    row = F.when(chosen.isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    return both.select(*keys, chosen.alias("action"), row.alias("_row")).select(
        *keys, "action", "_row.*"
    )


def without_repository(stored: DataFrame, repository: str) -> DataFrame:
    return stored.where(F.col("repository") != repository)


class _Lost(Exception):
    """Another load committed the version this one was made for."""


@dataclass(frozen=True)
class Store:
    """A store below ``path``, on storage that all executors see.

    Loads are atomic.  Each writes its files into a folder of its own and becomes
    visible by one small manifest, ``_log/<version>.json``, created only if that version
    is still free: readers see exactly the loads of committed manifests.  A load that
    breaks before its manifest leaves files that nothing reads.  Two loads that both
    start from version v cannot both commit v + 1; the one that loses computes its
    changes again on the new state and tries the next version.  Creating the manifest
    must fail when it exists, as it does on HDFS and local disks.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = KEYS

    # --- the log ---------------------------------------------------------------

    def _committed(self, upto: int | None = None) -> list[tuple[int, str, list[str]]]:
        """(version, load folder, parts) of committed loads, oldest first."""
        fs, jvm = self._fs()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        if not fs.exists(log):
            return []
        entries = self.spark.read.schema("version long, load string, parts array<string>").json(f"{self.path}/_log")
        found = sorted((r["version"], r["load"], list(r["parts"])) for r in entries.collect())
        return [e for e in found if upto is None or e[0] <= upto]

    def _version(self) -> int:
        done = self._committed()
        return done[-1][0] if done else 0

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _commit(self, version: int, load: str, parts: list[str]) -> None:
        """Create the manifest of ``version``; raise ``_Lost`` if another load has it."""
        fs, jvm = self._fs()
        name = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{version:012d}.json")
        try:
            out = fs.create(name, False)
        except Exception as e:  # py4j wraps the Java exception
            java = getattr(e, "java_exception", None)
            if java is not None and java.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise _Lost() from e
            raise
        out.writeBytes(json.dumps({"version": version, "load": load, "parts": parts}))
        out.close()

    # --- reading ----------------------------------------------------------------

    def _read(self, name: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
        folders = [f"{self.path}/{name}/load={load}" for _, load, parts in self._committed(upto) if name in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*folders)
        return read.select(*schema.fieldNames())
    def versions(self, upto: int | None = None) -> DataFrame:
        """All versions that no later clear hides, as of a committed version (the last)."""
        cleared = (
            self._read("clears", _CLEARS, upto).groupBy("repository").agg(F.max("_cleared_at").alias("_cleared_at"))
        )
        kept = self._read("versions", VERSION, upto).join(cleared, "repository", "left")
        return kept.where(
            F.col("_cleared_at").isNull() | (F.col("_cached_at") > F.col("_cleared_at"))
        ).drop("_cleared_at")

    def rows(self, repositories: list[str] | None = None) -> DataFrame:
        versions = self.versions()
        if repositories is not None:
            versions = versions.where(F.col("repository").isin(*repositories))
        return latest(versions, self.keys)

    def pr_keys(self, with_ci_only: bool = False) -> DataFrame:
        rows = self.rows()
        return (rows.where(F.col("ci_run_count") > 0) if with_ci_only else rows).select(*self.keys)

    def upsert(
        self, incoming: DataFrame, at: datetime, runs: DataFrame | None = None, between: Callable[[], None] | None = None
    ) -> None:
        """Append what is new or changed, with its CI runs, as one load.  Running it again
        appends nothing.

        Of several incoming rows with one key one is taken.  Only the stored rows of the
        incoming repositories are read.  ``between`` runs once, after the runs are
        written and before the versions are: a load that fails there leaves nothing
        visible, and one that commits there makes this load start again on its state.
        """
        keys = list(self.keys)
        rows = with_hash(storable(conform(incoming, VERSION))).withColumn("_cached_at", F.lit(at))
        touched = rows.select("repository").distinct()
        while True:
            version = self._version()
            heads = latest(self.versions(version).join(touched, "repository", "left_semi"), keys)
            new = changes(heads.select(*keys, "_cache_hash"), last_of_each(rows, keys), keys)
            new = materialize(new.select(*VERSION.fieldNames()), "upsert")
            if new.isEmpty():
                return
            load, parts = uuid.uuid4().hex, ["versions"]
            if runs is not None:
                stamped = runs.join(new.select(*keys, "_cached_at"), keys)
                self._append(stamped.select(*RUNS.fieldNames()), "runs", load)
                parts.append("runs")
            if between is not None:
                hook, between = between, None
                hook()
            self._append(new, "versions", load)
            try:
                self._commit(version + 1, load, parts)
                return
            except _Lost:
                continue

    def _append(self, rows: DataFrame, name: str, load: str) -> None:
        (
            rows.hint("rebalance", "repository")
            .write.mode("append")
            .partitionBy("repository")
            .parquet(f"{self.path}/{name}/load={load}")
        )

    def runs(self, repositories: list[str] | None = None) -> DataFrame:
        """The CI runs of the current rows."""
        keys = list(self.keys)
        current = self.rows(repositories).select(*keys, "_cached_at")
        return self._read("runs", RUNS).join(current, [*keys, "_cached_at"]).drop("_cached_at")

    def clear(self, repository: str, at: datetime) -> int:
        """Hide all rows of a repository, as one load; returns how many there were."""
        load = uuid.uuid4().hex
        mark = self.spark.createDataFrame([(repository, at)], _CLEARS)
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/clears/load={load}")
        while True:
            version = self._version()
            try:
                self._commit(version + 1, load, ["clears"])
            except _Lost:
                continue
            return latest(self.versions(version).where(F.col("repository") == repository), self.keys).count()

    def compact(self, path: str) -> Store:
        """The current rows and their runs as the only versions of a new store."""
        keys = list(self.keys)
        copy = Store(self.spark, path, self.keys)
        current = materialize(self.rows(), "current")
        stamped = self._read("runs", RUNS).join(current.select(*keys, "_cached_at"), [*keys, "_cached_at"])
        load = uuid.uuid4().hex
        copy._append(stamped.select(*RUNS.fieldNames()), "runs", load)
        copy._append(current, "versions", load)
        copy._commit(copy._version() + 1, load, ["versions", "runs"])
        return copy
