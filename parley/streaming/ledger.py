"""Ledger of the ids that a stream has decided: sorted runs, dealt to buckets by the hash of the id.

Every batch adds one run. FAN runs of one level are merged into one of the next, so an id is written again a
logarithmic number of times and there is a logarithmic number of runs. A run has as many buckets as keep each near
BUCKET_IDS ids, and a batch reads only the buckets its own ids fall into: at most its number of ids times BUCKET_IDS in
each run, however long the history is. No state is held between batches, and nothing has to be loaded at a restart.

Each batch leaves a manifest of the live runs, written last. A batch that is repeated after a failure starts from the
manifest before it and overwrites its own folders. Runs that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from parley.session import delete_folder, path_exists, stage

FAN = 8
BUCKET_IDS = 1_000_000
# Beyond so many buckets that a batch falls into, a run is read whole.
LISTED_BUCKETS = 10_000
RUN = "level int, first long, last long, buckets long, ids long"


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int
    buckets: int
    ids: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


class Ledger:
    """Ids below one folder. `kind` is the type of the ids."""

    def __init__(self, spark: SparkSession, folder: str, kind: DataType) -> None:
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def runs(self, batch: int) -> list[Run]:
        """Live runs behind a batch; one row per run."""
        if batch < 0:
            return []
        rows = self.spark.read.schema(RUN).parquet(f"{self.folder}/manifest/{batch}").collect()
        return sorted((Run(**r.asDict()) for r in rows), key=lambda r: r.first)

    def has(self, batch: int) -> bool:
        return batch < 0 or path_exists(self.spark, f"{self.folder}/manifest/{batch}")

    def paths(self, ids: DataFrame, runs: list[Run]) -> list[str]:
        """Folders of the buckets that ids (column _id) fall into."""
        if not runs:
            return []
        sizes = sorted({r.buckets for r in runs})
        hits = ids.agg(*[F.collect_set(_bucket("_id", n)).alias(str(n)) for n in sizes if n <= LISTED_BUCKETS] or [F.count("*")]).first()
        whole, some = [], {}
        for run in runs:
            folder = f"{self.folder}/{run.name}"
            if run.buckets == 1 or run.buckets > LISTED_BUCKETS:
                whole.append(folder)
            else:
                some[folder] = {f"bucket={b}" for b in hits[str(run.buckets)]}
        return whole + [f"{folder}/{b}" for folder, asked in some.items() for b in sorted(asked & self._held(folder))]

    def _held(self, folder: str) -> set[str]:
        """Names of the buckets of a run that hold a file."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return {r[0] for r in files.select(F.regexp_extract("path", r"/(bucket=\d+)/[^/]*$", 1)).distinct().collect()}

    def seen(self, ids: DataFrame, batch: int) -> DataFrame:
        """_id: those of `ids` that a batch before this one decided."""
        paths = self.paths(ids, self.runs(batch - 1))
        if not paths:
            return ids.limit(0)
        known = self.spark.read.schema(f"known {self.kind.simpleString()}").option("recursiveFileLookup", True).parquet(*paths)
        return ids.join(known, F.col("_id") == F.col("known"), "left_semi")

    def _write(self, ids: DataFrame, run: Run) -> Run:
        """Write ids (column known) as a run; its number of buckets follows from its number of ids."""
        run = replace(run, buckets=max(1, -(-run.ids // BUCKET_IDS)))
        dealt = ids.withColumn("bucket", _bucket("known", run.buckets))
        # One file per bucket: rows are dealt by it.
        (
            dealt.repartition("bucket")
            .sortWithinPartitions("bucket", "known")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.folder}/{run.name}")
        )
        return run

    def add(self, ids: DataFrame, batch: int) -> None:
        """Add the ids (column _id, not null, each once) that a batch decided."""
        before = self.runs(batch - 1)
        ids = ids.select(F.col("_id").alias("known"))
        n = ids.count()
        runs = [*before, self._write(ids, Run(0, batch, batch, 1, n))] if n else list(before)
        level = 0
        while len(same := [r for r in runs if r.level == level]) >= FAN:
            paths = [f"{self.folder}/{r.name}" for r in same]
            whole = self.spark.read.schema(f"known {self.kind.simpleString()}").option("recursiveFileLookup", True).parquet(*paths)
            merged = Run(level + 1, same[0].first, same[-1].last, 1, sum(r.ids for r in same))
            runs = [r for r in runs if r.level != level] + [self._write(whole, merged)]
            level += 1
        self._commit(batch, runs)
        # The batch before is done for good, so what only earlier manifests name is not needed any more.
        if batch >= 2 and self.has(batch - 2):
            live = {r.name for r in [*runs, *before]}
            for run in self.runs(batch - 2):
                if run.name not in live:
                    delete_folder(self.spark, f"{self.folder}/{run.name}")
            delete_folder(self.spark, f"{self.folder}/manifest/{batch - 2}")

    def _commit(self, batch: int, runs: list[Run]) -> None:
        rows = [(r.level, r.first, r.last, r.buckets, r.ids) for r in runs]
        self.spark.createDataFrame(rows, RUN).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch}")

    def rebuild(self, ids: DataFrame, batch: int) -> None:
        """Start from the ids (column _id) of all batches up to this one, where no manifest is left."""
        ids = stage(ids.select(F.col("_id").alias("known")).where("known is not null").distinct(), "ledger")
        n = ids.count()
        self._commit(batch, [self._write(ids, Run(0, 0, batch, 1, n))] if n else [])
