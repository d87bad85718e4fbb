"""The log of a vector collection as a stream: live vectors kept up to date by micro-batches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.session import shared_dir


class LiveTable:
    """A table of live vectors that micro-batches change, as a base and the changes since, under one path.

    A micro-batch writes the ids it changed and reads the others' presence only; after COMPACT of them the next one writes a
    new base, and what the base holds is removed. Everything is found again from the path: a new object on it, after a
    restart or on another machine, goes on where the last left off. A folder is named after its place in the order, the
    source and the number of the batch; a batch that runs again after a failure is known by the two and changes nothing.
    """

    #: Folders of changes that a read puts together at most.
    COMPACT = 8

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"

    def _folders(self) -> list[tuple[int, str, str, int]]:
        """(place, kind, source, number) of all that was written to its end, in order."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        out = []
        for f in files.listStatus(where):
            parts = f.getPath().getName().split("-")
            if len(parts) == 4 and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out.append((int(parts[0]), parts[1], parts[2], int(parts[3])))
        return sorted(out)

    def _name(self, place: int, kind: str, source: str, number: int) -> str:
        return f"{self.path}/{place:012d}-{kind}-{source}-{number}"

    def _rows(self, folders: list[tuple[int, str, str, int]]) -> DataFrame:
        last = max((i for i, f in enumerate(folders) if f[1] == "base"), default=-1)
        base = self.spark.createDataFrame([], SCHEMA) if last < 0 else self.spark.read.schema(SCHEMA).parquet(self._name(*folders[last]))
        changes = folders[last + 1 :]
        if not changes:
            return base
        rows = base.withColumn("_v", F.lit(-1).cast("bigint"))
        for f in changes:
            rows = rows.union(self.spark.read.schema(SCHEMA).parquet(self._name(*f)).withColumn("_v", F.lit(f[0]).cast("bigint")))
        return rows.groupBy("vec_id").agg(F.max_by(F.struct("embedding"), "_v").alias("_e")).select("vec_id", F.col("_e.embedding").alias("embedding")).where("embedding is not null")

    def read(self) -> DataFrame:
        return self._rows(self._folders())

    def apply(self, batch: DataFrame, number: int, source: str = "0") -> None:
        """Inserts of ids that are there change nothing, deletes of unknown ids neither.

        After a delete in the batch, the first later insert counts; else the stored vector stays, or the first insert.
        """
        folders = self._folders()
        if any(f[2] == source and f[3] >= number for f in folders):
            return
        rows = batch.where("vec_id is not null").select("vec_id", "op", "logged_at", "pos", "embedding").distinct()
        # the last delete of an id, then the first insert behind it: aggregates, so a hot id is never gathered
        gone = rows.where("op = 'delete'").groupBy("vec_id").agg(F.max(F.struct("logged_at", "pos")).alias("_d"))
        known = rows.select("vec_id").distinct().join(gone, "vec_id", "left")
        later = rows.where("op = 'insert' and embedding is not null").join(known, "vec_id").where(F.col("_d").isNull() | (F.struct("logged_at", "pos") > F.col("_d")))
        new = later.groupBy("vec_id").agg(F.min_by(F.struct("embedding"), F.struct("logged_at", "pos")).alias("_new"))
        there = self._rows(folders).select("vec_id", F.lit(True).alias("_there")).join(known.select("vec_id"), "vec_id", "left_semi")
        out = known.join(new, "vec_id", "left").join(there, "vec_id", "left").where("_d is not null or _there is null")
        out = out.where("_new is not null or _there").select("vec_id", F.col("_new.embedding").alias("embedding"))
        place = folders[-1][0] + 1 if folders else 0
        out.write.mode("overwrite").parquet(self._name(place, "changes", source, number))
        self._compact()

    def _compact(self) -> None:
        folders = self._folders()
        last = max((i for i, f in enumerate(folders) if f[1] == "base"), default=-1)
        if len(folders) - last - 1 < self.COMPACT:
            return
        place, _, source, number = folders[-1]
        self._rows(folders).write.mode("overwrite").parquet(self._name(place + 1, "base", source, number))
        newest = {f[2]: f for f in folders}  # of each source the last batch stays known
        for f in folders[:-1]:
            if f != newest[f[2]] and f[0] < place - self.COMPACT:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(self._name(*f))
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


SCHEMA = "vec_id bigint, embedding array<float>"


def follow(stream: DataFrame, live: LiveTable, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Start a query that applies a changelog stream (op, vec_id, embedding, logged_at, pos) to a live table.

    Batches are numbered by checkpoint, so the same checkpoint goes on and a new one starts a source of its own.
    """
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def run(batch: DataFrame, number: int) -> None:
        live.apply(batch, number, source)
        if each:
            each(live.read(), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """(window, op, n): operations by time of logging, with late rows accepted up to `delay` after the latest one seen."""
    return stream.withWatermark("logged_at", delay).groupBy(F.window("logged_at", width), "op").agg(F.count("*").alias("n"))
