"""A stored table that is merged by key, batch by batch, at the cost of the batch.

Rows lie in hash buckets of their key, which is never null; a large bucket is written by several tasks, a file each.  A batch is written beside the table as
a delta, in the buckets that it touches; it replaces all rows of the keys it
brings, and its tombstones leave keys without rows.  Readers put the base and
the deltas together: of each key the rows of the last batch that has it, or of
the first one in a table that keeps what it has.  Compaction writes the buckets
that have deltas, and only these, as new base files.

What counts is listed in `commits`, one small file for each step, written
after its data.  A batch that was cut off is not listed, so no reader sees it;
its next run writes the same folder.  A batch that is listed is not applied again.

    table = KeyedTable(spark, path, ["source_id"])
    table.merge(batch, number, gone=ids)        # e.g. in foreachBatch
    table.read()
    table.compact(number)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

COMMIT = "step long, kind string, bucket int"
BATCH, GONE, BUCKET = "_batch", "_gone", "_bucket"


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    keys: list[str]
    #: Fixed when the table is first written.
    buckets: int = 64
    #: The first batch that has a key wins, and later ones change nothing.
    insert_only: bool = False

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[tuple[int, str, int | None]]:
        """(step, kind, bucket) of all that counts; one row for a batch, one for each bucket of a compaction."""
        try:
            return [tuple(r) for r in self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*").collect()]
        except AnalysisException:  # nothing is committed yet
            return []

    def _commit(self, step: int, kind: str, buckets: list[int | None]) -> None:
        rows = self.spark.createDataFrame([(step, kind, b) for b in buckets], COMMIT)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{kind}{step}")

    def merge(self, batch: DataFrame, step: int, gone: DataFrame | None = None) -> None:
        """Apply batch number `step`, which is above all former ones: its rows replace those of their keys, and the keys in `gone` go.

        A key in both keeps the batch's rows.  An empty batch counts as applied.
        """
        if any(s == step and kind == "batch" for s, kind, _ in self.commits()):
            return
        rows = batch.withColumn(GONE, F.lit(False))
        if gone is not None:
            left = gone.select(*self.keys).distinct().join(batch.select(*self.keys).distinct(), self.keys, "left_anti")
            rows = rows.unionByName(left.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        rows.withColumn(BATCH, F.lit(step).cast("long")).withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta/{step}")
        self._commit(step, "batch", [None])

    def _schema(self) -> StructType:
        """Of the delta that was written last; later batches may have more columns."""
        last = max(s for s, kind, _ in self.commits() if kind == "batch")
        return self.spark.read.parquet(f"{self.path}/delta/{last}").schema

    def _files(self, folders: list[str], schema: StructType) -> DataFrame | None:
        """What the folders hold, with _bucket from their names; None if there is no file (a batch without rows)."""
        out = None
        for folder in folders:
            try:
                self.spark.read.parquet(folder)
            except AnalysisException:
                continue
            df = self.spark.read.schema(schema).parquet(folder)
            out = df if out is None else out.unionByName(df)
        return out

    def _parts(self, schema: StructType) -> tuple[DataFrame | None, DataFrame | None, list[int]]:
        """The base, the deltas that are not in it yet, and the step up to which each bucket is in the base."""
        done = [-1] * self.buckets
        for step, kind, bucket in self.commits():
            if kind == "compact" and bucket is not None:
                done[bucket] = max(done[bucket], step)
        steps = sorted({s for s in done if s >= 0})
        base = self._files([f"{self.path}/base/{s}" for s in steps], StructType([*schema.fields, StructField("_at", schema[BATCH].dataType)]))
        last = F.get(F.array(*(F.lit(d).cast("long") for d in done)), F.col(BUCKET))
        if base is not None:
            base = base.where(F.col("_at") == last).drop("_at")
        new = sorted(s for s, kind, _ in self.commits() if kind == "batch" and s > min(done))
        delta = self._files([f"{self.path}/delta/{s}" for s in new], schema)
        return base, None if delta is None else delta.where(F.col(BATCH) > last), done

    def _merged(self, base: DataFrame | None, delta: DataFrame | None) -> DataFrame | None:
        """Base and deltas with their bookkeeping, tombstones too.

        Keys and batches of the deltas alone decide, so the base is neither
        sorted nor shuffled where these are small enough to be sent.
        """
        if delta is None:
            return base
        best = (F.min if self.insert_only else F.max)(BATCH).alias("_best")
        chosen = delta.groupBy(*self.keys).agg(best)
        if self.insert_only and base is not None:
            chosen = chosen.join(base.select(*self.keys).distinct(), self.keys, "left_anti")
        winners = delta.join(chosen, self.keys).where(F.col(BATCH) == F.col("_best")).select(delta.columns)
        if base is None:
            return winners
        return (base if self.insert_only else base.join(chosen, self.keys, "left_anti")).select(delta.columns).unionByName(winners)

    def read(self) -> DataFrame | None:
        """The table as of its last commit, None before the first."""
        if not any(kind == "batch" for _, kind, _ in self.commits()):
            return None
        schema = self._schema()
        base, delta, _ = self._parts(schema)
        merged = self._merged(base, delta)
        if merged is None:
            merged = self.spark.createDataFrame([], schema)
        return merged.where(~F.col(GONE)).drop(GONE, BATCH, BUCKET)

    def pending(self) -> int:
        """How many batches some bucket has not taken into its base."""
        steps = self.commits()
        last = max((s for s, kind, _ in steps if kind == "compact"), default=-1)
        return sum(kind == "batch" and s > last for s, kind, _ in steps)

    def compact(self) -> list[int]:
        """Take all deltas into the base of the buckets that they touch, and list those; other buckets are not read.

        Tombstones end here.  A reader of the old files keeps a whole table, as none is changed.
        """
        steps = [s for s, kind, _ in self.commits() if kind == "batch"]
        if not steps:
            return []
        schema, step = self._schema(), max(steps)
        base, delta, _ = self._parts(schema)
        if delta is None:
            return []
        touched = sorted(r[0] for r in delta.select(BUCKET).distinct().collect())
        if not touched:
            return []
        merged = self._merged(None if base is None else base.where(F.col(BUCKET).isin(touched)), delta).where(~F.col(GONE))
        merged.withColumn("_at", F.lit(step).cast("long")).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/base/{step}")
        self._commit(step, "compact", touched)
        return touched
