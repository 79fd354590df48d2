"""A keyed table in versioned slots: replace, append, upsert and delete as one commit.

Rows lie in slots by a hash of their key.  A commit writes the slots that it changes as new
folders and then one small table that says which folders of each slot count.  Readers
take them from the newest such table that is complete, so a run that dies before it
leaves the old version readable, and its folders are never looked at.  Commits have a
name of their own (``run``): one that was done already changes nothing, whatever it is given.

One writer at a time is assumed.  There is no log, no schema evolution and no planner:
Parquet folders, and a table of their names.

Rows with a null key are kept and can only be appended, as no key equals theirs.  Repeated
rows stay; to ``upsert`` several rows of a key replaces all rows of that key by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.scratch import saved


class Slots:
    """The table at a path.  ``schema`` are its columns, ``key`` the one that rows are replaced by."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, slots: int = 16):
        self.spark, self.path, self.key, self.slots = spark, path.rstrip("/"), key, slots
        self.schema = spark.createDataFrame([], schema).schema

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def newest(self) -> int:
        """Number of the newest complete commit, 0 for none: its table has the mark that Spark writes last."""
        files, path = self._files()
        if not files.exists(path(f"{self.path}/current")):
            return 0
        numbers = sorted((int(s.getPath().getName()[1:]) for s in files.listStatus(path(f"{self.path}/current"))), reverse=True)
        return next((n for n in numbers if files.exists(path(f"{self.path}/current/n{n}/_SUCCESS"))), 0)

    def current(self) -> list[tuple[int, str]]:
        """(slot, run) of the folders that count: a few for each slot."""
        n = self.newest()
        return [] if not n else [tuple(r) for r in self.spark.read.parquet(f"{self.path}/current/n{n}").select("slot", "run").collect()]

    def done(self, run: str) -> bool:
        n = self.newest()
        return bool(n) and not self.spark.read.parquet(f"{self.path}/runs/n{n}").where(F.col("run") == run).isEmpty()

    def read(self, slots: list[int] | None = None) -> DataFrame:
        """The rows that count, of all slots or some."""
        return self._read([(s, r) for s, r in self.current() if slots is None or s in slots])

    def _read(self, folders: list[tuple[int, str]]) -> DataFrame:
        paths = [f"{self.path}/data/{run}/slot={slot}" for slot, run in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def slot(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.slots)).cast("int")

    def commit(self, run: str, add: DataFrame | None = None, drop: DataFrame | None = None) -> bool:
        """Takes out all rows of the keys in ``drop`` and puts in the rows of ``add``; False if that run was done before."""
        if self.done(run):
            return False
        now = self.current()
        names = [f.name for f in self.schema]
        new = None if add is None else saved(add.select(names).withColumn("slot", self.slot()), "slot-rows")
        gone = None if drop is None else saved(drop.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("slot", self.slot()), "slot-keys")
        held = {s for s, _ in now}
        # at most ``slots`` numbers each
        touched = set() if gone is None else {r[0] for r in gone.select("slot").distinct().collect()} & held
        filled = set() if new is None else {r[0] for r in new.select("slot").distinct().collect()}
        rows = new
        if touched:
            old = self._read([(s, r) for s, r in now if s in touched]).withColumn("slot", self.slot())
            kept = old.join(gone.select(self.key), self.key, "left_anti").select(*names, "slot")
            rows = kept if new is None else kept.unionByName(new)
        if rows is not None:
            # a slot with very many rows is cut by Spark, so no task writes all of it
            rows.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/data/{run}")
        files, path = self._files()
        wrote = {s for s in touched | filled if files.exists(path(f"{self.path}/data/{run}/slot={s}"))}
        after = [(s, r) for s, r in now if s not in touched] + [(s, run) for s in sorted(wrote)]
        n = self.newest()
        ran = [] if not n else [r.run for r in self.spark.read.parquet(f"{self.path}/runs/n{n}").collect()]
        self._small([(r,) for r in [*ran, run]], "run string", f"{self.path}/runs/n{n + 1}")
        self._small(after, "slot int, run string", f"{self.path}/current/n{n + 1}")  # the switch
        return True

    def _small(self, rows: list, schema: str, path: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    def append(self, run: str, rows: DataFrame) -> bool:
        return self.commit(run, add=rows)

    def upsert(self, run: str, rows: DataFrame) -> bool:
        """All rows of each key in ``rows`` are replaced by those."""
        return self.commit(run, add=rows, drop=rows)

    def insert(self, run: str, rows: DataFrame) -> bool:
        """Rows whose key is not there yet; of several new rows of a key all are put in."""
        return False if self.done(run) else self.commit(run, add=rows.join(self.read().select(self.key).distinct(), self.key, "left_anti"))

    def delete(self, run: str, keys: DataFrame) -> bool:
        return self.commit(run, drop=keys)

    def vacuum(self) -> int:
        """Deletes folders that no commit names any more; how many there were."""
        files, path = self._files()
        live = {(r, f"slot={s}") for s, r in self.current()}
        gone = 0
        for run in files.listStatus(path(f"{self.path}/data")):
            for slot in files.listStatus(run.getPath()):
                if slot.isDirectory() and (run.getPath().getName(), slot.getPath().getName()) not in live:
                    gone += bool(files.delete(slot.getPath(), True))
        return gone
