"""Data sets as versions in Spark's catalogue.

Each version is a table over files that are written once and never changed; what a version is (its data set, number, time step,
the version it came from) stands in the table's properties, so the catalogue alone tells it, in this session or, with a lasting
metastore, in any. A duplicate is a table over the same files; files go when the last table over them is dropped. No values
pass through text, so missing values stay missing in a duplicate.

Defined results: a name that is not there is a KeyError; committing under a known name makes its next version; nothing to select, or a
series with fewer than two rows, is a ValueError and nothing is stored; removing the active data set leaves none active.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frame
from .scratch import scratch_path


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Version:
    """A version of a data set; step_ms and monthly are those of its dates."""

    dataset: str
    version: int
    table: str
    files: str
    step_ms: int
    irregular: bool
    monthly: bool
    parent: str


class DataSets:
    """The data sets of a database of the session's catalogue. Files lie under ``root``, by default in the folder all machines share."""

    def __init__(self, spark: SparkSession, database: str = "freshet", root: str | None = None):
        self.spark, self.database, self.root = spark, database, root or scratch_path(spark, "datasets")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def _all(self) -> Iterator[Version]:
        for t in self.spark.sql(f"SHOW TABLES IN `{self.database}`").collect():
            if t.isTemporary:
                continue
            p = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES `{self.database}`.`{t.tableName}`").collect()}
            if "freshet.dataset" in p:
                of = lambda k, p=p: p[f"freshet.{k}"]
                yield Version(of("dataset"), int(of("version")), t.tableName, of("files"), int(of("step_ms")), of("irregular") == "true", of("monthly") == "true", of("parent"))

    def versions(self, dataset: str) -> list[Version]:
        """All versions, the newest last."""
        found = sorted((v for v in self._all() if v.dataset == dataset), key=lambda v: v.version)
        if not found:
            raise KeyError(dataset)
        return found

    def names(self) -> list[str]:
        return sorted({v.dataset for v in self._all()})

    def version(self, dataset: str, number: int | None = None) -> Version:
        """A version by its number, or the newest."""
        found = {v.version: v for v in self.versions(dataset)}
        return found[max(found) if number is None else number]

    def _add(self, dataset: str, files: str, step: tuple[int, bool, bool], parent: str) -> Version:
        number = max((v.version for v in self._all() if v.dataset == dataset), default=0) + 1
        table = f"dataset_{uuid.uuid4().hex}"
        v = Version(dataset, number, table, files, *step, parent)
        told = {k: str(x).lower() if isinstance(x, bool) else str(x) for k, x in vars(v).items() if k != "table"}
        properties = ", ".join(f"{_quoted('freshet.' + k)} = {_quoted(x)}" for k, x in told.items())
        self.spark.sql(f"CREATE TABLE `{self.database}`.`{table}` USING parquet LOCATION {_quoted(files)} TBLPROPERTIES ({properties})")
        return v

    def _stored(self, dataset: str, series: DataFrame, parent: str) -> Version:
        files = f"{self.root.rstrip('/')}/{uuid.uuid4().hex}"
        series.write.parquet(files)
        kept = self.spark.read.schema(series.schema).parquet(files)
        least = kept.groupBy("series_id").count().agg(F.min("count")).collect()[0][0]
        if least is None or least < 2:
            self._delete(files)
            raise ValueError("a data set needs two rows or more in each series")
        # Runs of a data set share its dates, so the step is that of all its dates together.
        dates = kept.where("ts is not null").select(F.lit(dataset).alias("series_id"), "ts").distinct()
        step = frame.step(dates).collect()
        return self._add(dataset, files, (step[0].step_ms, step[0].irregular, step[0].monthly) if step else (86_400_000, False, False), parent)

    def save(self, dataset: str, series: DataFrame) -> Version:
        """``series`` (series_id, ts, obs, sim) as the next version of a data set."""
        return self._stored(dataset, series, "")

    def commit(self, dataset: str, source: str, **how) -> Version:
        """A subset of the newest version of ``source`` (see ``frame.subset``) as the next version of ``dataset``, with a step of its own."""
        if not any(x is not None for x in how.values()):
            raise ValueError("a subset needs a selection")
        of = self.version(source)
        return self._stored(dataset, frame.subset(self.read(source), **how), f"{of.dataset}@{of.version}")

    def duplicate(self, dataset: str, copy: str) -> Version:
        """``copy``, a new data set with the newest version's files; what is saved under either name later leaves the other alone."""
        if copy in self.names():
            raise ValueError(f"there is a data set {copy}")
        of = self.version(dataset)
        return self._add(copy, of.files, (of.step_ms, of.irregular, of.monthly), f"{of.dataset}@{of.version}")

    def read(self, dataset: str, number: int | None = None) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{self.version(dataset, number).table}`")

    def remove(self, dataset: str) -> None:
        """All versions go, and their files if nothing else is over them."""
        gone = self.versions(dataset)
        if self.active() == dataset:
            self._set_active("")
        for v in gone:
            self.spark.sql(f"DROP TABLE `{self.database}`.`{v.table}`")
        for files in {v.files for v in gone} - {v.files for v in self._all()}:
            self._delete(files)

    def activate(self, dataset: str) -> None:
        self.version(dataset)
        self._set_active(dataset)

    def active(self) -> str | None:
        """The data set in use, if there is one."""
        told = {r.info_name: r.info_value for r in self.spark.sql(f"DESCRIBE DATABASE EXTENDED `{self.database}`").collect()}
        return bytes.fromhex(told["Comment"]).decode() or None if told.get("Comment") else None

    def _set_active(self, dataset: str) -> None:
        self.spark.sql(f"COMMENT ON DATABASE `{self.database}` IS {_quoted(dataset.encode().hex())}")

    def _delete(self, files: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(files)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
