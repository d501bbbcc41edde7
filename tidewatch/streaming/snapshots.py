"""A keyed table kept by a stream: each micro-batch merges into the version before it and becomes the next version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshot:
    """Versions of a table in one folder, ``version=N`` each. A version counts once its writer has committed it (_SUCCESS).

    A batch's version is its number, made from the newest version below it: a retry starts from the same state and replaces
    its own half-written or whole result, so every batch counts once, whatever fails. Readers see the newest whole version.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3) -> None:
        if keep < 2:
            raise ValueError("a retry needs the version before")
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n.removeprefix("version=").isdigit()]
        return sorted(n for n in numbers if self._fs.exists(self._path(f"{self._at(n)}/_SUCCESS")))

    def _at(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def read(self, below: int | None = None) -> DataFrame | None:
        """The newest version, or the newest under ``below``; None where there is none."""
        known = [v for v in self.versions() if below is None or v < below]
        return self.spark.read.parquet(self._at(known[-1])) if known else None

    def merge(self, batch: DataFrame, number: int, how: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
        """Version ``number``: ``how(batch, the table before)``. Old versions beyond ``keep`` are removed."""
        how(batch, self.read(below=number)).write.mode("overwrite").parquet(self._at(number))
        for old in [v for v in self.versions() if v <= number][: -self.keep]:
            self._fs.delete(self._path(self._at(old)), True)


def upserting(snapshot: Snapshot, how: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge every batch into the snapshot."""
    return lambda batch, number: snapshot.merge(batch, number, how)
