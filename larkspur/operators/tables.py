"""Tables in the folder that driver and executors share, and stores of parents with child rows that change at once.

A store is a folder with a folder for each version; a version has a table of parents and one of children. A write makes
the next version whole and then puts its marker, one small file made by Hadoop's atomic rename; readers take the newest
version that has a marker. So a reader sees a document with all its chunks as they were, or as they are now, and never
half; a job that breaks between the two tables leaves a folder without marker, which the next write passes over and
`cleared` removes. Two writers that race for one version can't both rename to its marker: the later one gets an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where it is unset and executors are threads of the driver."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def held(df: DataFrame, tag: str = "held") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Parents and their children, in versions under a folder."""

    def __init__(self, spark: SparkSession, path: str, parent: str = "documents", child: str = "chunks", key: str = "document_id"):
        self.spark, self.path, self.parent, self.child, self.key = spark, path.rstrip("/"), parent, child, key
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _numbers(self, pattern: str) -> list[int]:
        there = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(pattern, n)))

    def versions(self) -> list[int]:
        """Versions that are whole, ascending."""
        return self._numbers(r"v(\d+)\.done")

    def folder(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Parents and children of the newest version, or of the one that is asked for."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise LookupError(f"no such version in {self.path}")
        at = self.folder(known[-1] if version is None else version)
        return tuple(self.spark.read.parquet(f"{at}/{name}") for name in (self.parent, self.child))

    def write(self, parents: DataFrame, children: DataFrame) -> int:
        """A new version with just these rows."""
        version = max([0, *self._numbers(r"v(\d+)(?:-[0-9a-f]+)?(?:\.done)?")]) + 1
        draft = f"{self.folder(version)}-{uuid.uuid4().hex}"
        parents.write.parquet(f"{draft}/{self.parent}")
        children.write.parquet(f"{draft}/{self.child}")
        if not self._fs.rename(self._path(draft), self._path(self.folder(version))) or self._fs.exists(self._path(f"{self.folder(version)}/{draft.rpartition('/')[2]}")):
            raise RuntimeError(f"version {version} was written by someone else meanwhile")
        mark = self._path(f"{self.folder(version)}.done")
        if not self._fs.createNewFile(mark):
            raise RuntimeError(f"version {version} was marked by someone else meanwhile")
        return version

    def replace(self, parents: DataFrame, children: DataFrame) -> int:
        """Puts parents and all their children over those of the same key; a null key is a key like any other. Children
        of parents that aren't given stay. Of parents with equal keys one must be chosen before."""
        if not self.versions():
            return self.write(parents, children)
        old_parents, old_children = self.read()
        given = parents.select(F.col(self.key).alias("_key")).distinct()
        kept = lambda df: df.join(given, df[self.key].eqNullSafe(given["_key"]), "left_anti")
        return self.write(kept(old_parents).unionByName(parents, allowMissingColumns=True), kept(old_children).unionByName(children, allowMissingColumns=True))

    def removed(self, keys: DataFrame) -> int:
        """Drops parents, of a table with the key, and all their children."""
        old_parents, old_children = self.read()
        given = keys.select(F.col(self.key).alias("_key")).distinct()
        kept = lambda df: df.join(given, df[self.key].eqNullSafe(given["_key"]), "left_anti")
        return self.write(kept(old_parents), kept(old_children))

    def cleared(self, keep: int = 1) -> list[str]:
        """Deletes drafts of broken jobs and all but the newest versions; the names of what went. Not beside a writer."""
        known = self.versions()
        alive = {n for v in known[-keep:] for n in (f"v{v}", f"v{v}.done")}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName() not in alive]
        for p in gone:
            self._fs.delete(p, True)
        return sorted(p.getName() for p in gone)
