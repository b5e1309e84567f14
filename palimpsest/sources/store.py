"""Tables that many jobs read while one job replaces them: generations behind an atomically moved pointer.

Tables are folders of Parquet, written whole and never changed. A generation is a small file that names its tables and
their schemas; two generations may share a table. ``CURRENT`` names the generation that readers get. It is replaced by
one atomic step (a rename that overwrites, or on an object store, whose renames are copies, a single put), and only
after the generation was found sound, so a reader sees the old tables or the new ones and nothing between. A writer
that dies leaves tables that no generation names. Readers that want the same tables for longer pin the generation;
pinned ones are not retired.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and Spark runs in this
    process a temporary folder is made and set as checkpoint folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Files:
    """The few file operations that are needed, through the file system that the path belongs to."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def _local(self, where, fs) -> str | None:
        """A local file's name. Spark's local file system keeps checksums in files of their own, which a rename moves in a
        second step; without them it is one step."""
        return where.toUri().getPath() if fs.getScheme() == "file" else None

    def read(self, path: str) -> str | None:
        where, fs = self._open(path)
        if local := self._local(where, fs):
            return Path(local).read_text() if os.path.exists(local) else None
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        where, fs = self._open(path)
        if local := self._local(where, fs):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            Path(local).write_text(text)
            return
        stream = fs.create(where, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """The file holds the old text or the new one at any time."""
        where, fs = self._open(path)
        if fs.getScheme() in ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs"):
            return self.write(path, text)  # one put; nothing is seen before it is complete
        self.write(new := f"{path}.{uuid.uuid4().hex}", text)
        if local := self._local(where, fs):
            os.replace(self._open(new)[0].toUri().getPath(), local)
            return
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = rename.getField("OVERWRITE").get(None)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self._conf)
        context.rename(self._jvm.org.apache.hadoop.fs.Path(new), where, options)

    def names(self, path: str) -> list[str]:
        where, fs = self._open(path)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in found if not n.startswith(".") and n.count(".") == 0)

    def exists(self, path: str) -> bool:
        where, fs = self._open(path)
        return fs.exists(where)

    def delete(self, path: str) -> None:
        where, fs = self._open(path)
        fs.delete(where, True)


Write = Callable[[DataFrame, str], None]


def _plain(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


@dataclass(frozen=True)
class Table:
    """A written table: its folder below the store's root, and its schema."""

    path: str
    schema: dict


@dataclass(frozen=True)
class Snapshot:
    """One generation's tables; reading them never looks at the pointer again."""

    spark: SparkSession
    root: str
    name: str
    tables: dict[str, Table]
    facts: dict

    def table(self, name: str) -> DataFrame:
        found = self.tables[name]
        return self.spark.read.schema(T.StructType.fromJson(found.schema)).parquet(f"{self.root}/{found.path}")


class Store:
    """Generations of a set of tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def write(self, name: str, df: DataFrame, write: Write = _plain) -> Table:
        """Write a table that no generation names yet."""
        path = f"tables/{uuid.uuid4().hex}/{name}"
        write(df, f"{self.root}/{path}")
        return Table(path, df.schema.jsonValue())

    def read(self, table: Table) -> DataFrame:
        return Snapshot(self.spark, self.root, "", {"it": table}, {}).table("it")

    def commit(self, tables: Mapping[str, Table], facts: dict | None = None) -> Snapshot:
        """Make a generation of written tables. Readers don't get it before ``promote``."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.files.replace(f"{self.root}/generations/{name}", json.dumps({"tables": {k: [t.path, t.schema] for k, t in tables.items()}, "facts": facts or {}}))
        return self.snapshot(name)

    def snapshot(self, name: str) -> Snapshot:
        found = self.files.read(f"{self.root}/generations/{name}")
        if found is None:
            raise ValueError(f"there is no generation {name} under {self.root}")
        found = json.loads(found)
        return Snapshot(self.spark, self.root, name, {k: Table(*t) for k, t in found["tables"].items()}, found["facts"])

    def promote(self, built: Snapshot, sound: Callable[[Snapshot], bool] | None = None) -> None:
        """Let readers get a generation from now on, if ``sound`` finds it so."""
        self.snapshot(built.name)
        if sound and not sound(built):
            raise ValueError(f"generation {built.name} is not sound; readers keep the one they have")
        self.files.replace(f"{self.root}/CURRENT", built.name)

    def current(self) -> Snapshot | None:
        name = self.files.read(f"{self.root}/CURRENT")
        return self.snapshot(name) if name else None

    @contextmanager
    def pinned(self, lease_s: float = 3600) -> Iterator[Snapshot]:
        """The current generation, which is kept until the block ends, or the lease does if the reader dies."""
        while True:
            now = self.current()
            if now is None:
                raise ValueError(f"nothing was promoted under {self.root}")
            self.files.write(pin := f"{self.root}/pins/{now.name}/{uuid.uuid4().hex}", str(time.time() + lease_s))
            if self.files.exists(f"{self.root}/generations/{now.name}"):
                break
            self.files.delete(pin)  # retired between the two steps
        try:
            yield now
        finally:
            self.files.delete(pin)

    def retire(self, keep: int = 0) -> list[str]:
        """Forget generations older than the current one, but the ``keep`` newest of them and those that are pinned, and
        delete tables that only they named. Newer ones may be about to be promoted and stay."""
        now, names = self.files.read(f"{self.root}/CURRENT"), self.files.names(f"{self.root}/generations")
        older = [n for n in names if now and n < now]
        gone = []
        for name in older[: len(older) - keep]:
            pins = [self.files.read(f"{self.root}/pins/{name}/{p}") for p in self.files.names(f"{self.root}/pins/{name}")]
            if not any(p and float(p) > time.time() for p in pins):
                gone.append(self.snapshot(name))
                self.files.delete(f"{self.root}/generations/{name}")
        left = {t.path for n in self.files.names(f"{self.root}/generations") for t in self.snapshot(n).tables.values()}
        for path in {t.path for s in gone for t in s.tables.values()} - left:
            self.files.delete(f"{self.root}/{path}")
        return [s.name for s in gone]
