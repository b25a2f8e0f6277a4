"""State tables as Parquet runs in one folder, named by numbered commits.

A keyed table is a few runs, oldest first. A run holds whole rows of the keys
that one commit changed, or marks them as gone, in a folder for each bucket of
the key's hash; of several rows of a key the one in the newest run counts. So a
commit writes what it changes and not the table, and looking keys up reads the
buckets that they fall into. A run that is no longer small beside the one
before it is merged with that, so their number and the rewriting grow with the
logarithm of the table.

A commit file lists the runs of every table. It is written whole under a name
of its own, its number is claimed by a file that only one writer can create,
and it is then renamed: a reader sees all of a commit or nothing, of two
writers that started from one state one gets ``Conflict``, and a claim whose
writer has died is broken after ``patience`` seconds. Exclusive creation and
renaming without overwriting are what HDFS and local disks give; on an object
store without conditional writes let one process commit, or hold the lease.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.operators import lifecycle as L

GONE, BUCKET = "__gone", "__bucket"
#: a run is merged with the one before it unless that has so many times its rows
TIMES = 2


class Conflict(Exception):
    """Another writer has committed, or is committing, from the same state."""


class Store:
    """``schemas`` maps tables to their columns, ``keys`` those with a key to it; other tables are appended to or replaced.

    ``version`` is that of the schemas. A store of an older one is brought up
    by ``steps``, a function of the store for each version, in order and in one
    commit; a newer one raises.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keep: int = 8, keys: dict[str, str] | None = None, version: int = 1, steps: dict[int, Callable[[Store], None]] | None = None, buckets: int = 16, patience: float = 60.0):
        self.spark, self.root, self.schemas, self.keep, self.keys = spark, root.rstrip("/"), schemas, keep, keys or {}
        self.version, self.steps, self.buckets, self.patience = version, steps or {}, buckets, patience
        self.refresh()
        if 0 < self.stored_version < version:
            for v in range(self.stored_version + 1, version + 1):
                if v in self.steps:
                    self.steps[v](self)
            self.pending.setdefault("", [])  # the version alone is worth a commit
            self.commit()

    # ---- files

    def _path(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._path("commits")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _load(self, number: int) -> dict | None:
        fs, p = self._path(f"commits/{number:012d}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        raw = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(raw) if raw.endswith("\n") else None

    def refresh(self) -> None:
        """Take the newest commit as the state; what was written and not committed is given up."""
        self.number, self.at, self.pending, self.stored_version = 0, {}, {}, 0
        for n in self._numbers():
            self.number = max(self.number, n)
            if (found := self._load(n)) is not None:
                self.at, self.stored_version, self.buckets = found["tables"], found["version"], found["buckets"]
                break
        if self.stored_version > self.version:
            raise ValueError(f"{self.root} has schema version {self.stored_version}, this code knows {self.version}")

    # ---- reading

    def runs(self, name: str) -> list[dict]:
        return self.pending.get(name, self.at.get(name, []))

    def files(self, name: str, buckets: list[int] | None = None) -> list[list[str]]:
        """Folders to read, a list for each run."""
        out = []
        for run in self.runs(name):
            base = f"{self.root}/{run['at']}"
            if run["buckets"] is None:
                out.append([base])
            else:
                out.append([f"{base}/{BUCKET}={b}" for b in run["buckets"] if buckets is None or b in buckets])
        return out

    def _schema(self, name: str) -> str:
        return self.schemas[name] + (f", {GONE} boolean" if name in self.keys else "")

    def _union(self, name: str, folders: list[list[str]], columns: list[str] | None) -> DataFrame:
        """The newest row of each key, gone ones too."""
        key, out, newer = self.keys.get(name), None, []
        for paths in reversed([f for f in folders if f]):
            rows = self.spark.read.schema(self._schema(name)).parquet(*paths)
            if newer:
                # the keys of newer runs alone, which are small beside this one
                rows = rows.join(self.spark.read.schema(self._schema(name)).parquet(*newer).select(key), key, "left_anti")
            rows = rows.select(*(columns or rows.columns))
            out = rows if out is None else out.unionByName(rows)
            newer += paths if key else []
        return self.spark.createDataFrame([], self._schema(name)).select(*(columns or ["*"])) if out is None else out

    def read(self, name: str, columns: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the columns and buckets asked for."""
        if name not in self.keys:
            return self._union(name, self.files(name), columns)
        rows = self._union(name, self.files(name, buckets), [*columns, GONE] if columns else None)
        return rows.where(~F.col(GONE)).drop(GONE)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def lookup(self, name: str, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The rows whose key is among ``ids`` (the key's column), from their buckets alone; bucket numbers reach the driver."""
        key = self.keys[name]
        wanted = sorted(r.b for r in ids.select(self.bucket(F.col(key)).alias("b")).distinct().collect())
        rows = self.read(name, list(dict.fromkeys([key, *columns])) if columns else None, wanted)
        return rows.join(ids.select(key).distinct(), key, "left_semi").select(*(columns or rows.columns))

    # ---- writing

    def _put(self, name: str, rows: DataFrame) -> dict:
        at, key = f"{name}/{uuid.uuid4().hex}", self.keys.get(name)
        if key is None:
            rows.write.parquet(f"{self.root}/{at}")
            return {"at": at, "rows": self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{at}").count(), "buckets": None}
        dealt = rows.withColumn(BUCKET, self.bucket(F.col(key))).repartition(BUCKET).sortWithinPartitions(BUCKET, key)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.root}/{at}")
        written = self.spark.read.schema(f"{self._schema(name)}, {BUCKET} int").parquet(f"{self.root}/{at}").groupBy(BUCKET).count().collect()
        return {"at": at, "rows": sum(r["count"] for r in written), "buckets": sorted(r[BUCKET] for r in written)}

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table; nobody else sees it before ``commit``."""
        rows = rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns)
        self.pending[name] = [self._put(name, rows.withColumn(GONE, F.lit(False)) if name in self.keys else rows)]

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows that are put, by key, in the place of older ones, or appended where the table has no key."""
        rows = rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns)
        self._append(name, rows.withColumn(GONE, F.lit(False)) if name in self.keys else rows)

    def remove(self, name: str, ids: DataFrame) -> None:
        """The rows of these keys go."""
        key, empty = self.keys[name], self.spark.createDataFrame([], self.schemas[name])
        blank = [F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema]
        self._append(name, ids.select(key).distinct().select(*blank, F.lit(True).alias(GONE)))

    def _append(self, name: str, rows: DataFrame) -> None:
        run = self._put(name, rows)
        if run["rows"]:
            self.pending[name] = [*self.runs(name), run]

    def _merge(self, name: str) -> None:
        """Join the last runs until each has ``TIMES`` the rows of the next at least."""
        runs = list(self.runs(name))
        while len(runs) > 1 and runs[-2]["rows"] < TIMES * runs[-1]["rows"]:
            self.pending[name] = runs[-2:]
            both = self._union(name, self.files(name), None)
            if name in self.keys and len(runs) == 2:
                both = both.where(~F.col(GONE))  # nothing older is left to be hidden
            runs = [*runs[:-2], self._put(name, both)]
        self.pending[name] = runs

    def commit(self) -> None:
        if not self.pending:
            return
        for name in list(self.pending):
            if name:
                self._merge(name)
        tables = {k: v for k, v in {**self.at, **self.pending}.items() if k}
        content = json.dumps({"version": self.version, "buckets": self.buckets, "tables": tables}) + "\n"
        try:
            self._publish(self.number + 1, content)
        except Conflict:
            self._drop({r["at"] for runs in self.pending.values() for r in runs} - {r["at"] for runs in self.at.values() for r in runs})
            raise
        self.number, self.at, self.pending, self.stored_version = self.number + 1, tables, {}, self.version
        self._clean()

    def _publish(self, number: int, content: str) -> None:
        """Give ``content`` the commit file of this number, whole and at once, or raise ``Conflict``."""
        fs, whole = self._path(f"commits/{uuid.uuid4().hex}.tmp")
        _, claim = self._path(f"commits/{number:012d}.claim")
        _, last = self._path(f"commits/{number:012d}")
        self._fill(fs, whole, content)
        mine = False
        try:
            if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > self.patience:
                fs.delete(claim, False)
            try:
                fs.create(claim, False).close()
            except Py4JJavaError as e:
                raise self._taken(e, number) from e
            mine = True
            if fs.exists(last):
                raise Conflict(f"commit {number} exists")
            jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            how = gateway.new_array(rename, 1)
            how[0] = rename.NONE  # without overwriting
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(whole), fs.makeQualified(last), how)
            except Py4JJavaError as e:
                raise self._taken(e, number) from e
        finally:
            for p in (whole, *([claim] if mine else [])):
                if fs.exists(p):
                    fs.delete(p, False)

    @staticmethod
    def _taken(e: Py4JJavaError, number: int) -> Exception:
        """``Conflict`` where a file is there already; a full disk and the like stay what they are."""
        return Conflict(f"commit {number} exists or is being made") if "AlreadyExists" in e.java_exception.getClass().getName() else e

    @staticmethod
    def _fill(fs, path, content: str) -> None:
        out = fs.create(path, True)
        out.write(bytearray(content.encode()))
        out.close()

    def _drop(self, runs: set[str]) -> None:
        for at in runs:
            fs, p = self._path(at)
            fs.delete(p, True)

    def _clean(self) -> None:
        """Drop commits before the last ``keep``, and runs that no remaining commit names."""
        numbers = self._numbers()
        named = lambda ns: {r["at"] for n in ns for runs in (self._load(n) or {"tables": {}})["tables"].values() for r in runs}
        old = numbers[self.keep :]
        if old:
            self._drop(named(old) - named(numbers[: self.keep]))
            for n in old:
                fs, p = self._path(f"commits/{n:012d}")
                fs.delete(p, False)

    # ---- leases

    def lease(self, name: str, owner: str, now: Column, until: Column) -> bool:
        """Whether ``owner`` has the lease now; of two that ask at once, one gets it."""
        self.refresh()
        self.write("leases", L.take_lease(self.read("leases"), name, owner, now, until))
        try:
            self.commit()
        except Conflict:  # another writer took the commit, and perhaps the lease
            self.refresh()
        return bool(self.read("leases").where((F.col("name") == name) & (F.col("owner") == owner) & (F.col("until") > now)).limit(1).count())

    def release(self, name: str, owner: str, tries: int = 3) -> None:
        """Give a lease back; one that can't be given back runs out by itself."""
        for _ in range(tries):
            self.refresh()
            self.write("leases", self.read("leases").where(~((F.col("name") == name) & (F.col("owner") == owner))))
            try:
                return self.commit()
            except Conflict:
                continue
