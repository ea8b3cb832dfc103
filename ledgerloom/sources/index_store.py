"""Tables in buckets, with versions that switch at once.

A version is a manifest, a small JSON file: for every table its schema, and for every bucket the runs whose
folders hold it. A run writes new folders of the buckets that it touches, and then its manifest, under the
next number, by a rename that never replaces a file. So readers see the version before or the one after, a run
that dies has changed nothing (``vacuum`` deletes what it leaves), and of two runs from one version the second
fails. Buckets that a run does not touch stay where they are.

    root/_versions/0000000007.json
    root/run-<id>/<table>/bucket=<k>/part-...
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another run has published this version."""


@dataclass(frozen=True)
class Version:
    """number 0 is the empty store; tables: name -> {"schema": JSON, "parts": {bucket: [runs]}}."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):  # noqa: ANN202
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.root}/_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self, number: int | None = None) -> Version:
        """The latest version, or the one of that number."""
        numbers = self._numbers()
        if not numbers:
            return Version()
        at = numbers[-1] if number is None else number
        text = self.spark.read.text(f"{self.root}/_versions/{at:010d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        if held["buckets"] != self.buckets:
            raise ValueError(f"the store has {held['buckets']} buckets")
        return Version(at, held["tables"])

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, version: Version, table: str, schema: str | StructType | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table's rows, of all buckets or of these; ``schema`` is for a table that is not there yet."""
        held = version.tables.get(table)
        kind = StructType.fromJson(json.loads(held["schema"])) if held else schema
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.root}/{run}/{table}/bucket={b}" for b, runs in (held["parts"] if held else {}).items() if wanted is None or b in wanted for run in runs]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*paths)

    def new_run(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def folder(self, run: str, name: str) -> str:
        """A folder of the run for what is not published."""
        return f"{self.root}/{run}/_{name}"

    def write(self, run: str, table: str, rows: DataFrame, key: str | None = None, tasks: int = 0) -> dict:
        """Writes rows (with a column bucket) of a run; large buckets are many files. With key, rows are dealt by bucket and shares of the key into so many tasks, whatever their bytes."""
        where = f"{self.root}/{run}/{table}"
        share = F.pmod(F.hash(key), F.lit(-(-tasks // self.buckets))) if key else None
        dealt = rows.hint("rebalance", "bucket") if share is None else rows.repartition(tasks, "bucket", share)
        dealt.write.partitionBy("bucket").parquet(where)
        kind = StructType([f for f in rows.schema.fields if f.name != "bucket"])
        return {"schema": kind.json(), "buckets": [n.removeprefix("bucket=") for n in self._names(where) if n.startswith("bucket=")]}

    def publish(self, base: Version, run: str, written: dict[str, dict], touched: dict[str, Iterable[int] | None], appended: Iterable[str] = ()) -> Version:
        """The next version: of every table written, the touched buckets (None: all) are the run's, the others stay; tables in ``appended`` gain the run's rows and lose none."""
        tables = dict(base.tables)
        for name, new in written.items():
            parts = dict(tables.get(name, {"parts": {}})["parts"])
            if name in appended:
                parts |= {b: [*parts.get(b, []), run] for b in new["buckets"]}
            else:
                gone = touched[name]
                parts = {} if gone is None else {b: r for b, r in parts.items() if int(b) not in set(gone)}
                parts |= {b: [run] for b in new["buckets"]}
            tables[name] = {"schema": new["schema"], "parts": parts}
        self._put(base.number + 1, {"buckets": self.buckets, "tables": tables})
        return Version(base.number + 1, tables)

    def _put(self, number: int, manifest: dict) -> None:
        jvm, fs, folder = self.spark._jvm, self._fs(), f"{self.root}/_versions"
        fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{number:010d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or fs.exists(final):
                raise Conflict(f"version {number} is there already") from e
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` versions and the runs that none of these has; no run may be writing. Returns the runs deleted."""
        numbers = self._numbers()
        used = {run for n in numbers[-keep:] for t in self.version(n).tables.values() for runs in t["parts"].values() for run in runs}
        gone = [n for n in self._names(self.root) if n.startswith("run-") and n not in used]
        for n in gone:
            self._fs().delete(self._path(f"{self.root}/{n}"), True)
        for n in numbers[:-keep]:
            self._fs().delete(self._path(f"{self.root}/_versions/{n:010d}.json"), False)
        return gone

    def discard(self, run: str, name: str) -> None:
        self._fs().delete(self._path(self.folder(run, name)), True)
