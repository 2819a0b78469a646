"""Layers whose states change together: a run writes folders of its own and commits them by one manifest.

Files of a layer lie in ``<root>/<layer>/run=<run>/order_month=<month>``; layers without months leave the
second level out.  A manifest is a small JSON file, ``<root>/manifests/<number>.json``, that
names for each layer and month the runs whose folders hold it.  It becomes visible by one
rename to a number that did not exist, so readers see all of a run or nothing, and of two runs
that began from one state the second fails (for certain where the file system's rename refuses
a target that exists).  Folders that no recent manifest names are
collected later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A layer's runs by month; the month of a layer without months is the empty text.
State = dict[str, dict[str, list[str]]]
MONTH = "order_month"
#: Folders of a layer without months that are read together before they are written as one.
MANY = 32


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


class Snapshots:
    """The committed state of a folder of layers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def numbers(self) -> list[int]:
        """Numbers of the manifests, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self.names(f"{self.root}/manifests") if n.removesuffix(".json").isdigit())

    def state(self, number: int) -> State:
        """What a manifest names; nothing for number 0."""
        if not number:
            return {}
        path = self._path(f"{self.root}/manifests/{number}.json")
        stream = self.fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, State]:
        number = max(self.numbers(), default=0)
        return number, self.state(number)

    def begin(self, run: str) -> Run:
        number, state = self.latest()
        return Run(self, run, number, state)

    def commit(self, after: int, state: State) -> None:
        """Make a state the one after a number."""
        folder = self._path(f"{self.root}/manifests")
        self.fs.mkdirs(folder)
        fresh = self._path(folder, f".{uuid.uuid4().hex}")
        out = self.fs.create(fresh)
        out.write(bytearray(json.dumps(state, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        target = self._path(folder, f"{after + 1}.json")
        if self.fs.exists(target) or not self.fs.rename(fresh, target):
            self.fs.delete(fresh, False)
            raise Conflict(f"manifest {after + 1} is there already")

    def folder(self, layer: str, run: str, month: str = "") -> str:
        return f"{self.root}/{layer}/run={run}" + (f"/{MONTH}={month}" if month else "")

    def there(self, state: State, layer: str) -> dict[str, list[str]]:
        """The months of a layer all of whose folders are there, with their runs."""
        return {m: runs for m, runs in state.get(layer, {}).items() if all(self.exists(self.folder(layer, r, m)) for r in runs)}

    def table(self, state: State, layer: str, months: list[str] | None = None) -> DataFrame:
        """A layer's rows in a state, of all months or some; what files written earlier lack is missing."""
        paths = [self.folder(layer, r, m) for m, runs in self.there(state, layer).items() for r in runs if months is None or m in months]
        if not paths:
            raise FileNotFoundError(f"{layer} has no rows")
        read = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/{layer}")
        return read.parquet(*paths).drop("run").withColumns({MONTH: F.col(MONTH).cast("string")} if "" not in state[layer] else {})

    def collect(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the last manifests names, and older manifests; what was deleted.

        Not to be called while a run is writing.
        """
        numbers = self.numbers()
        held = {(layer, r) for n in numbers[-keep:] for layer, months in self.state(n).items() for runs in months.values() for r in runs}
        gone = [f"{self.root}/manifests/{n}.json" for n in numbers[:-keep]]
        for layer in {x for n in numbers for x in self.state(n)}:
            gone += [f"{self.root}/{layer}/{n}" for n in self.names(f"{self.root}/{layer}") if n.startswith("run=") and (layer, n.removeprefix("run=")) not in held]
        for path in gone:
            self.fs.delete(self._path(path), True)
        return gone


@dataclass
class Run:
    """What one run sees and writes: the state that it began from, and its own folders."""

    held: Snapshots
    name: str
    number: int
    state: State
    numbers: Iterator[int] = field(default_factory=lambda: count(1))

    def _own(self) -> str:
        """A name of its own for each write, so that a layer may be written from itself."""
        return f"{self.name}-{next(self.numbers)}"

    def replace_months(self, layer: str, df: DataFrame) -> list[str]:
        """Write a layer's rows; the months that they have are replaced whole, all others stay.  Those months.

        Rows are brought together by month, and adaptive execution cuts a large month into several files.
        """
        own = self._own()
        df.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(self.held.folder(layer, own))
        months = [n.partition("=")[2] for n in self.held.names(self.held.folder(layer, own)) if n.startswith(f"{MONTH}=")]
        self.state[layer] = self.state.get(layer, {}) | {m: [own] for m in months}
        return sorted(months)

    def replace(self, layer: str, df: DataFrame) -> None:
        """Write a layer without months anew."""
        own = self._own()
        df.write.parquet(self.held.folder(layer, own))
        self.state[layer] = {"": [own]}

    def append(self, layer: str, df: DataFrame) -> None:
        """Add rows to a layer without months; its folders are brought together when they have become many."""
        held = self.held.there(self.state, layer).get("", [])
        if len(held) >= MANY:
            return self.replace(layer, self.held.table(self.state, layer).unionByName(df, allowMissingColumns=True))
        own = self._own()
        df.write.parquet(self.held.folder(layer, own))
        self.state[layer] = {"": [*held, own]}

    def drop_months(self, layer: str, months: set[str]) -> None:
        self.state[layer] = {m: r for m, r in self.state.get(layer, {}).items() if m not in months}

    def commit(self) -> None:
        self.held.commit(self.number, self.state)
        self.number += 1
