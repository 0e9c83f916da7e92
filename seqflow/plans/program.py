"""Tasks with access modes over named data, as lazy DataFrame plans.

A datum is a name with numbered versions, each a DataFrame. A task reads versions and makes new ones; nothing runs
until sync(), which writes what is asked for. R reads the latest version, W makes a new one without reading, RW makes
the next from the latest, CW adds a contribution: contributions between two other accesses are unioned and aggregated
once, so they may come in any order.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from seqflow.lineage import cut

MODES = {"R", "W", "RW", "CW"}
#: Other names of the modes.
ALIASES = {"read": "R", "r": "R", "input": "R", "write": "W", "w": "W", "output": "W", "readwrite": "RW", "rw": "RW", "inout": "RW", "reduction": "CW", "cw": "CW"}


class Cancelled(RuntimeError):
    """A sequence of jobs was cancelled."""


class JobSequence:
    """Jobs that are run in order and can be cancelled together; use run() for each and cancel() from any thread."""

    def __init__(self, spark: SparkSession, name: str = "sequence"):
        self.spark, self.tag, self._cancelled = spark, f"{name}-{uuid.uuid4().hex}", threading.Event()

    def run(self, job: Callable[[], object]):
        """job()'s result; an error if the sequence was cancelled before or meanwhile."""
        if self._cancelled.is_set():
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return job()
        except Exception as e:
            if self._cancelled.is_set():
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        """Stop the jobs of this sequence that run, and let none begin."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@dataclass
class Program:
    spark: SparkSession
    reducers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    versions: dict[str, list[DataFrame]] = field(default_factory=dict)
    log: list[tuple[int, str, str, str]] = field(default_factory=list)
    _pending: dict[str, list[DataFrame]] = field(default_factory=dict)
    _tasks: int = 0

    def define(self, name: str, df: DataFrame, reducer: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Give a datum its first version, and for CW an aggregate over the union of its value and contributions."""
        self.versions[name] = [df]
        if reducer:
            self.reducers[name] = reducer

    def _settle(self, name: str) -> None:
        if parts := self._pending.pop(name, None):
            merged = self.versions[name][-1]
            for p in parts:
                merged = merged.unionByName(p)
            self.versions[name].append(self.reducers[name](merged))

    def latest(self, name: str) -> DataFrame:
        self._settle(name)
        return self.versions[name][-1]

    def task(self, **modes: str):
        """Decorate a function whose arguments are the data it reads and whose result is what it writes, in order."""
        wanted = {n: ALIASES.get(m.lower(), m) for n, m in modes.items()}
        if bad := {m for m in wanted.values() if m not in MODES}:
            raise ValueError(f"no such access mode: {sorted(bad)}")

        def wrap(f):
            def spawn(**names: str) -> int:
                bound = {arg: (names.get(arg, arg), mode) for arg, mode in wanted.items()}
                number, self._tasks = self._tasks, self._tasks + 1
                reads = {arg: self.latest(name) for arg, (name, mode) in bound.items() if mode in ("R", "RW")}
                made = f(**reads)
                outs = [(name, mode) for name, mode in bound.values() if mode != "R"]
                made = made if isinstance(made, tuple) else (made,) if outs else ()
                if len(made) != len(outs):
                    raise ValueError(f"{f.__name__} made {len(made)} data, not {len(outs)}")
                for (name, mode), df in zip(outs, made, strict=True):
                    if mode == "CW":
                        if name not in self.reducers:
                            raise ValueError(f"{name} has no reducer")
                        self._pending.setdefault(name, []).append(df)
                    else:
                        self._pending.pop(name, None) if mode == "W" else None
                        self.versions.setdefault(name, []).append(df)
                self.log += [(number, f.__name__, name, mode) for name, mode in bound.values()]
                return number

            return spawn

        return wrap

    def sync(self, *names: str) -> dict[str, DataFrame]:
        """Run what the data need; their latest versions, written, with no lineage."""
        for n in names or list(self.versions):
            self.versions[n] = [cut(self.latest(n), f"datum-{n}")]
        return {n: self.versions[n][-1] for n in names or self.versions}

    def repeat(self, times: int, body: Callable[[int], None], *names: str) -> dict[str, DataFrame]:
        """Run a graph several times: body(k) spawns its tasks, whose data are then written, so each round reads the one before."""
        if times < 0:
            raise ValueError("times is negative")
        for k in range(times):
            body(k)
            self.sync(*names)
        return {n: self.latest(n) for n in names or self.versions}

    def save(self) -> dict[str, DataFrame]:
        """The data's latest versions, to restore later."""
        return {n: self.latest(n) for n in self.versions}

    def restore(self, saved: dict[str, DataFrame]) -> None:
        """Data as they were saved; those made since then are gone."""
        self._pending.clear()
        self.versions = {n: [df] for n, df in saved.items()}

    def accesses(self) -> DataFrame:
        """task_id, name, datum, mode: the graph's input for seqflow.plans.dag."""
        return self.spark.createDataFrame(self.log, "task_id long, name string, datum string, mode string")
