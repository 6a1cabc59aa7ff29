"""One open table and one view at a time: revisions, stale reads refused, one job that a new one cancels."""

from __future__ import annotations

import itertools
import threading
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators import view as views
from ..operators.model import Dataset, Kind, Query
from ..operators.sort import infer
from ..sources.open import open_table


class StaleError(RuntimeError):
    pass


@dataclass
class State:
    data: Dataset
    kinds: list[Kind]
    view: views.View
    file: int
    revision: int


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, None
        self._ids, self._lock, self._job = itertools.count(1), threading.Lock(), None

    def _begin(self) -> int:
        """A new job's number; its jobs in Spark carry it as a tag, and those of the job before are cancelled."""
        with self._lock:
            number = next(self._ids)
            before, self._job = self._job, number
        if before is not None:
            self.spark.sparkContext.cancelJobsWithTag(f"lodestone-{id(self)}-{before}")
        self.spark.sparkContext.addJobTag(f"lodestone-{id(self)}-{number}")
        return number

    def _end(self, number: int) -> None:
        self.spark.sparkContext.removeJobTag(f"lodestone-{id(self)}-{number}")
        with self._lock:
            if self._job == number:
                self._job = None

    def cancel(self) -> None:
        with self._lock:
            number, self._job = self._job, None
        if number is not None:
            self.spark.sparkContext.cancelJobsWithTag(f"lodestone-{id(self)}-{number}")

    def progress(self) -> dict:
        """Tasks done and in all of the stages that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
        done, total = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
        return {"done": done, "total": total, "fraction": done / total if total else None}

    def _publish(self, number: int, state: State) -> State:
        with self._lock:
            if self._job != number:
                raise StaleError("a newer request has replaced this one")
            self.state = state
        return state

    def open(self, path: str, **options) -> State:
        number = self._begin()
        try:
            data = open_table(self.spark, path, **options)
            kinds = infer(data)
            return self._publish(number, State(data, kinds, views.View(data, None, kinds), number, number))
        finally:
            self._end(number)

    def query(self, query: Query, file: int) -> State:
        """A view of a new revision; a query that fails leaves the old one."""
        if self.state is None or self.state.file != file:
            raise StaleError("another file is open")
        now, number = self.state, self._begin()
        try:
            found = views.run(now.data, query, now.kinds)
            found.count()
            return self._publish(number, State(now.data, now.kinds, found, now.file, number))
        finally:
            self._end(number)

    def current(self, revision: int) -> views.View:
        if self.state is None or self.state.revision != revision:
            raise StaleError("the view has changed")
        return self.state.view

    def rows(self, revision: int, start: int, n: int, columns: list[int]) -> list[dict]:
        return views.viewport(self.current(revision), start, n, columns)

    def cell(self, revision: int, row: int, column: int) -> dict:
        return views.cell(self.current(revision), row, column)

    def copy_range(self, revision: int, first: int, last: int, columns: list[int]) -> str:
        return views.copy_range(self.current(revision), first, last, columns)

    def export(self, revision: int, path: str) -> int:
        return views.export_csv(self.current(revision), path)
