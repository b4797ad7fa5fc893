"""Several sources as one."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from ..functions import terms as T
from ..plans.algebra import Pattern
from ..plans.relation import Relation, nothing, union
from .base import Source, impossible

log = logging.getLogger("triloom.sources")


class FederatedSource(Source):
    """Every pattern is answered by the bag union of all sources, so joins cross sources; counts add up.

    A source whose count for a more general pattern was 0 isn't asked again for its instances. Up to error_threshold sources (all
    but one by default) may fail, which leaves them out; beyond, the error is raised. A page of a web source that fails while the query
    runs ends that source's pages, if any source may fail.
    """

    def __init__(self, spark: SparkSession, sources: list[Source], error_threshold: int | None = None):
        self.spark, self.sources = spark, sources
        self.threshold = max(0, len(sources) - 1) if error_threshold is None else error_threshold
        if self.threshold:
            for source in sources:
                if hasattr(source, "late_errors"):
                    source.late_errors = "stop"
        self.failed: set[int] = set()
        self.empty: dict[int, list[Pattern]] = {i: [] for i in range(len(sources))}

    def _each(self, p: Pattern):
        for i, source in enumerate(self.sources):
            if i in self.failed or any(p.bound_by(g) for g in self.empty[i]):
                continue
            yield i, source

    def _fail(self, i: int, e: Exception) -> None:
        self.failed.add(i)
        log.warning("source %d failed: %s", i, e)
        if len(self.failed) > self.threshold:
            raise e

    def count(self, p: Pattern) -> float:
        if impossible(p):
            return 0
        total = 0.0
        for i, source in list(self._each(p)):
            try:
                n = source.count(p)
            except Exception as e:  # noqa: BLE001  any failure of a source counts
                self._fail(i, e)
                continue
            if n == 0:
                self.empty[i].append(p)
            total += n or 0
        return total

    def estimate(self, p: Pattern) -> float:
        return sum(s.estimate(p) for s in self.sources) if not self.failed and all(type(s).estimate is not Source.estimate for s in self.sources) else self.count(p)

    def scan(self, p: Pattern) -> Relation:
        parts = []
        for i, source in list(self._each(p)):
            try:
                if not T.py_is_open(p.p) and source.count(p) == 0:
                    self.empty[i].append(p)
                    continue
                parts.append(source.match(p))
            except Exception as e:  # noqa: BLE001
                self._fail(i, e)
        return union(parts) if parts else nothing(self.spark, p.variables())

    def star(self, patterns: list[Pattern]) -> Relation | None:
        return self.sources[0].star(patterns) if len(self.sources) == 1 else None
