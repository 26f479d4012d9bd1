"""How far a stream is behind decides how much scoring its next micro-batch gets."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.fusion import load_shedding
from .sinks import source_lag


class LagListener(StreamingQueryListener):
    """Keeps the lag of each query's last progress, by name, or by id where it has none. Register with ``spark.streams.addListener``.

    ``measure``: from a progress, as a dictionary, to unread records; the usual one reads Kafka offsets.
    """

    def __init__(self, measure: Callable[[dict], int] = source_lag) -> None:
        self.measure, self._lags, self._lock = measure, {}, threading.Lock()

    def lag(self, query: str) -> int:
        """0 until a query has made progress, and after its end."""
        with self._lock:
            return self._lags.get(query, 0)

    def note(self, progress: dict) -> None:
        with self._lock:
            self._lags[progress.get("name") or str(progress.get("id"))] = self.measure(progress)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.note(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._lags.pop(str(event.id), None)


def shed_by_lag(score: Callable[[DataFrame, int], None], listener: LagListener, query: str, **thresholds: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``score`` on the batch with ``scoring_mode``, what the lag at the end of the batch before allows."""

    def run(batch: DataFrame, number: int) -> None:
        score(batch.withColumn("scoring_mode", load_shedding(F.lit(listener.lag(query)), **thresholds)), number)

    return run
