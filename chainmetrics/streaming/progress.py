"""What streams report of their batches, summed up."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, of every batch of every stream of a session, by stream id.

    A stream keeps its id when it is restarted from its checkpoint, so its count goes on; a batch that is repeated counts once,
    as it was last reported. Register it with `listen`, before the streams start.
    """

    def __init__(self) -> None:
        self._lock = Lock()
        self._settled: dict[str, int] = {}
        self._newest: dict[str, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        with self._lock:
            name = str(progress.id)
            batch, before = self._newest.get(name, (-1, 0))
            if progress.batchId > batch:
                self._settled[name] = self._settled.get(name, 0) + before
                self._newest[name] = (progress.batchId, dropped)
            elif progress.batchId == batch:
                self._newest[name] = (batch, max(before, dropped))

    def total(self, query_id: str | None = None) -> int:
        """Rows dropped so far, of one stream or of all."""
        with self._lock:
            names = [query_id] if query_id else list(self._newest)
            return sum(self._settled.get(n, 0) + self._newest.get(n, (-1, 0))[1] for n in names)


def listen(spark: SparkSession) -> LateRows:
    found = LateRows()
    spark.streams.addListener(found)
    return found


def settle(spark: SparkSession, milliseconds: int = 60_000) -> None:
    """Wait until all reports so far have reached their listeners."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(milliseconds)
