"""Pages of documents as they come: numbered in order, held back until their turn, each document closed by an end row.

Pages of a document may come in several micro-batches and out of order. The state of a
document is how many pages it has sent and those that wait for one before them. A
document of which the number of pages is known ends with its last; one of which it
isn't ends when no page has come for a while. Either way an end row follows, with the
number of pages. A page that comes after its document's end is sent with the next
number and the mark ``late``, and no second end row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "page_id long, content string, is_end boolean, n_pages long, timed_out boolean, late boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pager(StatefulProcessor):
    """The state of one document: ``sent`` (pages sent, the place expected next, whether it has ended) and ``waiting`` (place to content)."""

    def __init__(self, doc: str, timeout_ms: int, keep_ended_ms: int):
        self.names = [doc, *(c.split()[0] for c in OUTPUT.split(", "))]
        self.timeout_ms, self.keep_ended_ms = timeout_ms, keep_ended_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "pages long, place long, ended boolean", self.keep_ended_ms)
        self.waiting = handle.getMapState("waiting", "place long", "content string", self.keep_ended_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pages, place, ended = tuple(self.sent.get()) if self.sent.exists() else (0, 0, False)
        came, total = {}, None
        for r in rows:
            came.setdefault(r.place, []).append(r.content)
            total = r.n_pages if total is None else total
        if ended:
            for p in sorted(came):
                for content in came[p]:
                    pages += 1
                    yield self._page(key, pages, content, True)
            self.sent.update((pages, place, True))
            return
        held = dict(self._held()) if self.waiting.exists() else {}
        new = {p: c[0] for p, c in came.items() if p >= place and p not in held}  # a page that came twice is one page
        ready, whole = held | new, total is not None and pages + len(held) + len(new) >= total
        out = []
        for p in sorted(ready):
            if p != place and not whole:
                break
            out.append(p)
            place = p + 1
        for p in out:
            pages += 1
            yield self._page(key, pages, ready[p], False)
            if p in held:
                self.waiting.removeKey((p,))
        for p in new:
            if p not in out:
                self.waiting.updateValue((p,), (new[p],))
        if whole:
            yield self._end(key, pages, False)
        self.sent.update((pages, place, whole))
        self._timers(None if whole else timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pages, place, ended = tuple(self.sent.get()) if self.sent.exists() else (0, 0, False)
        if ended:
            return
        for p, content in sorted(self._held()) if self.waiting.exists() else ():
            pages, place = pages + 1, p + 1
            yield self._page(key, pages, content, False)
            self.waiting.removeKey((p,))
        self.sent.update((pages, place, True))
        yield self._end(key, pages, True)

    def _held(self) -> list[tuple[int, str]]:
        return [(k[0], v[0]) for k, v in self.waiting.iterator()]

    def _timers(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def _page(self, key, page_id: int, content: str, late: bool) -> Row:
        return Row(*self.names)(*key, page_id, content, False, None, False, late)

    def _end(self, key, pages: int, timed_out: bool) -> Row:
        return Row(*self.names)(*key, None, None, True, pages, timed_out, False)

    def close(self) -> None:
        pass


def page_stream(pages: DataFrame, doc: str, place: str, content: str, n_pages: str | None = None, timeout_ms: int = 600_000, keep_ended_ms: int = 86_400_000) -> DataFrame:
    """doc, page_id (from 1, in order of place), content, is_end, n_pages, timed_out, late of a stream of pages.

    ``place`` counts from 0; where places have gaps, the pages after one wait until as many have come as ``n_pages`` says,
    or until ``timeout_ms`` without a page. What is kept of a document goes ``keep_ended_ms`` after it changed last. Rows
    without a document or a place are left out: they are pages of none.
    """
    kinds = dict(pages.dtypes)
    total = F.col(n_pages).cast("long") if n_pages else F.lit(None).cast("long")
    rows = pages.filter(F.col(doc).isNotNull() & F.col(place).isNotNull()).select(F.col(doc), F.col(place).cast("long").alias("place"), F.col(content).alias("content"), total.alias("n_pages"))
    return rows.groupBy(doc).transformWithState(Pager(doc, timeout_ms, keep_ended_ms), f"`{doc}` {kinds[doc]}, {OUTPUT}", "append", "ProcessingTime")


#: What a run is started with: state in RocksDB, and no batches for timers alone, with which a run to the end of what there is would never end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def run(stream: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """Takes what a stream has now into Parquet files under target, by the checkpoint's account of what was taken before; the progress of each micro-batch. Timers that have run out fire in the next batch that has rows."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        conf.set(name, value)
    try:
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.set(name, value)
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]
