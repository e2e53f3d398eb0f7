"""What a parse tells: hooks around a run, and around its pages as they are read."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Callback:
    """Hooks of a run; each does nothing until it is written."""

    def on_started(self, what: str) -> None: ...

    def on_finished(self, what: str, seconds: float, counts: dict) -> None: ...

    def on_page_started(self, what: str) -> None: ...

    def on_page_finished(self, what: str, counts: dict) -> None: ...


class Printed(Callback):
    def on_started(self, what):
        print(f"parsing {what}")

    def on_finished(self, what, seconds, counts):
        print(f"parsed {what} in {seconds:.2f} s: {counts}")


def observed(what: str, pages: DataFrame, write: Callable[[DataFrame], object], callback: Callback) -> dict:
    """Writes pages (with a column error) and tells the callback how many there were; they are counted while they are written, not again."""
    seen = Observation(what)
    began = time.monotonic()
    callback.on_started(what)
    callback.on_page_started(what)
    write(pages.observe(seen, F.count("*").alias("pages"), F.count("error").alias("errors")))
    counts = dict(seen.get)
    callback.on_page_finished(what, counts)
    callback.on_finished(what, time.monotonic() - began, counts)
    return counts


def watch(spark, callback: Callback):
    """A listener that tells the callback of each batch of a stream; it is returned so that it can be removed."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            callback.on_started(str(event.id))

        def onQueryProgress(self, event):
            callback.on_page_finished(str(event.progress.id), {"rows": event.progress.numInputRows, "batch": event.progress.batchId})

        def onQueryIdle(self, event): ...

        def onQueryTerminated(self, event):
            callback.on_finished(str(event.id), 0.0, {"error": event.exception})

    own = Listener()
    spark.streams.addListener(own)
    return own
