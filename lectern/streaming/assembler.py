"""The assembler as a stateful stream: events of works come in reading order, in batches cut anywhere, and chapters go out when they close.

The state of a work is where it stands (title, marks so far) and the events of the open chapter, which are kept as a list
and never read until it closes: by the next mark or title, by an `end` event, or after some time without news. What goes
out are the placed events of whole chapters, from which the operators of a batch make units.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import assembly

EVENTS = "doc int, ev int, kind string, value string"
PLACED = "book_no int, book string, chapter_no int, chapter int, seq int, doc int, kind string, value string"
#: The state store that lists and timers need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chapters(StatefulProcessor):
    """Headings after the last text of a chapter go to the next of the same book, as in a batch."""

    def __init__(self, work: str, idle_ms: int | None):
        self.work, self.idle_ms = work, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "book_no int, book string, chapter_no int, chapter int")
        self.open = handle.getListState("open", "doc int, kind string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows), ignore_index=True).sort_values(["doc", "ev"], kind="stable")
        book_no, book, chapter_no, chapter = self.at.get() if self.at.exists() else (0, None, 0, None)
        held: list[tuple] = []
        for doc, kind, value in zip(events["doc"].tolist(), events["kind"].tolist(), events["value"].tolist()):
            if kind in ("book", "chapter", "end"):
                self._keep(held)
                yield from self._closed(key, (book_no, book, chapter_no, chapter), doc if kind == "chapter" else None)
                held = []
                if kind == "book":
                    book_no, book, chapter_no, chapter = book_no + 1, value, 0, None
                elif kind == "chapter":
                    chapter_no, chapter = chapter_no + 1, int(value)
                else:
                    # What comes after an end is a piece of its own.
                    chapter_no += chapter is not None
                if kind == "chapter":
                    held.append((doc, kind, value))
            elif book_no:
                held.append((doc, kind, value))
        self._keep(held)
        self.at.update((book_no, book, chapter_no, chapter))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        book_no, book, chapter_no, chapter = self.at.get()
        yield from self._closed(key, (book_no, book, chapter_no, chapter), None)
        self.at.update((book_no, book, chapter_no + (chapter is not None), chapter))

    def _keep(self, held: list[tuple]) -> None:
        if held:
            self.open.appendList(held)

    def _closed(self, key, place: tuple, next_doc: int | None) -> Iterator[pd.DataFrame]:
        """The events of the open chapter. With next_doc a chapter of the same book follows there, and gets the headings after the last text."""
        rows = list(self.open.get()) if self.open.exists() else []
        self.open.clear()
        last = max((i for i, r in enumerate(rows) if r[1] == "text"), default=-1)
        later = [r for r in rows[last + 1 :] if r[1] == "section"] if next_doc is not None else []
        rows = [r for i, r in enumerate(rows) if i <= last or r[1] != "section" or next_doc is None]
        self._keep([(next_doc, kind, value) for _, kind, value in later])
        if any(r[1] == "text" or r[1] == "verse" for r in rows):
            out = pd.DataFrame(rows, columns=["doc", "kind", "value"])
            out.insert(0, "seq", range(len(out)))
            for name, value in reversed(list(zip(("book_no", "book", "chapter_no", "chapter"), place))):
                out.insert(0, name, value)
            out["chapter"] = out["chapter"].astype("Int32")
            out.insert(0, self.work, key[0])
            yield out

    def close(self) -> None:
        pass


def closed_chapters(events: DataFrame, work: str = "work", idle_ms: int | None = None) -> DataFrame:
    """(work, PLACED) of each chapter when it closes, from a stream of (work, EVENTS) in the order of doc and ev.

    Rows of a batch may come in any order, those of later batches come later in the work. With idle_ms a chapter closes
    when nothing has come for so long; events of it that come after that are a piece of their own under the same number.
    """
    kind = events.schema[work].dataType.simpleString()
    return events.select(work, "doc", "ev", "kind", "value").groupBy(work).transformWithStateInPandas(Chapters(work, idle_ms), f"`{work}` {kind}, {PLACED}", "Append", "ProcessingTime" if idle_ms is not None else "None")


def units(placed: DataFrame, work: str = "work") -> DataFrame:
    """The units of whole chapters, as in a batch, from what closed_chapters() emits."""
    return assembly.units(placed, [work], ["seq"], ["doc"])


def start(events: DataFrame, path: str, checkpoint: str, work: str = "work", idle_ms: int | None = None, **trigger):
    """Writes the units of chapters to folders of path by batch: one that is run again replaces its own."""
    session = events.sparkSession
    session.conf.set(*PROVIDER)

    def put(batch: DataFrame, number: int) -> None:
        units(batch, work).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed_chapters(events, work, idle_ms).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
