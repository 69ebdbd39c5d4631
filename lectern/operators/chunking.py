"""Chunk planning: units of a chapter gathered into requests of bounded length that end with sentences.

The text of each unit is prepared by column functions. What goes into one chunk depends on all before it in the chapter,
so that the gathering itself is a function over sorted rows, one chapter at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.spanish import heard_count
from lectern.functions.text import SENTENCE_END, WEAK_END

NONE, LINE, VERSE, PARAGRAPH, SECTION = range(5)


@dataclass(frozen=True)
class Plan:
    """Lengths in characters, pauses in milliseconds after a chunk by the break that follows."""

    target: int = 600
    most: int = 1800
    pauses: tuple[int, ...] = (300, 250, 300, 650, 900)
    last_pause: int = 1500
    comma_after_lines: bool = True


CLOSED = re.compile(r"[.,;:!?…»”’)\]—–-]$")
# Where a unit that is too long may be cut, the best first.
CUTS = [re.compile(p) for p in (r"(?<=[.!?…»”])\s+", r"(?<=[;:])\s+", r"(?<=,)\s+", r"\s+")]


def pieces(text: str, most: int) -> list[str]:
    """A text in pieces of at most `most` characters, cut by the first kind of place that makes all parts fit."""
    if len(text) <= most:
        return [text]
    for cut in CUTS:
        parts = [p for p in cut.split(text) if p]
        if max(map(len, parts)) <= most:
            break
    out = [parts[0]]
    for p in parts[1:]:
        if len(out[-1]) + 1 + len(p) <= most:
            out[-1] += f" {p}"
        else:
            out.append(p)
    return out


@dataclass
class Unit:
    verse: str
    text: str
    brk: int
    starts: bool
    tokens: int


class Group:
    """Units that will be one chunk, with the length of their joined text kept as they come."""

    def __init__(self, plan: Plan):
        self.plan, self.units, self.length = plan, [], 0

    def added(self, u: Unit) -> int:
        """The length with another unit."""
        return self.length + self._joint(u) + len(u.text)

    def _joint(self, u: Unit) -> int:
        return 0 if not self.units else 1 + self._comma(u)

    def _comma(self, u: Unit) -> bool:
        return self.plan.comma_after_lines and u.brk == LINE and not CLOSED.search(self.units[-1].text)

    def add(self, u: Unit) -> None:
        self.length = self.added(u)
        self.units.append(u)

    def cut(self) -> int | None:
        """After how many units to cut: after the last that ends a sentence, else a clause."""
        for end in (SENTENCE_END, WEAK_END):
            for k in range(len(self.units), 0, -1):
                if re.search(end, self.units[k - 1].text):
                    return k
        return None

    def split(self, k: int) -> tuple[Group, Group]:
        out = Group(self.plan), Group(self.plan)
        for i, u in enumerate(self.units):
            out[i >= k].add(u)
        return out

    def row(self) -> tuple[str, list[dict]]:
        joined, verses, tokens = Group(self.plan), [], 0
        text = ""
        for u in self.units:
            if joined.units:
                text += ("," if joined._comma(u) else "") + ("\n" if u.brk == LINE else " ")
            if u.starts:
                verses.append({"verse": u.verse, "token": tokens})
            tokens += u.tokens
            text += u.text
            joined.add(u)
        return text, verses


def gathered(units: list[Unit], plan: Plan) -> list[tuple[Group, int]]:
    """Chunks with the pause after each."""
    out: list[tuple[Group, int]] = []
    group = Group(plan)
    for u in units:
        if group.units:
            close = u.brk >= PARAGRAPH
            if not close and group.added(u) > plan.most:
                close, k = True, group.cut()
                if k is not None and k < len(group.units):
                    head, group = group.split(k)
                    out.append((head, plan.pauses[group.units[0].brk]))
                    close = group.added(u) > plan.most
            elif not close:
                close = group.length >= plan.target and re.search(SENTENCE_END, group.units[-1].text) is not None
            if close:
                out.append((group, plan.pauses[u.brk]))
                group = Group(plan)
        group.add(u)
    if group.units:
        out.append((group, plan.last_pause))
    return out


CHUNK = "chunk int, text string, verses array<struct<verse:string,token:int>>, pause_ms int, units int"


def planned(units: DataFrame, keys: list[str], order: str, plan: Plan = Plan()) -> DataFrame:
    """(keys, chunk, text, verses, pause_ms, units) from (keys, order, verse, text, brk, starts): the chunks of each chapter.

    Rows come sorted, and no more than one chapter is held at a time. Units without text vanish; longer ones than a chunk
    are cut first.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join([*[f"`{k}` {units.schema[k].dataType.simpleString()}" for k in keys], CHUNK])
    rows = units.select(*keys, order, "verse", "text", "brk", "starts").repartition(*keys).sortWithinPartitions(*keys, order)
    verse = pa.struct([("verse", pa.string()), ("token", pa.int32())])
    made = pa.schema([*to_arrow_schema(units.select(*keys).schema), ("chunk", pa.int32()), ("text", pa.string()), ("verses", pa.list_(verse)), ("pause_ms", pa.int32()), ("units", pa.int32())])

    def run(batches):
        of, line, out = None, [], []

        def closed():
            for i, (group, pause) in enumerate(gathered(line, plan)):
                text, verses = group.row()
                out.append((*of, i, text, verses, pause, len(group.units)))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            own = list(zip(*columns[: len(keys)]))
            for key, label, text, brk, starts in zip(own, *columns[len(keys) + 1 :]):
                if key != of:
                    if line:
                        closed()
                    of, line = key, []
                for i, p in enumerate(pieces(text, plan.most) if text else []):
                    line.append(Unit(label, p, int(brk) if i == 0 else NONE, bool(starts) and i == 0, heard_count(p)))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)
                out = []
        if line:
            closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    return rows.mapInArrow(run, schema)


def plan_checks(chunks: DataFrame, units: DataFrame, keys: list[str], most: int = Plan.most) -> DataFrame:
    """(keys, within, all_verses): whether every chunk is short enough, and every verse that starts is there once."""
    got = chunks.groupBy(*keys).agg(F.bool_and((F.length("text") <= most) | ~F.col("text").contains(" ")).alias("within"), F.sum(F.size("verses")).alias("_got"))
    want = units.where(F.coalesce(F.length("text"), F.lit(0)) > 0).groupBy(*keys).agg(F.count_if("starts").alias("_want"))
    return want.join(got, keys, "left").select(*keys, "within", (F.col("_got") == F.col("_want")).alias("all_verses"))
