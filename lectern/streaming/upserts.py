"""A table of texts by key that streams bring up to date: deltas by batch, a log of what counts, merge on read.

A batch reads only the buckets of its keys and writes only the rows that it changes, as a delta in a folder of its own.
A delta counts once an entry of the log names it. Entries are numbered without gaps and each is made by one writer
alone: who comes second looks at the table again. An entry holds the query's id and the number of the batch, so that a
batch that is run again changes nothing, whatever its checkpoint does next; a query with a new checkpoint has a new id,
and its batch 0 is news. What a failed attempt left behind isn't in the log and is never read.

The content of the table is, of each key, the row of the latest delta or base. Compaction writes it as a base, one file
or more for each bucket, and later reads begin there.

The file system must refuse to rename a file to one that exists, as HDFS does and as the streams' own logs need.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.content import upserted

ENTRY = 12


class Taken(Exception):
    """Another writer made that entry of the log."""


@dataclass
class State:
    """What the log says: the number of the last entry, the base if any, the deltas after it, and the last batch of each query."""

    version: int = -1
    base: tuple[int, str] | None = None
    deltas: list[tuple[int, str]] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)


class Texts:
    """The table at a path. key: its key columns, with their SQL types; buckets is fixed once the table is there."""

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str], text: str = "text", buckets: int = 64, compact_after: int = 50):
        self.spark, self.path, self.key, self.text, self.buckets, self.compact_after = spark, path.rstrip("/"), key, text, buckets, compact_after
        kinds = ", ".join(f"`{k}` {t}" for k, t in key.items())
        self.schema = f"{kinds}, `{text}` string, fingerprint string, bucket int"

    # The log

    def _files(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> list[int]:
        at, files = self._files("log")
        return sorted(int(s.getPath().getName()[:ENTRY]) for s in files.listStatus(at) if s.getPath().getName()[:ENTRY].isdigit()) if files.exists(at) else []

    def _entry(self, number: int) -> dict:
        at, files = self._files(f"log/{number:0{ENTRY}d}.json")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> State:
        """Entries are read from the last base on."""
        numbers, seen, out = self._entries(), [], State()
        for n in reversed(numbers):
            seen.append((n, self._entry(n)))
            if seen[-1][1]["kind"] == "base":
                break
        for n, e in reversed(seen):
            out.version = n
            if e["kind"] == "base":
                out.base, out.deltas, out.done = (e["upto"], e["folder"]), [], dict(e["done"])
                out.deltas = [tuple(d) for d in e["after"]]
            elif e["kind"] == "delta":
                out.deltas.append((n, e["folder"]))
            if e.get("query") is not None:
                out.done[e["query"]] = max(e["batch"], out.done.get(e["query"], -1))
        return out

    def _commit(self, version: int, entry: dict) -> None:
        at, files = self._files(f"log/{version:0{ENTRY}d}.json")
        # Written whole under another name first: an entry is there with all its content or not at all.
        new, _ = self._files(f"log/.{uuid.uuid4().hex}")
        stream = files.create(new, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(new, at, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            files.delete(new, False)
            if not files.exists(at):
                raise
            raise Taken(version) from e

    # Rows

    def bucket(self):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast(t) for k, t in self.key.items()]), F.lit(self.buckets)).cast("int")

    def rows(self, state: State | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(key, text, fingerprint, bucket): the content of the table, or of some of its buckets."""
        state = state or self.state()
        parts = ([state.base] if state.base else []) + state.deltas
        found = None
        for version, folder in parts:
            own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").withColumn("_version", F.lit(version))
            found = own if found is None else found.unionByName(own)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        last = Window.partitionBy(*self.key).orderBy(F.col("_version").desc())
        return found.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_version")

    def _delta(self, rows: DataFrame) -> str:
        folder = f"delta/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{k}`").cast(t).alias(k) for k, t in self.key.items()], self.text, "fingerprint", self.bucket().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, batch: DataFrame, query: str, number: int, order: list[str] | None = None, force: bool = False) -> dict[str, int]:
        """How many keys of the batch were written, the same, overwritten or kept; nothing if the batch was here before.

        Of several rows of a key in the batch the last by `order`, then the greatest text counts; rows with a null key or
        text don't. A text that is no longer the one written last under its key is kept, but by force.
        """
        whole = [F.col(f"`{k}`").isNotNull() for k in self.key]
        for c in whole:
            batch = batch.where(c)
        line = Window.partitionBy(*self.key).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in order or []], F.col(f"`{self.text}`").desc())
        news = batch.where(F.col(f"`{self.text}`").isNotNull()).withColumn("_n", F.row_number().over(line)).where("_n = 1")
        news = news.select(*[F.col(f"`{k}`").cast(t).alias(k) for k, t in self.key.items()], self.text).persist()
        try:
            touched = sorted(r[0] for r in news.select(self.bucket()).distinct().collect())
            while True:
                state = self.state()
                if state.done.get(query, -1) >= number:
                    return {}
                there = self.rows(state, touched)
                now = upserted(news, there, there.select(*self.key, "fingerprint"), list(self.key), self.text, force).where("action <> 'none'").persist()
                try:
                    counts = {r[0]: r[1] for r in now.groupBy("action").count().collect()}
                    folder = self._delta(now.where("action IN ('write', 'overwrite')")) if counts.keys() & {"write", "overwrite"} else None
                    try:
                        self._commit(state.version + 1, {"kind": "delta", "folder": folder, "query": query, "batch": number} if folder else {"kind": "none", "query": query, "batch": number})
                    except Taken:
                        continue
                finally:
                    now.unpersist()
                break
        finally:
            news.unpersist()
        if len(state.deltas) + 1 >= self.compact_after:
            self.compact()
        return counts

    def edit(self, rows: DataFrame) -> None:
        """Texts as somebody changed them by hand: they replace what is there, and upserts keep them."""
        while True:
            state = self.state()
            there = self.rows(state).select(*self.key, "fingerprint")
            folder = self._delta(rows.select(*self.key, self.text).join(there, list(self.key), "left"))
            try:
                return self._commit(state.version + 1, {"kind": "delta", "folder": folder})
            except Taken:
                continue

    def compact(self) -> None:
        """Writes the content as a base. Deltas that come while it is written stay after it."""
        state = self.state()
        folder = f"base/{uuid.uuid4().hex}"
        self.rows(state).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        while True:
            now = self.state()
            if now.base != state.base:
                return  # another compaction was first
            after = [d for d in now.deltas if d not in state.deltas]
            try:
                return self._commit(now.version + 1, {"kind": "base", "folder": folder, "upto": state.version, "after": after, "done": now.done})
            except Taken:
                continue

    def sink(self, order: list[str] | None = None):
        """A foreachBatch function. The query's id is that of its checkpoint."""

        def run(batch: DataFrame, number: int) -> None:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if not query:
                raise RuntimeError("the query's id isn't known here: a batch that is run again couldn't be told from a new one")
            self.upsert(batch, query, number, order)

        return run
