"""Proportional stratified interleaving: shards of equal counts that each have the mixture of the sources.

Rows are shuffled within each source by a seeded hash and ranked; row r of a source of n rows has the fractional rank
(r + 1/2) / n. Rows sorted by fractional rank interleave the sources in proportion, so that any stretch of that order
holds the mixture, and cutting it into equal stretches gives the shards.

Both rankings are made over many tasks. A rank is the number of rows in lower buckets plus a row number in the own
bucket, and buckets hold about rows_per_bucket rows whatever the source: for the first ranking they are ranges of the
hash, for the second ranges of the fractional rank. A source with a third of all rows has more buckets, not a larger one.
Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SALT = 64


def before(df: DataFrame, keys: list[str], bucket: str, size: str | None = None, span: int = 1000) -> DataFrame:
    """(keys, bucket, _x_before): for each bucket the rows of lower ones with the same keys, or the sum of their sizes.

    Buckets are summed by spans of so many, and spans before each other, so that no task sorts more than span buckets
    or one row for each span.
    """
    counts = df.groupBy(*keys, bucket).agg((F.sum(size) if size else F.count("*")).alias("_x_c")).withColumn("_x_span", F.floor(F.col(bucket) / span))
    lower = lambda keys, by: F.coalesce(F.sum("_x_c").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy(*keys, "_x_span").agg(F.sum("_x_c").alias("_x_c")).withColumn("_x_whole", lower(keys, "_x_span")).drop("_x_c")
    inside = counts.withColumn("_x_part", lower([*keys, "_x_span"], bucket))
    return inside.join(spans, [*keys, "_x_span"]).select(*keys, bucket, (F.col("_x_whole") + F.col("_x_part")).alias("_x_before"))


def interleave(df: DataFrame, stratum: str = "source", ids: tuple[str, ...] = ("doc_id",), shards: int = 16, seed: str = "lectern-5", rows_per_bucket: int = 1000) -> DataFrame:
    """Adds shard (int), slot (long, gapless from 0 in each shard) and fraction (rational rank as double).

    ids orders and seeds the rows. A null stratum is a stratum of its own; null ids count as ''. Repeated rows each take
    a place of their own; which of them takes which isn't defined. No rows give no rows. Columns named shard, slot or
    fraction are replaced. Give narrow rows: they are shuffled twice.
    """
    given = [c for c in df.columns if c.lower() not in {"shard", "slot", "fraction"}]
    # Names of their own while the work goes on: columns may have any.
    own = {c: f"_c{i}" for i, c in enumerate(given)}
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    names, stratum, ids = df.columns, own[stratum], tuple(own[i] for i in ids)
    order = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ids]).cast("binary"))
    keyed = df.withColumns({"_x_s": F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")), "_x_o": order})

    sizes = keyed.groupBy("_x_s").agg(F.count("*").alias("_x_n"))
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    # 28 bits of the hash, as a share of the range
    place = F.conv(F.substring("_x_o", 1, 7), 16, 10).cast("long")
    # The sizes go to a source's rows by SALT keys, so that a source with a third of all rows isn't one task's.
    salted = sizes.withColumn("_x_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keyed = keyed.withColumn("_x_salt", F.pmod(F.hash("_x_o"), F.lit(SALT))).join(salted, ["_x_s", "_x_salt"]).drop("_x_salt")
    keyed = keyed.withColumn("_x_b", F.floor(place * F.ceil(F.col("_x_n") / rows_per_bucket) / F.lit(1 << 28)).cast("long"))
    # By buckets, whatever the join has dealt the rows by.
    keyed = keyed.repartition("_x_s", "_x_b")
    in_bucket = Window.partitionBy("_x_s", "_x_b").orderBy("_x_o", *[F.col(f"`{c}`").asc_nulls_first() for c in ids])
    first = (
        keyed.withColumn("_x_r", F.row_number().over(in_bucket) - 1)
        .join(before(keyed, ["_x_s"], "_x_b"), ["_x_s", "_x_b"])
        .withColumn("_x_r", (F.col("_x_r") + F.col("_x_before")).cast("long"))
        .withColumn("fraction", (2 * F.col("_x_r") + 1) / (2 * F.col("_x_n")))
        .withColumn("_x_f", F.least(F.floor(F.col("fraction") * buckets).cast("long"), F.lit(buckets - 1)))
    )
    first = written(first.select(*[F.col(f"`{c}`") for c in names], "_x_s", "_x_r", "_x_f", "fraction"), "interleave")

    starts = before(first, [], "_x_f")
    here = Window.partitionBy("_x_f").orderBy("fraction", "_x_s", "_x_r")
    place = (F.col("_x_before") + F.row_number().over(here) - 1).cast("long")
    out = first.join(starts, "_x_f").withColumn("_x_p", place)
    shard = F.expr(f"cast((_x_p * {shards}) div {max(total, 1)} as int)")
    out = out.withColumn("shard", shard)
    # The first place of shard s is the least p with p * shards >= s * total.
    out = out.withColumn("slot", F.expr(f"_x_p - ((cast(shard as bigint) * {total} + {shards - 1}) div {shards})"))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], "fraction", "shard", "slot")


def op5_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the contract, with the source and its fractional rank."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = interleave(slim, shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")
