"""Work that is tried again: rounds over what is flagged alone, as far as each provider's budget goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import accounting, content
from .lineage import cut

#: What an attempt says of a piece of work, from which the best is chosen (see content.best_attempts).
RESULT = "flagged", "omission_run", "insertion_run", "omissions", "insertions", "wer"


def rounds(first: DataFrame, again: Callable[[DataFrame, int], DataFrame], keys: list[str], provider: str, order: list[str], cost: str, left: DataFrame, most: int, cached: Callable[[DataFrame, int], DataFrame] | None = None, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, provider, attempt, RESULT) of the best attempt at each piece of work, and (provider, round, tried, refused, cost) of each round.

    first has (keys, provider, order, cost, RESULT) of attempt 0; again gives (keys, RESULT) of an attempt at rows of it;
    left has (provider, left), what may be spent on retries, nothing where a provider isn't named. A round takes the
    pieces whose best attempt so far is flagged, in order, as long as their costs fit what is left of their provider's
    budget after the rounds before; a piece that doesn't fit isn't tried any more. cached(rows, round) adds a boolean
    `cached`: those attempts cost nothing and always fit. After `most` rounds, or when none is tried, it ends.

    Each round reads only the pieces that are still flagged. bucket is a value that never falls in the order, which spreads a
    provider with most pieces over many tasks (see accounting.running_guard).
    """
    work = cut(first.select(*dict.fromkeys([*keys, provider, *order]), F.col(cost).alias("_cost"), *RESULT))
    attempts = work.select(*keys, provider, F.lit(0).alias("attempt"), *RESULT)
    pending, budget, spent, number = work.where("flagged"), left, None, 0
    while number < most:
        number += 1
        rows = cached(pending, number) if cached else pending.withColumn("cached", F.lit(False))
        rows = rows.withColumn("_due", F.when(F.col("cached"), F.lit(0)).otherwise(F.col("_cost")))
        guarded = accounting.running_guard(rows, [provider], order, "_due", 0.0, 0.0, bucket).drop("allowed").join(budget, provider, "left")
        fits = F.col("cached") | (F.col("spent_before") + F.col("_due") <= F.coalesce(F.col("left"), F.lit(0)))
        tried = cut(guarded.withColumn("_fits", fits).drop("left", "spent_before"))
        if tried.where("_fits").isEmpty() and tried.isEmpty():
            break
        of_round = tried.groupBy(provider).agg(F.count_if("_fits").alias("tried"), F.count_if(~F.col("_fits")).alias("refused"), F.coalesce(F.sum(F.when(F.col("_fits"), F.col("_due"))), F.lit(0)).alias("cost"))
        of_round = cut(of_round.withColumn("round", F.lit(number)))
        spent = of_round if spent is None else spent.unionByName(of_round)
        own = tried.where("_fits").drop("_fits", "_due", "cached")
        new = cut(again(own, number).select(*keys, *RESULT).withColumn("attempt", F.lit(number)))
        attempts = attempts.unionByName(new.join(own.select(*keys, provider), keys).select(*keys, provider, "attempt", *RESULT))
        # What is best so far decides whether a piece is tried again.
        so_far = own.select(*keys, *RESULT).withColumn("attempt", F.lit(-1)).unionByName(new)
        best = content.best_attempts(so_far, keys)
        pending = cut(own.drop(*RESULT).join(best.where("flagged").select(*keys, *RESULT), keys))
        budget = cut(budget.join(of_round.select(provider, F.col("cost").alias("_spent")), provider, "left").select(provider, (F.col("left") - F.coalesce("_spent", F.lit(0))).alias("left")))
    if spent is None:
        spent = work.select(provider, F.lit(0).cast("long").alias("tried"), F.lit(0).cast("long").alias("refused"), F.col("_cost").alias("cost"), F.lit(0).alias("round")).limit(0)
    return content.best_attempts(attempts, [*keys, provider]), spent.select(provider, "round", "tried", "refused", "cost")
