"""Placement as capacitated assignment by auction: bids and price rises over tables, with a dual bound.

``pairs`` has person, object and benefit, ``slots`` object and slots. This is the relaxation of placing
virtual on physical nodes, which is integral: prices are its dual solution, so every run certifies how far
its placement can be from the best one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import ranged, saved


@dataclass
class Placement:
    """``placed`` (person, object, benefit), ``prices`` (object, slots, price); no placement is worth more than ``dual``."""

    placed: DataFrame
    prices: DataFrame
    primal: float
    dual: float
    rounds: int


def auction(pairs: DataFrame, slots: DataFrame, epsilon: float, rounds: int | None = None) -> Placement:
    """Each person on one object at most, each object in its slots; the benefit is within ``epsilon`` a person of the best.

    In a round, every person without a place bids for the object of most value (benefit less price), up to what the
    second best leaves plus ``epsilon``, and every object keeps its highest bids. Persons to whom no object is worth
    its price leave. With whole benefits and ``epsilon`` under 1 / persons the placement is the best there is. A limit
    on the ``rounds``, whose number grows with the largest benefit over ``epsilon``, leaves those out that still bid; the
    bound holds all the same. Pairs without a positive
    benefit are no pairs; of repeated pairs the largest benefit counts, of repeated slots the largest number.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be over 0")
    pairs = pairs.where("benefit > 0").select("person", "object", F.col("benefit").cast("double").alias("benefit"))
    # a person's pairs lie side by side, so few rows of each leave the task that reads them
    pairs = saved(ranged(pairs, "person", "object").groupBy("person", "object").agg(F.max("benefit").alias("benefit")))
    room = saved(slots.where("slots > 0").groupBy("object").agg(F.max("slots").cast("long").alias("slots")))
    most = room.agg(F.max("slots")).first()[0] or 0
    held = pairs.where("false").select("person", "object", "benefit", F.col("benefit").alias("bid"))
    free, waiting, done = saved(room.select("object", F.lit(0.0).alias("price"))), None, 0
    while rounds is None or done < rounds:
        few = waiting is not None and 8 * waiting.count() < everyone
        offers = pairs.join(waiting, "person", "left_semi") if few else pairs
        offers = offers.join(free, "object").withColumn("value", F.col("benefit") - F.col("price")).where("value > 0")
        nth = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("value"), "object"))
        two = offers.withColumn("nth", nth).where("nth <= 2").groupBy("person")
        best = two.agg(F.max(F.when(F.col("nth") == 1, F.struct("object", "benefit"))).alias("b"), F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("value"))), F.lit(0.0)).alias("second"))
        if not few and waiting is not None:
            # an inner join, as a semi join would go before the window, with all pairs; a person waits once
            best = best.join(waiting, "person")
        bids = saved(best.select("person", "b.object", "b.benefit", (F.col("b.benefit") - F.col("second") + epsilon).alias("bid")))
        turn = F.row_number().over(Window.partitionBy("object").orderBy(F.desc("bid"), "person"))
        # the literal bound lets each task drop what no object has slots for, before the shuffle
        both = held.union(bids)
        ranked = both.withColumn("turn", turn).where(F.col("turn") <= most)
        ranked = saved(ranked.join(room, "object").where(F.col("turn") <= F.col("slots")).select("person", "object", "benefit", "bid", (F.col("turn") == F.col("slots")).alias("last")))
        kept = ranked.drop("last")
        # a small table of its own, which every task can hold: the last bid that an object with all slots taken accepts
        price = ranked.where("last").select("object", F.col("bid").alias("price"))
        free = saved(room.select("object").join(price, "object", "left").select("object", F.coalesce("price", F.lit(0.0)).alias("price")))
        if waiting is None:
            everyone = bids.count()
        waiting = saved(both.select("person").join(kept.select("person"), "person", "left_anti"))
        held, done = kept, done + 1
        if waiting.isEmpty():
            break
    prices = saved(room.join(free, "object"))
    placed = saved(held.select("person", "object", "benefit"))
    return Placement(placed, prices, *bounds(pairs, prices, placed), done)


def bounds(pairs: DataFrame, prices: DataFrame, placed: DataFrame) -> tuple[float, float]:
    """(benefit of a placement, what no placement can exceed at these prices)."""
    gains = pairs.join(prices, "object").groupBy("person").agg(F.max(F.col("benefit") - F.col("price")).alias("gain"))
    worth = gains.agg(F.sum(F.greatest("gain", F.lit(0.0)))).first()[0] or 0.0
    paid = prices.agg(F.sum(F.col("slots") * F.col("price"))).first()[0] or 0.0
    return placed.agg(F.sum("benefit")).first()[0] or 0.0, worth + paid


def unhappy(pairs: DataFrame, prices: DataFrame, placed: DataFrame, epsilon: float) -> DataFrame:
    """Persons (person, missed) that some object at its price, or none at all, would suit better by more than ``epsilon``."""
    values = pairs.join(prices, "object").select("person", "object", (F.col("benefit") - F.col("price")).alias("value"))
    best = values.groupBy("person").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("best"))
    own = placed.select("person", "object").join(values, ["person", "object"]).select("person", F.col("value").alias("own"))
    missed = best.join(own, "person", "left").select("person", (F.col("best") - F.coalesce("own", F.lit(0.0))).alias("missed"))
    return missed.where(F.col("missed") > epsilon * (1 + 1e-9))
