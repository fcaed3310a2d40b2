"""Connected components of a graph given as links, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import dropped, stored

MOST_ROUNDS = 100


def _sums(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every end of an edge; edges: two long columns, in any direction.

    Alternates large-star and small-star steps until nothing changes. Each round is a table in the shared folder, which
    cuts the lineage, and the round before it is deleted; only two sums of a round reach the driver. Edges with a null end are ignored, loops give their end
    as a component of its own. Raises when MOST_ROUNDS rounds do not suffice.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    # a loop is kept through the rounds as (u, u)
    now = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        sums = _sums(now)
        if sums == before or not sums[0]:
            break
        before = sums
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(now.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(small.union(least.select("u", "m")).distinct(), "links")
        dropped(last)
    else:
        if _sums(now) != before:
            raise RuntimeError(f"components still changed after {MOST_ROUNDS} rounds")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
