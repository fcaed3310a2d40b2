"""Operator 9: sources mixed to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import partitions, row_key, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def cycled(sources: list) -> dict:
    """Weights 5, 2, 1, repeating over the sources by code point, null last."""
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-8"))))}


def fill(sizes: dict, weights: dict, total: Fraction, most: int) -> dict:
    """Shares of total by weight, none above most times its size; what is above is shared again by weight."""
    targets = {s: Fraction(0) for s in sizes}
    open_, left = {s for s in sizes if sizes[s] > 0 and weights[s] > 0}, total
    while open_ and left > 0:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] > most * sizes[s] * weight}
        if not full:
            for s in open_:
                targets[s] = left * weights[s] / weight
            break
        for s in full:
            targets[s] = Fraction(most * sizes[s])
        left -= sum(targets[s] for s in full)
        open_ -= full
    return targets


def knots(rank: int, of: int) -> list[tuple[float, float]]:
    """The default schedule: the first source falls to a third of its first weight, the last one rises to three times."""
    tilt = 0.0 if of < 2 else rank / (of - 1)
    return [(0.0, 1.5 - tilt), (0.5, 1.0), (1.0, 0.5 + tilt)]


def integrated(schedule: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces (t0, t1, w0, w1, demand before t0) of a piecewise linear schedule over [0, 1], whose whole demand is made 1."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), a in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        out.append((t0, t1, w0 / whole, w1 / whole, before))
        before += a / whole
    return out


def inverted(demand: Column, pieces: Column) -> Column:
    """The time at which cumulative demand is reached: each piece is a quadratic."""
    piece = F.coalesce(F.element_at(F.filter(pieces, lambda p: p["before"] <= demand), -1), F.element_at(pieces, 1))
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    rest = demand - piece["before"]
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(piece["t0"] + 2 * rest / F.greatest(piece["w0"] + root, F.lit(1e-300)), piece["t1"])


def _order(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.lower(F.hex(key))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(df: DataFrame, share: Fraction = Fraction(3, 2), most: int = 2, weigh: Callable[[list], dict] = cycled, schedule: Callable[[int, int], list[tuple[float, float]]] = knots, seed: int = 17, ordered: bool = True, text: str = "text", source: str = "source", block_rows: int = 20_000) -> DataFrame:
    """df with size, source_size, target, taken and positions, in ascending order of the first position, untaken rows
    last, or, where they are not to be ordered, as they come.

    size: the words of the text (null: 0). The sources, null among them, share `share` of all sizes by their weights, at
    most `most` times their own size each. Within a source, rows stand in a fixed pseudo-random order and are taken from
    the start, again from the start if the target is above the source's size, until exactly the target (rounded to whole
    words) is taken: `taken` is a row's words, `positions` the training position from 0 to 1 of each time it is taken.
    A position is the time at which the source's schedule, integrated and scaled to its target, asks for the row's
    middle word.

    Rows that are repeated count each; ties of the order (equal rows) are alike, and share what they take in any order.
    Rows without words are never taken. Columns of these names in df are replaced; all others are kept. One row for
    each source reaches the driver. No task needs a whole source: running sums are taken over blocks of about
    block_rows rows, and over the blocks' sums.
    """
    spark = df.sparkSession
    own = ["size", "source_size", "target", "taken", "positions"]
    kept = [c for c in df.columns if c not in own]
    names = ["doc_id", text, source] if "doc_id" in df.columns else [text, source]
    base = df.select(*kept, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _order(row_key(*names), seed).alias("__order"))
    totals = {r[source]: (r["size"], r["n"]) for r in df.select(F.col(source), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")).groupBy(source).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    sizes = {s: v[0] for s, v in totals.items()}
    weights = weigh(list(sizes))
    targets = fill(sizes, weights, share * sum(sizes.values()), most)
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    rows = [(s, sizes[s], float(targets[s]), int(targets[s] + Fraction(1, 2)), max(1, -(-totals[s][1] // block_rows)), [list(p) for p in integrated(schedule(i, len(ranked)))]) for i, s in enumerate(ranked)]
    kind = f"`{source}` {dict(df.dtypes)[source]}, source_size long, target double, __words long, __blocks long, __pieces array<struct<t0:double,t1:double,w0:double,w1:double,before:double>>"
    plan = spark.createDataFrame(rows, kind).withColumnRenamed(source, "__source")
    base = base.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, F.col(source).eqNullSafe(F.col("__source")), "left").withColumn("__block", F.floor(F.col("__order").cast("double") / F.lit(2.0**60) * F.col("__blocks")))
    block = Window.partitionBy("__source", "__block")
    inside = block.orderBy("__order", "size")
    # each block's words before it, from the blocks' sums
    sums = base.groupBy("__source", "__block").agg(F.sum("size").alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sums.select(F.col("__source").alias("__s"), F.col("__block").alias("__b"), "__start")
    rows = base.withColumn("__before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    rows = rows.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left").withColumn("__before", F.col("__before") + F.col("__start"))
    times = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col("__before") + k * F.col("source_size"))
    rows = rows.withColumn("__at", F.filter(times, lambda a: (a < F.col("__words")) & (F.col("size") > 0)))
    rows = rows.withColumn("taken", F.aggregate(F.col("__at"), F.lit(0).cast("long"), lambda x, a: x + F.least(F.col("size"), F.col("__words") - a)))
    middle = lambda a: (a + F.least(F.col("size"), F.col("__words") - a) / 2) / F.col("__words")
    rows = rows.withColumn("positions", F.transform("__at", lambda a: inverted(middle(a), F.col("__pieces"))))
    out = rows.select(*kept, *own)
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return out.repartitionByRange(partitions(spark), first).sortWithinPartitions(first) if ordered else out


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    slim = mix(docs.select("doc_id", "source", "text"))
    return slim.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("position_again"))
