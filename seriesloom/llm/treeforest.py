"""Operator 3: near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import stored, table
from seriesloom.llm.components import components
from seriesloom.llm.jaccard import forest as least_of_component

TREES = 5
#: Vectors of a label that a leaf is to hold, about.
LEAF = 400
#: Vectors that a leaf's task compares at once; larger leaves are compared block by block.
BLOCK = 2048
#: Rows of the sample that sets the thresholds of the splits. Every vector is routed through them.
SAMPLE = 20_000
#: A vector this near to a split, times the standard deviation of a random unit projection, goes to both sides.
SPILL = 0.08
DEEPEST = 16
#: Share of the near pairs at a node that one tree may lose: with five trees, about 0.5 % are then lost by all.
LOSS = 0.35
#: Rows of a node's part of the sample among which near pairs are looked for.
PROBED = 512


def usable(vector: str, label: str, key: str) -> Column:
    """Rows that can link: known key and label, and a vector of finite numbers that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(key).isNotNull() & F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Trees:
    """Random splits: each level of a tree has a direction, each node a threshold, the median of its part of the sample.

    A node is not split where the share of near pairs lost on its path would pass LOSS: of the near pairs among its part of
    the sample those that the split parts, or without enough of them the share of its parent.
    """

    def __init__(self, sample: np.ndarray, depth: int, seed: int, least: float = 0.98):
        self.depth, self.dim = depth, sample.shape[1]
        rng = np.random.default_rng([seed, self.dim])
        d = rng.standard_normal((TREES, depth, self.dim))
        self.directions = (d / np.sqrt((d * d).sum(2))[:, :, None]).astype(np.float32)
        self.thresholds = np.zeros((TREES, max(1, (1 << depth) - 1)), np.float32)
        self.whole = np.zeros((TREES, 1 << (depth + 1)), bool)
        spill = SPILL / np.sqrt(self.dim)
        for t in range(TREES):
            projections = sample @ self.directions[t].T
            parts = [(np.arange(len(sample)), 1.0, 0.02)]
            for level in range(depth):
                middle = float(np.median(projections[:, level])) if len(sample) else 0.0
                below = []
                for node, (rows, kept, lost) in enumerate(parts):
                    values = projections[rows, level]
                    cut = float(np.median(values)) if len(rows) >= 16 else middle
                    self.thresholds[t, (1 << level) - 1 + node] = cut
                    some = rng.permutation(len(rows))[:PROBED]
                    i, j = np.nonzero(np.triu(sample[rows[some]] @ sample[rows[some]].T >= least, 1))
                    if len(i) >= 30:
                        v = values[some]
                        lost = max(0.02, float(((np.minimum(v[i], v[j]) <= cut - spill) & (np.maximum(v[i], v[j]) > cut + spill)).mean()))
                    if kept * (1 - lost) < 1 - LOSS:
                        self.whole[t, (1 << level) + node] = True
                    kept *= 1 - lost
                    # the sample is spilled like the rows, so that a part holds the pairs that are still together
                    below += [(rows[values <= cut + spill], kept, lost), (rows[values > cut - spill], kept, lost)]
                parts = below

    def cells(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for each leaf of each tree that a row falls into; a row is split at most as often as depth says."""
        spill = SPILL / np.sqrt(self.dim)
        rows_out, cells_out = [], []
        for t in range(TREES):
            projections = x @ self.directions[t].T
            # the root is node 1, the halves of a node are 2 * node and 2 * node + 1
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                going = (depth[row] > level) & ~self.whole[t, node]
                value = np.where(going, projections[row, level] - self.thresholds[t, np.where(going, node, 1) - 1], 0)
                left, right = going & (value <= spill), going & (value > -spill)
                still = ~going
                row, node = np.concatenate([row[still], row[left], row[right]]), np.concatenate([node[still], node[left] * 2, node[right] * 2 + 1])
            rows_out.append(row)
            cells_out.append((np.int64(t) << 40) | node)
        return np.concatenate(rows_out), np.concatenate(cells_out)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1)[:, None] if len(x) else x
    return x / np.sqrt((x * x).sum(1))[:, None] if len(x) else x


def _compare(least: float):
    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, one, two = keys[1], keys[3], keys[4]
        first = pdf[pdf["block"] == one]
        second = first if one == two else pdf[pdf["block"] == two]
        ids = [p["id"].to_numpy() for p in (first, second)]
        x = [_unit(p["vector"]) for p in (first, second)]
        # cells of other leaves that stand before this one: a pair that shares one is counted there
        earlier = [[c[c < cell] for c in p["cells"]] for p in (first, second)]
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *earlier[0], *earlier[1]]))

        def marks(lists):
            m = np.zeros((len(lists), len(every)), np.float32)
            for i, c in enumerate(lists):
                m[i, np.searchsorted(every, c)] = 1
            return m

        m = [marks(e) for e in earlier]
        weights = [np.zeros(len(first), np.int64), np.zeros(len(second), np.int64)]
        copies = [p["copies"].to_numpy() for p in (first, second)]
        links: list[np.ndarray] = []
        for a in range(0, len(first), 512):
            near = x[0][a : a + 512] @ x[1].T >= least
            if one == two:
                near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            i, j = np.nonzero(near)
            links.append(np.stack([i + a, j]))
            counted = near & (m[0][a : a + 512] @ m[1].T == 0)
            weights[0][a : a + 512] += counted @ copies[1]
            if one != two:
                weights[1] += counted.T @ copies[0][a : a + 512]
        i, j = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
        if one == two:
            all_ids, w = ids[0], weights[0]
        else:
            all_ids, w, j = np.concatenate(ids), np.concatenate(weights), j + len(first)
        root = least_of_component(len(all_ids), i, j)
        out = pd.DataFrame({"id": all_ids, "links": w, "root": all_ids[root]})
        return out[(out["links"] > 0) | (out["id"] != out["root"])]

    return run


def near_vectors(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 5) -> DataFrame:
    """key, n_links, component_id, kept for each row: rows of equal label whose cosine is at least `least` link.

    Rows whose key, label or vector is null, whose vector is zero or holds a null or a number that is not finite, and
    vectors of another length than a row's link with nothing; such a row is a component of its own (a null key has a
    null component). n_links: the other rows linked directly; component_id: the least key reachable by links; kept: the
    row has that key. Equal vectors of a label become one row with a count first, so that copies cost nothing; repeated
    rows are copies. Other columns are not read. An empty table gives no rows.

    Each tree splits at random directions, at the medians of a sample of SAMPLE rows; all rows are routed, and those near a
    split go to both sides. The trees of a label are as deep as its number of vectors asks for, so that a leaf holds
    about LEAF of them; a node whose split would part too many near pairs stays one leaf. Pairs within a leaf are compared by cosine in double precision; a pair that meets in several
    leaves is counted in the first. Leaves of more than BLOCK rows are compared by pairs of blocks. No pair leaves a
    task: sums of links and a spanning forest do. Cosines are exact; pairs that no tree brings together are missed.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"), usable(vector, label, key).alias("ok"))
    good = rows.where("ok")
    classes = stored(good.groupBy("label", "vector").agg(F.min("key").cast("long").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")), "vectors")
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    depths = groups.withColumn("depth", F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("n") / LEAF)).cast("int"))))
    trees = {}
    for r in depths.groupBy("dim").agg(F.max("depth").alias("depth"), F.sum("n").alias("n")).collect():
        share = classes.where(F.col("dim") == r["dim"])
        if r["n"] > SAMPLE:
            share = share.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / r["n"]))
        sample = share.select("vector").limit(2 * SAMPLE).toPandas()["vector"] if r["depth"] else pd.Series([], dtype=object)
        trees[r["dim"]] = Trees(_unit(sample).astype(np.float32) if len(sample) else np.zeros((0, r["dim"]), np.float32), r["depth"], seed, least)

    def route(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                row, cell = trees[dim].cells(_unit(part["vector"]).astype(np.float32), part["depth"].to_numpy())
                order = np.argsort(row, kind="stable")
                lists = np.split(cell[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                yield part[["label", "dim", "id", "copies", "vector"]].assign(cells=[np.sort(c) for c in lists])

    kind = dict(classes.dtypes)["vector"]
    routed = classes.join(depths.drop("n"), ["label", "dim"]).select("label", "dim", "id", "copies", "vector", "depth")
    routed = stored(routed.mapInPandas(route, f"label string, dim int, id long, copies long, vector {kind}, cells array<long>"), "routed")
    placed = routed.withColumn("cell", F.explode("cells"))
    sizes = routed.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = sizes.withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows")
    placed = placed.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("label", "cell", "dim", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "copies", "vector", "cells")
    found = stored(placed.groupBy("label", "cell", "dim", "one", "two").applyInPandas(_compare(least), "id long, links long, root long"), "near")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id != root").select("id", "root"))
    of_class = classes.select("label", "vector", "id", "copies").join(links, "id", "left").join(joined, "id", "left")
    of_class = of_class.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    alone = rows.where("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id"))
    out = good.join(of_class, ["label", "vector"]).select("key", "n_links", "component_id").union(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
