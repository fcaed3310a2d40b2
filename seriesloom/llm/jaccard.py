"""Operator 4: similarity join of word-shingle sets by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.bitmaps import bitmap_of
from seriesloom.llm.common import partitions, returned, stored, table
from seriesloom.llm.components import components
from seriesloom.llm.shingles import U, shingles

#: Counters of the shingle counts by which prefixes are ordered: two for each document, from 2**20 to 2**24 (a byte each, as sent). More counters make candidates fewer, never wrong.
LEAST_BITS, MOST_BITS = 20, 24
CHUNKS = 64
#: Matches that a prefix may be lengthened to need.
MOST_MATCHES = 6
#: Up to this length a token's list gives pairs, beyond it links of sets of like size to their first. Both only say which sets are verified together; the demand is asked of every pair.
PAIRED_LIST = 32
#: Bytes of shingle sets in a block of a cluster.
BLOCK_BYTES = 6 << 20
#: Bits of the bitmap that keeps back documents whose sets have no candidate: 512 KB.
MEMBER_BITS = 22


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def _sid(key: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8, key=bytes([seed])).digest(), "little", signed=True)


def _least_overlap(n: np.ndarray | int, percent: int):
    """The shingles that a set of n must share with any similar one: similar sets have 100 * both >= percent * either."""
    return -(-n * percent // 100)


def _counter(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> U(64 - bits)).astype(np.int64)


def _count(df: DataFrame, k: int, seed: int, bits: int) -> DataFrame:
    """A row for each document (its set's size and keys), and rows with each task's counts of shingles by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        names = ["chunk", "doc_id", "text_key", "n", "sid", "key"]
        for batch in batches:
            n, sid, key = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, k)
                np.add.at(counts, _counter(s, bits), 1)
                n.append(len(s))
                key.append(_set_key(s))
                sid.append(_sid(key[-1], seed))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(key, pa.binary())], names=names)
        parts = counts.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), *(pa.nulls(CHUNKS, pa.int64()) for _ in range(4)), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return df.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "chunk int, doc_id long, text_key long, n long, sid long, key binary")


def _classes_of_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """A byte for each counter, twice the binary logarithm of its count: a fixed size, summed on the executors."""

    def total(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["key"])
        return pd.DataFrame({"chunk": [keys[0]], "classes": [np.round(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8).tobytes()]})

    found = {r["chunk"]: r["classes"] for r in rows.groupBy("chunk").applyInPandas(total, "chunk int, classes binary").collect()}
    empty = bytes((1 << bits) // CHUNKS)
    return np.frombuffer(b"".join(found.get(i, empty) for i in range(CHUNKS)), np.uint8)


def matches_needed(counts: np.ndarray, n: int, percent: int, documents: int) -> int:
    """How many shared prefix tokens to ask for: of 1 to MOST_MATCHES, the cheapest by estimate.

    counts: estimated frequencies of the set's tokens in their order. A longer prefix costs a look at the lists of the
    tokens that it adds; it leaves the documents that share so many of its tokens by chance to be verified.
    """
    first = n - int(_least_overlap(n, percent)) + 1
    best, least = 1, None
    for need in range(1, min(MOST_MATCHES, n - first + 1) + 1):
        lists = float(counts[: first + need - 1].sum())
        rate = min(lists / max(documents, 1), 50.0)
        term, below = np.exp(-rate), 0.0
        for i in range(need):
            below += term
            term *= rate / (i + 1)
        cost = lists + documents * max(0.0, 1 - below) * n / 16
        if least is None or cost < least:
            best, least = need, cost
    return best


class Prefixes:
    """The prefix of a set: its tokens in the counted order, rare ones first, and how many of them a similar set must share."""

    def __init__(self, classes: np.ndarray, percent: int, documents: int):
        estimate = 2.0 ** (np.arange(256) / 2)
        self.classes, self.percent, self.documents, self.bits = classes, percent, documents, len(classes).bit_length() - 1
        self.estimate = np.maximum(estimate - float(estimate[classes].mean()), 1.0)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        n, least = len(s), int(_least_overlap(len(s), self.percent))
        own = self.classes[_counter(s, self.bits)]
        # one order for sets of any size: the class, then the low 56 bits, then (s ascends, the sort is stable) the rest
        order = np.argsort((own.astype(U) << U(56)) | (s & U((1 << 56) - 1)), kind="stable")
        need = matches_needed(self.estimate[own[order[: n - least + MOST_MATCHES]]], n, self.percent, self.documents)
        return s[order[: n - least + need]], need


def _prefixes(df: DataFrame, k: int, seed: int, prefix: Prefixes) -> DataFrame:
    """token, sid, n, need for each token of each document's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(0).to_pylist():
                s = shingles(t, k)
                if not len(s):
                    continue
                chosen, need = prefix(s)
                out[0].append(chosen.view(np.int64))
                for column, value in zip(out[1:], (_sid(_set_key(s), seed), len(s), need), strict=True):
                    column.append(np.full(len(chosen), value, np.int64))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "sid", "n", "need"])
        returned()

    return df.select("text").mapInArrow(run, "token long, sid long, n long, need long").distinct()


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """a, b: sets to be verified together.

    Of each list of up to PAIRED_LIST sets, pairs that share as many tokens as the smaller demand; of a longer one, each
    set and the first of its run of like sizes, which a streaming task finds in the order of sizes.
    """

    def pairs(sid: np.ndarray, n: np.ndarray, need: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        out = []
        for g in np.unique(sizes):
            if g < 2:
                continue
            at = starts[sizes == g]
            i, j = np.triu_indices(g, 1)
            left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
            left, right = left[near], right[near]
            out.append(np.stack([np.minimum(sid[left], sid[right]), np.maximum(sid[left], sid[right]), np.minimum(need[left], need[right])]))
        return out

    def runs(sid: np.ndarray, n: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Links of sets, in ascending order of size, to the first of their run; before: the first and last set so far."""
        leader, last = before or (sid[0], n[0])
        new = percent * n > 100 * np.concatenate([[last], n[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
        first = np.where(at >= 0, sid[at], leader)
        other = first != sid
        return np.stack([first[other], sid[other], np.zeros(int(other.sum()), np.int64)]), (first[-1], n[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        long_token = state = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            out = []
            if long_token is not None:
                more = int(np.searchsorted(rows[0], long_token, side="right"))
                if more:
                    links, state = runs(rows[1][:more], rows[2][:more], state)
                    out.append(links)
                rows = [c[more:] for c in rows]
                if len(rows[0]):
                    long_token = None
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            held = [np.zeros(0, np.int64)] * 4
            if len(rows[0]):
                starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
                sizes = np.diff(np.concatenate([starts, [len(rows[0])]]))
                last = int(starts[-1])
                is_long = sizes > PAIRED_LIST
                for a, g in zip(starts[is_long], sizes[is_long], strict=True):
                    links, state = runs(rows[1][a : a + g], rows[2][a : a + g])
                    out.append(links)
                if is_long[-1]:
                    long_token = rows[0][last]
                else:
                    held = [c[last:] for c in rows]
                small = ~is_long
                small[-1] = False
                out += pairs(rows[1], rows[2], rows[3], starts[small], sizes[small])
            yield _edges(out)
        if len(held[0]):
            yield _edges(pairs(held[1], held[2], held[3], np.array([0]), np.array([len(held[0])])))

    dealt = prefixes.repartition(partitions(prefixes.sparkSession), "token").sortWithinPartitions("token", "n")
    found = dealt.select("token", "sid", "n", "need").mapInArrow(run, "a long, b long, need long")
    return found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")


def _edges(out: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["a", "b", "need"])


def _sets(df: DataFrame, members: DataFrame, k: int, seed: int) -> DataFrame:
    """sid, doc_id, shingles of the documents that stand for the members' sets.

    A bitmap of 2**MEMBER_BITS bits, made on the executors, keeps most other documents back before their texts are read in
    Python; the join with the members decides.
    """
    known = bitmap_of(members, "rep", MEMBER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            batch = batch.filter(pa.array(known(batch.column(0).to_numpy())))
            for doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(t, k)
                if len(s):
                    out.append((_sid(_set_key(s), seed), doc, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["sid", "doc", "shingles"])

    whole = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return whole.mapInArrow(run, "sid long, doc long, shingles binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each of left with each of right (or of left), from 0/1 matrices of the tokens that two sets have."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    counts = np.diff(np.concatenate([starts, [len(flat)]]))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    kept = np.repeat(counts > 1, counts)
    column, owner = column[kept], owner[kept]
    total = int((counts > 1).sum())
    out = np.zeros((len(left), len(right) if right is not None else len(left)))
    for at in range(0, total, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, total - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[: len(left)] @ (m[len(left) :] if right is not None else m).T
    return out.astype(np.int64)


def _verify(percent: int, prefix: Prefixes):
    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["sid", "block"])
        _, one, two = keys
        parts = [pdf[pdf["block"] == b] for b in ((one,) if one == two else (one, two))]
        sets = [[np.frombuffer(x, U) for x in p["shingles"]] for p in parts]
        # pairs that share as many tokens of their prefixes as the smaller demand; of the others nothing is compared
        heads = [[prefix(s) for s in x] for x in sets]
        need = [np.array([k for _, k in x], np.int64) for x in heads]
        asked = overlaps(*([p for p, _ in x] for x in heads)) >= np.minimum(need[0][:, None], need[-1][None, :])
        if one == two:
            np.fill_diagonal(asked, False)
        linked = np.zeros(asked.shape, bool)
        rows, columns = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
        if len(rows):
            chosen = [[sets[0][i] for i in rows], [sets[-1][j] for j in columns]]
            both = overlaps(*(chosen[:1] if one == two else chosen))
            n = [np.array([len(s) for s in x], np.int64) for x in chosen]
            either = n[0][:, None] + n[1][None, :] - both
            linked[np.ix_(rows, columns)] = asked[np.ix_(rows, columns)] & (100 * both >= percent * either)
        i, j = np.nonzero(linked)
        sid, copies = [p["sid"].to_numpy() for p in parts], [p["copies"].to_numpy() for p in parts]
        ids = np.concatenate(sid) if one != two else sid[0]
        weights = [linked @ copies[-1]] if one == two else [linked @ copies[1], linked.T @ copies[0]]
        root = forest(len(ids), i, j + (len(sid[0]) if one != two else 0))
        return pd.DataFrame({"sid": ids, "links": np.concatenate(weights), "root": ids[root]})

    return run


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component, the links being i - j."""
    root = np.arange(n)
    if not len(i):
        return root
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    nodes = a[starts]
    while True:
        new = root.copy()
        new[nodes] = np.minimum(root[nodes], np.minimum.reduceat(root[b], starts))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def jaccard_join(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id for each row of df (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of distinct shingles of `words` words (words:
    runs without ASCII white space, A-Z in lower case; a text of fewer words is one shingle). n_links: the other rows
    linked directly, copies included; component_id: the least doc_id reachable by links, itself included.
    Null and empty texts have no shingle and link with nothing. A row with a null doc_id links with nothing and has a
    null component. Rows with equal sets, repeated rows among them, link; two rows of one doc_id stay two rows. Other
    columns are not read. An empty table gives no rows. Words are compared by 64 bits of BLAKE2, shingles by 64 bits of their
    words' hashes.

    1. Shingles are counted into a fixed number of counters, which order them, rare ones first. Equal sets become one.
    2. Each set gives a prefix of that order. It is lengthened while the estimated cost of the candidates that it leaves
       falls; similar sets share as many prefix tokens as the smaller of their two demands.
    3. Sets that are to be verified together become a cluster: pairs of short lists that meet the demand, and the sets of
       like size of long lists, which groups of near copies make. Every similar pair lies in one cluster.
    4. Each set is sent once to its cluster, or, where the cluster is large, to each pair of blocks of sets whose sizes
       are compatible. There every pair is held against the demand, and pairs that meet it are verified by counting all
       shingles. No pair is sent on; sums of links and a spanning forest are.
    """
    return groups(df, words, percent).select("doc_id", "n_shingles", "n_links", "component_id")


def groups(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """As jaccard_join, with text_key, xxhash64 of the text, and group, which rows reachable by links share and no others: a
    row of several of one doc_id can be told by the one, and its group by the other. Rows that link with nothing for lack
    of words or of a doc_id have no group.
    """
    docs, seed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 0
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * docs.count()).bit_length()))
    while True:
        counted = stored(_count(docs, words, seed, bits), "shingle-counts")
        rows = counted.where("chunk is null")
        sets = rows.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min("key").alias("k0"), F.max("key").alias("k1"))
        sums = sets.agg(F.count("*"), F.sum(F.when(F.col("k0") != F.col("k1"), 1).otherwise(0))).head()
        if not sums[1]:
            break
        seed += 1  # two sets share a 64-bit key: another key
    sets = sets.select("sid", "rep", "n", "copies")
    prefix = Prefixes(_classes_of_counts(counted.where("chunk is not null"), bits), percent, sums[0])
    prefixes = _prefixes(docs.where("doc_id is not null"), words, seed, prefix)
    clusters = stored(components(_candidates(prefixes, percent)).select(F.col("id").alias("sid"), F.col("component").alias("cluster")), "clusters")
    members = stored(clusters.join(sets, "sid"), "members")
    linked = stored(_linked(docs, members, words, percent, seed, prefix), "linked")
    sums_of_links = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    found = components(linked.where("sid != root").select("sid", "root")).join(members.select(F.col("sid").alias("id"), "rep"), "id")
    least = found.groupBy("component").agg(F.min("rep").alias("least"))
    of_set = sets.join(sums_of_links, "sid", "left").join(found.join(least, "component").select(F.col("id").alias("sid"), "least", "component"), "sid", "left")
    of_set = of_set.select("sid", F.coalesce("component", "sid").alias("group"), F.coalesce("least", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keyed = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sid")).alias("sid"))
    return keyed.join(of_set, "sid", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def _linked(docs: DataFrame, members: DataFrame, words: int, percent: int, seed: int, prefix: Prefixes) -> DataFrame:
    # sizes in steps of 5 %: similar sets are at most `reach` steps apart
    step = float(np.log(1.05))
    reach = int(np.ceil(np.log(100 / percent) / step)) + 1
    sized = members.withColumn("g", F.floor(F.log("n") / step).cast("int"))
    whole = sized.groupBy("cluster").agg(F.sum("n").alias("all"))
    small = F.col("all") * 8 <= BLOCK_BYTES
    sized = sized.join(whole, "cluster").withColumn("g", F.when(small, 0).otherwise(F.col("g")))
    blocks = sized.groupBy("cluster", "g").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("parts"), F.max(small).alias("small"))
    sized = sized.join(blocks.select("cluster", "g", "parts"), ["cluster", "g"]).withColumn("block", F.when(small, F.lit(0).cast("long")).otherwise(F.col("g").cast("long") * 1_000_000 + F.pmod(F.xxhash64("sid"), F.col("parts"))))
    each = blocks.where("not small").select("cluster", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("h")).select("cluster", "g", (F.col("g").cast("long") * 1_000_000 + F.col("h")).alias("block"))
    other = each.select("cluster", F.col("g").alias("g2"), F.col("block").alias("block2"))
    partners = each.join(other, "cluster").where(F.abs(F.col("g") - F.col("g2")) <= reach).select("cluster", "block", "block2")
    dealt = sized.join(partners, ["cluster", "block"], "left").select("sid", "rep", "copies", "cluster", "block", F.least("block", F.coalesce("block2", "block")).alias("one"), F.greatest("block", F.coalesce("block2", "block")).alias("two"))
    found = _sets(docs, members, words, seed)
    rows = found.join(dealt, (found["sid"] == dealt["sid"]) & (found["doc"] == dealt["rep"])).select(dealt["sid"], "copies", "cluster", "block", "one", "two", "shingles")
    return rows.groupBy("cluster", "one", "two").applyInPandas(_verify(percent, prefix), "sid long, links long, root long")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
