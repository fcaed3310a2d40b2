"""Operator 5: long repeated byte strings, from the common-prefix intervals of a sparse enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.bitmaps import bitmap
from seriesloom.llm.common import partitions, stored, table
from seriesloom.llm.shingles import _BYTE, POWERS, U, mixed

#: Bytes of the string whose least hash in a window is the window's anchor.
ANCHOR = 64
#: Distinct surroundings of an anchor above which its windows are counted one by one instead of sorted in a task.
CROWDED = 50_000
#: Places of one surrounding above which its run goes to all tasks, rather than its places to one.
COMMON = 10_000
#: Bits of the bitmaps that keep back anchors which occur once, and documents without repeats: 4 MB and 512 KB.
ANCHOR_BITS, DOCUMENT_BITS = 25, 22
#: A text is looked through in pieces of so many bytes.
PIECE = 1 << 19
ANCHORS = "anchor long, seg binary, did long, dkey long, pos int, before int, after int"


def anchors(data: bytes, length: int) -> np.ndarray:
    """Places of the anchors: equal windows of `length` bytes have theirs at the same distance, wherever they stand.

    Each window's anchor is the leftmost of its ANCHOR-byte strings of least hash.
    """
    found = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data, np.uint8)[at : at + PIECE + length - 1]
        if len(piece) >= length:
            found.append(_least(piece, length) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _sums(b: np.ndarray) -> np.ndarray:
    up, _ = POWERS.to(len(b) + 1)
    return np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[b] * up[: len(b)], dtype=U)])


def _grams(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.to(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def _least(b: np.ndarray, length: int) -> np.ndarray:
    sums, n = _sums(b), len(b) - ANCHOR + 1
    _, down = POWERS.to(n)
    place = np.arange(n, dtype=U)
    keys = (mixed((sums[ANCHOR:] - sums[:n]) * down) >> U(20) << U(20)) | place
    width = length - ANCHOR + 1
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return np.unique((least & U((1 << 20) - 1)).astype(np.int64))


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, text and the row's key: two equal rows have one."""
    d = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("dkey"))


def digest(data: bytes, before: int = 0) -> bytes:
    """128 bits that tell strings apart; before: the place of the anchor in them."""
    return hashlib.blake2b(data, digest_size=16, salt=before.to_bytes(8, "little")).digest()


def _find(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            segs: list[bytes] = []
            for text, did, dkey in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                if len(data) < length:
                    continue
                pos, sums = anchors(data, length), _sums(np.frombuffer(data, np.uint8))
                before, after = np.minimum(pos, length - ANCHOR), np.minimum(len(data) - pos, length)
                segs += [digest(data[p - x : p + y], x) for p, x, y in zip(pos.tolist(), before.tolist(), after.tolist(), strict=True)]
                for column, new in zip(numbers, (_grams(sums, pos, pos + ANCHOR).view(np.int64), np.full(len(pos), did), np.full(len(pos), dkey), pos, before, after), strict=True):
                    column.append(new)
            anchor, *rest = (np.concatenate(c) for c in numbers)
            columns = [pa.array(anchor), pa.array(segs, pa.binary()), *(pa.array(c.astype(np.int64 if i < 2 else np.int32)) for i, c in enumerate(rest))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ANCHORS.split(", ")])

    return docs.select("text", "did", "dkey").mapInArrow(run, ANCHORS)


def intervals(common: np.ndarray) -> list[tuple[int, int, int]]:
    """The common-prefix intervals (first, last, length) of sorted strings, by a scan with a stack.

    common[i]: the length of the prefix that strings i and i + 1 share; below 0 nothing stands above both.
    """
    out, stack = [], []
    for i, h in enumerate(common.tolist() + [-1]):
        first = i
        while stack and stack[-1][1] > h:
            first, deep = stack.pop()
            out.append((first, i, deep))
        if h >= 0 and (not stack or stack[-1][1] < h):
            stack.append((first, h))
    return out


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that rows of a and b share, at most most."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 8192):
        differs = a[at : at + 8192] != b[at : at + 8192]
        first = differs.argmax(1)
        out[at : at + 8192] = np.where(differs[np.arange(len(first)), first], first, a.shape[1])
    return np.minimum(out, most)


def _order(group: np.ndarray, strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix order in each group: bytes, then length."""
    rows = np.zeros((len(group), 8 + strings.shape[1]), np.uint8)
    rows[:, :8] = group.astype(">i8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = strings
    by_length = np.argsort(lengths, kind="stable")
    return by_length[np.argsort(rows[by_length].view(f"S{rows.shape[1]}").ravel(), kind="stable")]


def maximal(group: np.ndarray, behind: np.ndarray, n_behind: np.ndarray, ahead: np.ndarray, n_ahead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes before its anchor, bytes from it on) that repeats of at least length around anchors of equal group cover.

    ahead: the suffixes that start at the anchors, cut at length; behind: what stands before them, backwards. The suffixes
    are sorted, and a stack scan of their common prefixes gives the interval tree: each interval is a right-maximal string
    with all its occurrences. In each, the occurrences are put in the order of what stands before them; each then shares
    the longest extension to the left with a neighbour, and the extension ends where the bytes to the left differ. All
    repeats of a row hold its anchor, so what they cover is one run, which is given: a row at most. Rows are unequal
    within a group.
    """
    lefts, rights = np.full(len(group), -1, np.int64), np.full(len(group), -1, np.int64)
    rank = np.empty(len(group), np.int64)
    rank[_order(group, behind, n_behind)] = np.arange(len(group))
    order = _order(group, ahead, n_ahead)
    common = _shared(ahead[order[1:]], ahead[order[:-1]], np.minimum(n_ahead[order[1:]], n_ahead[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = -1
    tree = [x for x in intervals(common) if x[2] > 0]
    first, last, deep = np.array(tree, np.int64).reshape(-1, 3).T
    at, sizes = 0, last - first + 1
    while at < len(tree):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 40_000)) + at)
        node = np.repeat(np.arange(at, upto), sizes[at:upto])
        within = np.arange(len(node)) - np.repeat(np.cumsum(sizes[at:upto]) - sizes[at:upto], sizes[at:upto])
        row, depth = order[first[node] + within], deep[node]
        enough = n_behind[row] + depth >= length
        node, row, depth = node[enough], row[enough], depth[enough]
        by = np.lexsort((rank[row], node))
        node, row, depth = node[by], row[by], depth[by]
        left = _shared(behind[row[1:]], behind[row[:-1]], np.minimum(n_behind[row[1:]], n_behind[row[:-1]]))
        left[node[1:] != node[:-1]] = -1
        best = np.maximum(np.concatenate([[-1], left]), np.concatenate([left, [-1]])) if len(row) else np.zeros(0, np.int64)
        long = (best >= 0) & (best + depth >= length)
        np.maximum.at(lefts, row[long], best[long])
        np.maximum.at(rights, row[long], depth[long])
        at = upto
    found = np.flatnonzero(rights >= 0)
    return found, lefts[found], rights[found]


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, with the bytes around each anchor; each document's anchors are a list of its own."""
    kind = "anchor long, seg binary, pos int, before int, after int, crowded boolean, copies long"
    lists = wanted.groupBy("did", "dkey").agg(F.collect_list(F.struct(*[c.split()[0] for c in kind.split(", ")])).alias("of"))
    rows = docs.where(bitmap(wanted, "dkey", DOCUMENT_BITS)("dkey")).select("did", "dkey", "text").join(lists, ["did", "dkey"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, of in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                out += [(x["anchor"], x["seg"], x["before"], x["crowded"], x["copies"], data[x["pos"] - x["before"] : x["pos"] + x["after"]]) for x in of.as_py()]
                if len(out) > 4000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return rows.select("text", "of").mapInArrow(run, "anchor long, seg binary, before int, crowded boolean, copies long, bytes binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["anchor", "seg", "before", "crowded", "copies", "bytes"])


def _sorted_out(rows: DataFrame, length: int, block: int = 2048) -> DataFrame:
    """seg, lo, hi: the run around the anchor of strings that another surrounding of it holds as well."""

    def found(anchor: np.ndarray, seg: list[bytes], before: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        # a row that is repeated in the table comes once more
        once = np.array(sorted({(a, x): i for i, (a, x) in enumerate(zip(anchor.tolist(), seg, strict=True))}.values()), np.int64)
        anchor, before, seg, data = anchor[once], before[once], [seg[i] for i in once], [data[i] for i in once]
        n = np.array([len(x) for x in data], np.int64)
        flat, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum(n)
        at = ends - n + before
        ahead, behind = np.zeros((len(n), length), np.uint8), np.zeros((len(n), length - ANCHOR), np.uint8)
        steps = np.arange(length)
        n_ahead = n - before
        mask = steps[None, :] < n_ahead[:, None]
        ahead[mask] = flat[(at[:, None] + steps[None, :])[mask]]
        steps = np.arange(length - ANCHOR)
        mask = steps[None, :] < before[:, None]
        behind[mask] = flat[(at[:, None] - 1 - steps[None, :])[mask]]
        row, left, right = maximal(anchor, behind, before, ahead, n_ahead, length)
        return pa.RecordBatch.from_arrays([pa.array([seg[i] for i in row], pa.binary()), pa.array(-left), pa.array(right)], names=["seg", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for column, new in zip(held, batch.columns, strict=True):
                column += new.to_pylist()
            while len(held[0]) >= block:
                # whole groups only; the last may go on
                last = held[0][-1]
                upto = next((i for i in range(len(held[0]) - 1, -1, -1) if held[0][i] != last), -1) + 1
                if not upto:
                    break
                if upto > 2 * block:
                    cut = next((i for i in range(block, upto) if held[0][i] != held[0][i - 1]), upto)
                    upto = cut
                part, held = [c[:upto] for c in held], [c[upto:] for c in held]
                yield found(np.array(part[0], np.int64), part[1], np.array(part[2], np.int64), part[3])
        if held[0]:
            yield found(np.array(held[0], np.int64), held[1], np.array(held[2], np.int64), held[3])

    dealt = rows.repartition(partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "seg", F.col("before").cast("long").alias("before"), "bytes").mapInArrow(run, "seg binary, lo long, hi long")


def _counted_out(rows: DataFrame, length: int) -> DataFrame:
    """As _sorted_out, for anchors with too many surroundings for a task: their strings of length bytes are sorted by digest.

    Equal strings then stand together, and a task streams through them. One shuffle, of 48 bytes a string.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, before, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = np.arange(max(0, before + ANCHOR - length), min(before, len(data) - length) + 1)
                key = np.frombuffer(b"".join(digest(data[a : a + length], before - a) for a in starts.tolist()), np.int64)
                own = np.tile(np.frombuffer(seg, np.int64), len(starts))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[0::2], key[1::2], own[0::2], own[1::2], 2 * (starts - before) + (copies > 1))], names=["k1", "k2", "s1", "s2", "lo"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((5, 0), np.int64)
        for batch in batches:
            # the row before comes again, since it may be equal to this batch's first; a string told twice is one
            rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns])], 1)
            last = rows[:, -1:]
            same = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            hit = (rows[4] & 1).astype(bool)
            hit[1:] |= same
            hit[:-1] |= same
            _, s1, s2, lo = rows[1:, hit]
            lo >>= 1
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.stack([s1, s2], 1)], pa.binary()), pa.array(lo), pa.array(lo + length)], names=["seg", "lo", "hi"])

    kind = "k1 long, k2 long, s1 long, s2 long, lo long"
    each = rows.select("seg", F.col("before").cast("long").alias("before"), "copies", "bytes").mapInArrow(strings, kind)
    dealt = each.repartition(partitions(rows.sparkSession), "k1").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(repeated, "seg binary, lo long, hi long")


def _placed(places: DataFrame, found: DataFrame) -> DataFrame:
    """places, with the run around each; copies in found: places of a surrounding, null for one."""
    common = found.where(F.col("copies") > COMMON).drop("copies")
    if not common.limit(1).count():
        return places.join(found.drop("copies"), "seg")
    # one of COMMON places at most, so that their runs are few whatever the input
    rest = places.join(F.broadcast(common.select("seg")), "seg", "left_anti")
    return places.join(F.broadcast(common), "seg").unionByName(rest.join(found.drop("copies"), "seg"))


def occurrences(docs: DataFrame, length: int = 400, crowded: int = CROWDED) -> DataFrame:
    """did, dkey, start, end: for each anchor, the run that strings around it of at least length bytes cover which also
    start elsewhere; docs: from keyed().

    Every byte that such a string of exactly length bytes covers is in a run, and no other byte is. There is at most one
    row for each place of an anchor.
    """
    places = stored(_find(docs, length), "anchors")
    often = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    places = stored(places.where(bitmap(often, "anchor", ANCHOR_BITS)("anchor")), "anchors-often")
    first = F.min(F.struct("did", "dkey", "pos", "before", "after")).alias("at")
    distinct = places.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), first)
    per_anchor = distinct.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("segs")).where("total > 1")
    wanted = stored(distinct.join(per_anchor, "anchor").select("anchor", "seg", "copies", "segs", "at.*", (F.col("segs") > crowded).alias("crowded")), "surroundings")
    # a surrounding that occurs twice is repeated as a whole
    whole = wanted.where(f"copies > 1 and before + after >= {length}").select("seg", (-F.col("before")).cast("long").alias("lo"), F.col("after").cast("long").alias("hi"), "copies")
    around = _surroundings(docs, wanted.where(f"segs > 1 and before + after >= {length}"))
    if wanted.where("crowded").limit(1).count():
        around = stored(around.dropDuplicates(["anchor", "seg"]), "bytes-around")
        parts = _sorted_out(around.where("not crowded"), length).union(_counted_out(around.where("crowded"), length))
    else:
        parts = _sorted_out(around, length)
    # all strings of a surrounding hold its anchor, so that together they are one run; seg, a digest of its bytes, names it alone
    found = whole.unionByName(parts, allowMissingColumns=True).groupBy("seg").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("copies").alias("copies"))
    return _placed(places, stored(found, "runs")).select("did", "dkey", (F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end"))


def _kept(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def remove_repeats(df: DataFrame, length: int = 400, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, removed (the runs of removed bytes: start, end) and kept (the other bytes) for each row of df (doc_id, text).

    Each byte covered by a string of length bytes that also starts anywhere else, in this document or another, is removed;
    strings are judged on the input. Null texts count as empty; texts shorter than length lose nothing; equal rows lose
    all that lies in such strings. Rows with a null doc_id are documents too. Other columns are not read.
    Strings around an anchor are compared byte by byte; equal surroundings (up to 2 * length bytes around an anchor), and the
    strings of an anchor with more than `crowded` different surroundings, are recognised by 128-bit digests. The weaker
    sums that choose anchors decide nothing but where strings are compared.
    """
    docs = keyed(df)
    lists = stored(occurrences(docs, length, crowded).groupBy("did", "dkey").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    # documents that the bitmap shows to have no span need not meet the spans, nor Python
    some = docs.withColumn("some", bitmap(lists, "dkey", DOCUMENT_BITS)("dkey"))
    rows = some.where("some").join(lists, ["did", "dkey"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    clean = some.where("not some").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("removed"), F.col("text").cast("binary").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                runs = _kept([(x["start"], x["end"]) for x in spans or ()])
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return rows.mapInArrow(run, schema).union(clean)


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).alias("has_repeats"))
