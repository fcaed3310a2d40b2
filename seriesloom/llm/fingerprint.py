"""Operator 2: quartile bucket digests of documents, and a bounded difference between them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import partitions, table

BUCKETS = 256
#: Offsets of the second and third byte of each triplet in a window of five.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Mean body difference of independent digests: 0, 1, 2, 6 with chances 4, 6, 4, 2 of 16.
CHANCE = BUCKETS * 26 / 16
_MIX = np.random.default_rng(20240229).permutation(256).astype(np.uint8)


def digest(data: bytes) -> str:
    """Length code, quartile ratios and two bits for each bucket, in hex; equal data have equal digests.

    Every triplet of bytes within five is hashed to a bucket. The quartiles of the bucket counts cut them into four
    classes. Data under three bytes have no triplet: all buckets then are in the lowest class, and the digest ends in
    the data's own hash, so that different short texts still differ.
    """
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        if len(b) > j:
            h = _MIX[b[: len(b) - j] ^ _MIX[k + 1]]
            h = _MIX[h ^ b[i : len(b) - j + i]]
            h = _MIX[h ^ b[j:]]
            counts += np.bincount(h, minlength=BUCKETS)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = min(255, round(8 * np.log2(len(b) + 1)))
    ratios = [q * 15 // q3 if q3 else 0 for q in (q1, q2)]
    packed = (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).astype(np.uint8)
    tail = hashlib.sha256(data).hexdigest()[:16] if len(b) < 3 else ""
    return f"{size:02x}{ratios[0]:x}{ratios[1]:x}" + packed.tobytes().hex() + tail


def _codes(fingerprint: str) -> np.ndarray:
    p = np.frombuffer(bytes.fromhex(fingerprint[4 : 4 + BUCKETS // 2]), np.uint8)
    return np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], 1).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 for equal digests. Opposite classes of a bucket count 6, others their distance; a length apart by more than a
    twelfth of a doubling counts its distance in eighths, at most 96; each quartile ratio counts its distance."""
    if a == b:
        return 0
    apart = np.abs(_codes(a) - _codes(b))
    body = int(apart.sum()) + 3 * int((apart == 3).sum())
    size = abs(int(a[:2], 16) - int(b[:2], 16))
    ratios = sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3))
    short = 8 * (a[4 + BUCKETS // 2 :] != b[4 + BUCKETS // 2 :])
    return body + (min(size, 96) if size > 1 else 0) + ratios + short


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those that differ as much as independent ones or more."""
    return max(0.0, 1.0 - difference(a, b) / CHANCE)


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the digest of each whole text; null counts as empty. Other columns and repeated rows stay; an old column
    of that name is replaced. No shuffle."""
    run = F.pandas_udf(lambda s: s.map(lambda t: digest((t or "").encode())), "string")
    return df.withColumn(name, run(F.col(text)))


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text in partitions of descending order, in which the row after each row is its next, the last one's being the first of all.

    Rows marked __after stand behind a partition's own rows: copies of the first rows of the partition that follows. For
    this the highest key of each partition, one for each, is read at the driver. Nulls come last; equal keys are ordered
    by text.
    """
    n = partitions(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias(key), text)
    tops = rows.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("top")).orderBy("p").collect()
    bounds = np.array([r["top"] for r in tops if r["top"] is not None], np.int64)
    m = max(1, len(bounds))
    below = F.pandas_udf(lambda k: pd.Series(np.where(k.isna(), 0, np.searchsorted(bounds[:-1], k.fillna(0).to_numpy(np.int64))).astype(np.int32)), "int")
    is_top = F.pandas_udf(lambda k: pd.Series(k.isna() if not len(bounds) else k.isin(bounds)), "boolean")
    home = rows.withColumn("__at", below(key)).withColumn("__after", F.lit(False))
    ahead = rows.where(is_top(key)).withColumn("__at", ((below(key) + 1) % m).cast("int")).withColumn("__after", F.lit(True))
    return home.union(ahead).repartitionById(m, F.col("__at")).drop("__at").sortWithinPartitions(F.col("__after"), F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())


def edits(df: DataFrame) -> DataFrame:
    """For each row of doc_id and text: the digest, that of the text whose last third is replaced by the start of the
    next text (in descending order of doc_id; the first follows the last), and both likenesses.

    Null texts count as empty, whose edited text is empty; a lone row is its own next; equal doc_ids are ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over, out = None, False, []
        for batch in batches:
            for key, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if over:
                    break
                row = (key, text or "", digest((text or "").encode()))
                if held:
                    out.append(_edited(held, row))
                held, over = row, after
            yield _batch(out)
            out = []

    return neighbours(df).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edited(row: tuple, following: tuple) -> tuple:
    key, text, own = row
    third = len(text) // 3
    data = (text[: len(text) - third] + following[1][:third]).encode()
    changed = own if data == text.encode() else digest(data)
    return key, len(text), hashlib.sha256(data).hexdigest(), own, changed, likeness(own, changed), likeness(own, following[2])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op2_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
