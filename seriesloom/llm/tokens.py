"""Operator 1: token ids as Parquet list columns that can be read selectively."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.bpe import by_size
from seriesloom.llm.common import partitions, piece_pattern, scratch, table, vocabulary
from seriesloom.llm.pieces import Splitter

SCHEMA = "part int, local_start long, doc_id long, n_tokens long, token_ids array<int>"


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of pieces, encoded when first asked for."""

    def __init__(self, tokenize):
        self.tokenize, self.letters = tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return found


class LibraryEncoder:
    """Ids from the tokenizers library, 4 bytes each. Each distinct piece is encoded once for a while.

    Texts beyond the letters for which the splitting pattern is settled are given to the library whole. The strings of
    special tokens are ordinary text.
    """

    def __init__(self, path: str, pattern: str, bound: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split, self.bound = Splitter(pattern), bound
        # a model of its own, whose inner cache would only hold what is held here
        model = Tokenizer.from_file(path).model
        model._resize_cache(0)
        self.known = _Known(model.tokenize)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.bound:
            self.known.clear()
        out, whole, get = [b""] * len(texts), [], self.known.__getitem__
        for i, t in enumerate(texts):
            if self.split.unsettled(t):
                whole.append(i)
            else:
                out[i] = b"".join(map(get, self.split.fast(t)))
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def write(df: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0, files: int | None = None, row_group_mb: int = 16, page_kb: int = 64) -> None:
    """Encodes the text of every row and writes the ids under path, in ascending order of doc_id through the files.

    The files have the columns of SCHEMA: part, the number of the file in that order; local_start, the ids before the
    document in its part; doc_id; n_tokens, with end_id that follows each document; token_ids. Ids are dictionary-coded
    and small row groups and pages carry indexes, so that a reader can take metadata without ids, or few documents'
    ids. A null text counts as empty and gives end_id alone; rows with a null doc_id come first; rows of equal doc_id
    stay separate, ordered by text; other columns are not read. An empty table gives files without rows. One shuffle,
    of the texts; files are committed by Spark, so a lost executor leaves no part behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = None, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoder = encoder or LibraryEncoder(tokenizer, pattern)
            for a, b in by_size(texts):
                got = encoder.encode(texts[a:b])
                n = np.array([len(x) // 4 + 1 for x in got], np.int64)
                ends = np.cumsum(n)
                ids = np.frombuffer(b"".join([y for x in got for y in (x, end)]), "<i4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(b - a, part, np.int32)), pa.array(start + ends - n), batch.column(0).slice(a, b - a), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)),
                ], names=["part", "local_start", "doc_id", "n_tokens", "token_ids"])
                start += int(ends[-1])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(files or max(1, partitions(df.sparkSession) // 2), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.page.row.count.limit": 2000,
        "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "parquet.writer.version": "v2",
    }
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: F.Column | None = None) -> DataFrame:
    """Documents from files that write() made, with start: the ids of all documents before them.

    columns: those of SCHEMA and start that are wanted; without token_ids, their pages are not read. where: a condition on metadata,
    which reaches the page indexes.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = files.where(where) if where is not None else files
    bases = bases.select("part", "base")
    # a row for each file
    out = rows.join(F.broadcast(bases) if bases.count() <= 100_000 else bases, "part").withColumn("start", F.col("base") + F.col("local_start"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "token_ids"]))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            crc = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), piece_pattern())
    return checksums(read(spark, path))
