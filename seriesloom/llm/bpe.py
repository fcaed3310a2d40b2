"""Operator 6: byte-level BPE, encoded and decoded by DuckDB queries inside each partition."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import in_small_batches, piece_pattern, ranks, returned, table, vocabulary
from seriesloom.llm.pieces import Splitter

#: A row of a piece holds word << 36 | position << 16 | token; a candidate pair holds rank << 40 | position << 20 | next
#: position. A word without a candidate passes on its rows once more, as done.
LONGEST_PIECE = 256
#: Rows that one recursive query may make, at most: half the square of each piece's length.
MOST_ROWS = 600_000

CONTRACT = """
WITH RECURSIVE state(cell, done) AS (
  SELECT (word::BIGINT << 36) | cell, false FROM cells
  UNION ALL (
    WITH neighbours AS (
      SELECT cell, lead(cell) OVER (ORDER BY cell) AS next FROM state WHERE NOT done),
    candidates AS (
      SELECT cell, (m.rank::BIGINT << 40) | (((cell >> 16) & 1048575) << 20) | ((next >> 16) & 1048575) AS pair
      FROM neighbours LEFT JOIN merges m
        ON m.both = CASE WHEN cell >> 36 = next >> 36 THEN ((cell & 65535) << 16) + (next & 65535) END),
    best AS (
      SELECT cell >> 36 AS word, min(pair) AS pair FROM candidates GROUP BY ALL)
    SELECT CASE WHEN c.pair = b.pair THEN (cell >> 16 << 16) | (b.pair >> 40) ELSE cell END, b.pair IS NULL
    FROM candidates c JOIN best b ON c.cell >> 36 = b.word
    WHERE b.pair IS NULL OR ((cell >> 16) & 1048575) <> (b.pair & 1048575)))
SELECT cell >> 36 AS word, list((cell & 65535)::INTEGER ORDER BY cell) AS ids
FROM state WHERE done GROUP BY ALL ORDER BY word
"""

#: The query runs on one thread, so that strings are joined in the order of the rows below.
DECODE = """
SELECT doc, string_agg(hex, '') AS hex
FROM (SELECT doc, hex FROM rows JOIN tokens USING (token) ORDER BY place) GROUP BY doc
"""


class DuckBpe:
    """Encoder and decoder over one DuckDB connection of one thread.

    A piece that is itself a token is that token. Any other piece up to LONGEST_PIECE bytes is contracted by the
    recursive query. Longer pieces, whose number of intermediate rows would grow with the square of their length,
    take the same contractions from a heap. So many pieces are contracted at once that the rows of all steps stay below
    MOST_ROWS; nothing is written to disk.
    """

    def __init__(self, path: str, pattern: str, memory: str = "350MB", bound: int = 120_000):
        import duckdb

        self.ranks, self.split = ranks(path), Splitter(pattern)
        self.bytes_of = np.full(256, -1, np.int64)
        for b in range(256):
            self.bytes_of[b] = self.ranks.get(bytes([b]), -1)
        if (self.bytes_of < 0).any() or max(self.ranks.values()) > 65535:
            raise ValueError("a byte-level vocabulary of at most 65,536 ids is needed")
        both, rank = array("q"), array("i")
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None:
                    both.append((a << 16) + b)
                    rank.append(r)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self._load("merges", pa.table({"both": np.frombuffer(both, np.int64), "rank": np.frombuffer(rank, np.int32)}))
        self._load("tokens", pa.table({"token": np.array(list(self.ranks.values()), np.int32), "hex": [t.hex() for t in self.ranks]}))
        self.known, self.older, self.bound = {}, {}, bound

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("arrow_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, 4 bytes each."""
        out: list = [None] * len(pieces)
        todo, raw = [], []
        for i, piece in enumerate(pieces):
            data = piece.encode()
            if (r := self.ranks.get(data)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(data) > LONGEST_PIECE:
                out[i] = self._heap(data)
            else:
                todo.append(i)
                raw.append(data)
        rows = np.cumsum([len(x) * (len(x) + 1) // 2 for x in raw])
        at = 0
        while at < len(raw):
            upto = max(at + 1, int(np.searchsorted(rows, MOST_ROWS + (rows[at - 1] if at else 0), side="right")))
            for i, ids in zip(todo[at:upto], self._contract(raw[at:upto]), strict=True):
                out[i] = ids
            at = upto
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("cells", pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "cell": (place << 16) | self.bytes_of[data]}))
        ids = self.db.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("cells")
        values, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
        ends = 4 * (ends - ends[0])
        return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _heap(self, data: bytes) -> bytes:
        ids, n = self.bytes_of[np.frombuffer(data, np.uint8)].tolist(), len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.ranks.get(self.token[ids[i]] + self.token[ids[j]])
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := rank(x, y)) is not None:
                    heapq.heappush(queue, (m, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Pieces are encoded once for as long as they are kept: beyond bound pieces those not seen
        since the last time that there were so many are let go."""
        if len(self.known) > self.bound:
            self.known, self.older = {}, self.known
        pieces = [self.split(t) for t in texts]
        missing = set().union(*pieces).difference(self.known)
        self.known.update((p, self.older[p]) for p in missing.intersection(self.older))
        new = list(missing.difference(self.older))
        self.known.update(zip(new, self.encode_pieces(new), strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), "<u4") for own in pieces]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        lengths = np.array([len(x) for x in ids])
        if not lengths.sum():
            return [b""] * len(ids)
        self.db.register("rows", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "place": np.arange(lengths.sum(), dtype=np.int32), "token": np.concatenate(ids).astype(np.int32)}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("rows")
        back = dict(zip(got.column("doc").to_pylist(), got.column("hex").to_pylist(), strict=True))
        return [bytes.fromhex(back.get(i, "")) for i in range(len(ids))]


def by_size(texts: list[str], bound: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Slices of the list that hold about bound characters each; a longer text makes a slice of its own."""
    return _slices(map(len, texts), bound)


def _slices(sizes: Iterable[int], bound: int) -> Iterator[tuple[int, int]]:
    at, upto, held = 0, 0, 0
    for size in sizes:
        upto, held = upto + 1, held + size
        if held >= bound:
            yield at, upto
            at, held = upto, 0
    if at < upto:
        yield at, upto


def slices(batches: Iterable[pa.RecordBatch], text: str, bound: int = 400_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches that hold about bound bytes of text each, and their texts, null ones as empty: no more is
    in Python at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for a, b in _slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), bound):
            yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded") -> DataFrame:
    """df with the token ids of its text column, and the bytes decoded from them.

    Every whole text is split by pattern, and each match is encoded alone by the ranks in path; there are no special
    tokens. A null text counts as empty: no ids, no bytes. Repeated rows and any other columns (nulls as well) are
    passed on as they are; if df has a column of the name of an output, the output replaces it. No shuffle.
    """
    from pyspark.sql import types as T

    outputs = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])]
    kept = [f for f in df.schema.fields if f.name not in {o.name for o in outputs}]
    schema = T.StructType(kept + outputs)
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for rows, texts in slices(batches, text):
            bpe = bpe or DuckBpe(path, pattern)
            got = bpe.encode(texts)
            lengths = np.cumsum([0, *map(len, got)]).astype(np.int32)
            columns = [rows.column(rows.schema.get_field_index(n)) for n in names]
            columns.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(got).astype(np.int32) if got else [], pa.int32())))
            if decoded:
                columns.append(pa.array(bpe.decode(got), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        bpe = None
        returned()

    in_small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in names or c == text]).mapInArrow(run, schema)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, vocabulary("byte_bpe_50k.tiktoken"), piece_pattern()))


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from ids and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("token_ids"))
            values, ends = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            decoded = batch.column(batch.schema.get_field_index("decoded"))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "token_ids", "decoded").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
