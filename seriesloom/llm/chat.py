"""Operator 10: conversations assembled from tokens, with the mask of what a model is to learn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import partitions, piece_pattern, ranks, table, vocabulary

START, END = "<|im_start|>", "<|im_end|>"
#: The vocabulary ends at 50255; these ids are spliced in and never come from text.
RESERVED = {START: 50257, END: 50258}
FORMATTED = "conv_id long, turn_number int, first_token long, token_ids array<int>, loss_mask array<byte>"


def escape(text: str) -> str:
    """Every `<|` in a text gets a backslash between, and every `<` with backslashes before `|` one more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As texts; also backslashes and line ends, which end the role in the template."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Assembler:
    """Segments are encoded one by one and reserved ids put between; nothing merges across a border."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
        self.of_reserved = {v: k for k, v in RESERVED.items()}

    def turn(self, role: str, text: str) -> tuple[list[int], np.ndarray]:
        """Ids of one turn and their mask, which is the prefix sum of +1 where learning starts and -1 where it ends."""
        header = self.encoding.encode_ordinary(escape_role(role) + "\n")
        body = self.encoding.encode_ordinary(escape(text))
        tail = self.encoding.encode_ordinary("\n")
        ids = [RESERVED[START], *header, *body, RESERVED[END], *tail]
        steps = np.zeros(len(ids) + 1, np.int8)
        if role == "assistant":
            steps[1 + len(header)] += 1
            steps[1 + len(header) + len(body)] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def text(self, ids: list[int]) -> str:
        """The formatted string: reserved ids as their strings, runs of others decoded together."""
        return "".join("".join(self.of_reserved[i] for i in run) if reserved else self.encoding.decode_bytes(list(run)).decode() for reserved, run in groupby(ids, self.of_reserved.__contains__))


def format_conversations(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each turn, in order within a partition: its number, the tokens of its conversation before it, ids and mask.

    Rows of one conversation (conv_id; null is one as well) are ordered by turn, role and text, nulls first; equal rows
    are as many turns. A null role or text counts as empty; other columns are not read. A conversation stays in one
    partition, since positions and digests follow its turns, but is streamed: no task holds more than a batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assemble, current, number, tokens = Assembler(path, pattern), object(), 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, number, tokens = conv, 0, 0
                ids, mask = assemble.turn(role or "", text or "")
                rows.append((conv, number, tokens, ids, mask))
                number, tokens = number + 1, tokens + len(ids)
            ends = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
            flat = np.fromiter((i for r in rows for i in r[3]), np.int32, int(ends[-1]))
            masks = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.int8)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(ends), pa.array(masks)),
            ], names=["conv_id", "turn_number", "first_token", "token_ids", "loss_mask"])

    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = rows.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """From the formatted tokens alone: turns and learned text of each conversation, as digests.

    formatted: the rows of format_conversations, each conversation's together and in order.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assemble, state = Assembler(path, pattern), None
        for batch in batches:
            out = []
            for conv, number, first, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    if state:
                        out.append(_closed(state))
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0}
                if number != state["turns"] or first != state["tokens"] or conv != state["conv"]:
                    raise ValueError("the turns of a conversation must come together and in order")
                formatted_text = assemble.text(ids)
                role, text = formatted_text.removeprefix(START).removesuffix(END + "\n").split("\n", 1)
                state["all"].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                learned = unescape(assemble.text([i for i, m in zip(ids, mask, strict=True) if m]))
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(formatted_text)
                state["turns"] += 1
                state["tokens"] += len(ids)
            yield _rows(out, names)
        if state:
            yield _rows([_closed(state)], names)

    return formatted.mapInArrow(run, schema)


def _closed(s: dict) -> tuple:
    return s["conv"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"]


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), piece_pattern()
    return read_back(format_conversations(rows.union(probe), path, pattern), path, pattern).drop("n_tokens")
