"""Bitmaps of fixed size that keep most of the rows back which a join would drop anyway."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shingles import U, mixed

PART = 16


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(U)) >> U(64 - bits)).astype(np.int64)


def bitmap_of(df: DataFrame, key: str, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test that every key of df passes, and of other keys the fewer, the more bits there are: 2**bits, whatever the input.

    Parts of it are made on the executors; what reaches the driver and goes back has a fixed size.
    """
    slot = F.pandas_udf(lambda k: pd.Series(_slots(k.to_numpy(np.int64), bits)), "long")

    def part(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << PART, bool)
        out[pdf["slot"].to_numpy() & ((1 << PART) - 1)] = True
        return pd.DataFrame({"part": [keys[0]], "bits": [np.packbits(out).tobytes()]})

    slots = df.select(slot(F.col(key)).alias("slot")).distinct()
    found = {r["part"]: r["bits"] for r in slots.groupBy(F.shiftright("slot", PART).alias("part")).applyInPandas(part, "part long, bits binary").collect()}
    empty = bytes(1 << (PART - 3))
    packed = b"".join(found.get(i, empty) for i in range(1 << (bits - PART)))

    def passes(k: np.ndarray) -> np.ndarray:
        at = _slots(k, bits)
        return (np.frombuffer(packed, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return passes


def bitmap(df: DataFrame, key: str, bits: int) -> Callable[[str], Column]:
    """bitmap_of as a filter of a column."""
    passes = bitmap_of(df, key, bits)
    test = F.pandas_udf(lambda k: pd.Series(passes(k.to_numpy(np.int64))), "boolean")
    return lambda name: test(F.col(name))
