"""Operator 8: language by interpolated Kneser-Ney character models."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.bpe import by_size
from seriesloom.llm.common import in_small_batches, returned, table
from seriesloom.llm.shingles import U, mixed

ORDER = 4
#: Labelled documents that the models are fitted and calibrated on, over all languages; whole texts are used.
SAMPLE = 4_000
#: Calibration texts of a language below which its limit is that of all languages together.
FEW = 20
UNKNOWN = "und"
SPACE, EDGE = 32, 1


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, what lies between as one space, and ORDER - 1 edges before each text; each symbol's text."""
    parts = [("\x01" * (ORDER - 1) + t.replace("\x01", " ").lower()).encode("utf-32-le", "replace") for t in texts]
    c = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in parts])
    c = np.where(letters()[c] | (c == EDGE), c, SPACE)
    kept = np.ones(len(c), bool)
    kept[1:] = (c[1:] != SPACE) | ((c[:-1] != SPACE) & (c[:-1] != EDGE))
    return c[kept], owner[kept]


def grams(c: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k symbols that end at each place (k - 1 places have none: 0)."""
    out = np.zeros(len(c), U)
    if len(c) >= k:
        h = np.full(len(c) - k + 1, k, U)
        for i in range(k):
            h = h * U(0x100000001B3) + c[i : len(c) - k + 1 + i].astype(U)
        out[k - 1 :] = mixed(h)
    return out


def of_rows(rows: np.ndarray, k: int, before: int = 0) -> np.ndarray:
    """As grams, for rows of ORDER symbols: the k symbols that end `before` symbols before the last."""
    out = np.full(len(rows), k, U)
    for i in range(ORDER - before - k, ORDER - before):
        out = out * U(0x100000001B3) + rows[:, i].astype(U)
    return mixed(out) if k else np.zeros(len(rows), U)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ORDER symbols of which the last is no edge, one a row, and how often each occurs."""
    c, _ = symbols(texts)
    real = np.flatnonzero(c != EDGE)
    _, first, counts = np.unique(grams(c, ORDER)[real], return_index=True, return_counts=True)
    return c[real[first][:, None] + np.arange(1 - ORDER, 1)], counts


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class KneserNey:
    """One language: for each order, sorted hashes of seen n-grams with log probabilities, and of contexts with log weights."""

    seen: list = field(default_factory=list)
    contexts: list = field(default_factory=list)

    @classmethod
    def fit(cls, rows: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
        """rows, counts: as from counted(); alphabet: the number of different symbols."""
        # types of each order: their symbols, and a count; below the highest, the count is of left neighbours
        by_order = {}
        for k in range(ORDER, 0, -1):
            keys, first, index = np.unique(of_rows(rows, k), return_index=True, return_inverse=True)
            counts = np.bincount(index, counts if k == ORDER else None, len(keys)).astype(np.int64)
            rows = rows[first]
            by_order[k] = (keys, rows, counts)
        model, below = cls(), None
        for k in range(1, ORDER + 1):
            keys, rows, counts = by_order[k]
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            names, index = np.unique(of_rows(rows, k - 1, 1), return_inverse=True)
            total, kinds = np.bincount(index, counts), np.bincount(index)
            weight = d * kinds / total
            lower = np.full(len(keys), 1.0 / (alphabet + 1)) if below is None else np.exp(below[1][find(below[0], of_rows(rows, k - 1))[0]])
            p = np.maximum(counts - d, 0) / total[index] + weight[index] * lower
            model.seen.append((keys, np.log(p)))
            model.contexts.append((names, np.log(weight)))
            below = model.seen[-1]
        model.unseen = float(model.contexts[0][1][0] - np.log(alphabet + 1)) if len(model.contexts[0][1]) else float(-np.log(alphabet + 1))
        return model

    def score(self, gram: dict[int, np.ndarray], context: dict[int, np.ndarray], k: int = ORDER) -> np.ndarray:
        """Log probabilities of the last symbols of n-grams given by their hashes (and their contexts') at each order."""
        if k == 0 or not len(gram[max(k, 1)]):
            return np.full(len(gram[1]), self.unseen)
        at, there = find(self.seen[k - 1][0], gram[k])
        out = np.empty(len(at))
        out[there] = self.seen[k - 1][1][at[there]]
        rest = np.flatnonzero(~there)
        if len(rest):
            if k == 1:
                out[rest] = self.unseen
            else:
                at, there = find(self.contexts[k - 1][0], context[k][rest])
                weight = np.where(there, self.contexts[k - 1][1][at], 0.0)
                out[rest] = weight + self.score({i: g[rest] for i, g in gram.items() if i < k}, {i: g[rest] for i, g in context.items() if i < k}, k - 1)
        return out


class Models:
    """All languages together: an n-gram that any language has seen is looked up once for all of them."""

    def __init__(self, types: dict[str, tuple[np.ndarray, np.ndarray]]):
        """types: of each language, what counted() gives."""
        self.languages = sorted(types)
        every = [np.zeros((0, ORDER), np.int64), *(types[x][0] for x in self.languages)]
        alphabet = len(np.unique(np.concatenate([r[:, -1] for r in every]))) or 1
        own = [KneserNey.fit(*types[x], alphabet) for x in self.languages]
        self.own = own
        # for every n-gram of the highest order seen anywhere: its probability in each language
        rows = np.concatenate(every)
        self.keys, first = np.unique(of_rows(rows, ORDER), return_index=True)
        rows = rows[first]
        gram, context = {k: of_rows(rows, k) for k in range(1, ORDER + 1)}, {k: of_rows(rows, k - 1, 1) for k in range(1, ORDER + 1)}
        self.table = np.stack([m.score(gram, context) for m in own], 1).astype(np.float32) if own else np.zeros((0, 0), np.float32)
        self.sharpness, self.limits = 1.0, np.full((len(own), 3), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its cross-entropy per symbol in each language, and its number of symbols."""
        c, owner = symbols(texts)
        top = grams(c, ORDER)
        real = c != EDGE
        at, there = find(self.keys, top)
        sums = np.zeros((len(texts), len(self.languages)))
        known = np.flatnonzero(there & real)
        for j in range(len(self.languages)):
            sums[:, j] = np.bincount(owner[known], self.table[at[known], j], len(texts))
        rest = np.flatnonzero(~there & real)
        if len(rest):
            gram = {k: grams(c, k)[rest] for k in range(1, ORDER + 1)}
            context = {k: grams(c, k - 1)[rest - 1] if k > 1 else np.zeros(len(rest), U) for k in range(1, ORDER + 1)}
            for j, m in enumerate(self.own):
                sums[:, j] += np.bincount(owner[rest], m.score(gram, context), len(texts))
        n = np.bincount(owner[real], minlength=len(texts))
        return -sums / np.maximum(n, 1)[:, None], n

    def calibrate(self, h: np.ndarray, n: np.ndarray, langs: list[str]) -> None:
        """Sharpness of the scores by likelihood, and for each language the cross-entropy that own texts hardly exceed.

        h, n, langs: entropies() of texts, and their languages. The limit is the texts' mean plus an allowance that
        shrinks with the square root of the length, plus what then still holds 99.9 % of them, plus a quarter of the
        mean. A language with few such texts has the limit of all languages' texts together.
        """
        truth = np.array([self.languages.index(x) if x in self.languages else -1 for x in langs], np.int64)
        ok = (truth >= 0) & (n > 0)
        h, n, truth = h[ok], n[ok], truth[ok]
        if not len(h):
            return

        def loss(s: float) -> float:
            z = -(h - h.min(1)[:, None]) * s
            return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean())

        def limit(own: np.ndarray, size: np.ndarray) -> tuple[float, float, float]:
            middle, spread = float(np.average(own, weights=size)), float(np.sqrt(np.mean((own - np.median(own)) ** 2 * np.minimum(size, 1000))))
            over = own - middle - 4 * spread / np.sqrt(size)
            return middle, 4 * spread, max(0.0, float(np.quantile(over, 0.999))) + 0.25 * middle

        self.sharpness = min((2.0**i for i in range(-2, 6)), key=loss)
        own = h[np.arange(len(h)), truth]
        for j in range(len(self.languages)):
            some = truth == j
            self.limits[j] = limit(own[some], n[some]) if some.sum() >= FEW else limit(own, n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per symbol, and whether it is beyond what the language's own texts have."""
        full = [t or "" for t in texts]
        has = np.array([any(map(str.isalpha, t)) for t in full], bool)
        if not self.languages or not full:
            return [UNKNOWN] * len(full), np.zeros(len(full)), np.zeros(len(full)), np.ones(len(full), bool)
        h, n = self.entropies(full)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        p = 1 / np.exp(-(h - least[:, None]) * self.sharpness).sum(1)
        middle, spread, over = self.limits[best].T
        beyond = ~has | (least > middle + np.where(np.isfinite(spread), spread, 0) / np.sqrt(np.maximum(n, 1)) + over)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, p, 0.0), np.where(has, least, 0.0), beyond


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """What counted() gives of the texts (t) of each language (l), added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, texts = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
            for one in np.unique(lang.astype(str)):
                own = texts[lang == one].tolist()
                for a, b in by_size(own, 300_000):
                    found, counts = counted(own[a:b])
                    flat = found.astype("<u4").tobytes().decode("utf-32-le")
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(counts), pa.string()), pa.array([flat[i : i + ORDER] for i in range(0, len(flat), ORDER)], pa.string()), pa.array(counts.astype(np.int64))], names=["l", "gram", "n"])

    sums = rows.select("l", "t").mapInArrow(run, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    out = {}
    for lang, own in sums.toPandas().groupby("l"):
        own = own.sort_values("gram")
        out[str(lang)] = np.frombuffer("".join(own["gram"]).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, ORDER), own["n"].to_numpy()
    return out


def fit(df: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Models:
    """Models of the languages of df's labelled rows that are not held out (crc32 of the key as text, modulo 4, is 2).

    About `sample` rows, as many of each language as there are or as its even part, are chosen by a hash of their keys,
    and of each language the first by that hash in any case; three of four fit the models, the fourth calibrates scores
    and rejection. Whole texts are read and counted on the executors; the driver gets the counts of different n-grams,
    and a row of numbers for each text that calibrates.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.withColumn("o", F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)))
    counts = {r["l"]: (r["n"], r["first"]) for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.min("o").alias("first")).collect()}
    if not counts:
        return Models({})
    even = max(1, sample // len(counts))
    upto = F.create_map(*[x for name, (n, first) in counts.items() for x in (F.lit(name), F.lit(max(first, int(min(1.0, even / n) * (1 << 30)))))])
    firsts = F.create_map(*[x for name, (_, first) in counts.items() for x in (F.lit(name), F.lit(first))])
    chosen = rows.where(F.col("o") <= F.element_at(upto, F.col("l"))).withColumn("c", (F.pmod(F.xxhash64("k", F.lit(12)), F.lit(4)) == 0) & (F.col("o") != F.element_at(firsts, F.col("l"))))
    models = Models(_counts(chosen.where("not c")))

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_size(texts, 300_000):
                h, n = models.entropies(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(list(h))], names=["l", "n", "h"])

    own = chosen.where("c").select("l", "t").mapInArrow(entropies, "l string, n long, h array<double>").toPandas()
    if len(own):
        models.calibrate(np.stack(own["h"].tolist()), own["n"].to_numpy(), own["l"].tolist())
    return models


def identify(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1), cross_entropy (nats a symbol) and rejected.

    Each whole text gets the language in which its letters and word borders have the lowest cross-entropy; nothing but the
    text is used. A text that is null or has no letter is `und` with score 0 and rejected; any other text is rejected
    when its cross-entropy is beyond the calibrated limit of its language. Other columns and repeated rows stay; columns of
    these names are replaced. No shuffle.
    """
    new = T.StructType.fromDDL("lang_pred string, score double, cross_entropy double, rejected boolean")
    kept = [f for f in df.schema.fields if f.name not in new.names]
    names = [f.name for f in kept]
    schema = T.StructType(kept + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in by_size([t or "" for t in texts], 300_000):
                lang, score, h, beyond = models.predict(texts[a:b])
                own = [batch.column(batch.schema.get_field_index(n)).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(beyond)], names=names + new.names)
        returned()

    in_small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
