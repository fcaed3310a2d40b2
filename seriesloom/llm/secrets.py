"""Operator 7: secrets by their patterns, and strings that pass a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A run of the letters in which keys are written, long enough for the tests to have power.
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Of the strings reported as random, at most this share is to be natural, by estimate.
RATE = 0.05
#: Steps of the logarithm of a p-value in the table from which thresholds are set, and its last step.
STEP, STEPS = 0.25, 160
#: Lengths are told apart in classes of doubling: 24 to 47, 48 to 95, 96 to 191, 192 and more.
LEAST, CLASSES = 24, 4
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, when: Column, group: int = 0, least: int = 0) -> Column:
    """The leftmost matches that do not overlap, of which the group is at least so long: what stands between the matches and they, end to end."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = F.zip_with(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, v: F.struct(F.length(m).alias("long"), v.alias("v")))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.coalesce(m["long"], F.lit(0)).alias("long"), m["v"].alias("v")))
    none = F.array().cast(SPAN)

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["long"]).alias("end"), x["v"].alias("value"))).cast(SPAN)
        found = F.when(F.length(x["v"]) >= least, F.concat(s["found"], span)).otherwise(s["found"])
        return F.struct((start + x["long"]).alias("at"), found.alias("found"))

    return F.when(when, F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"]).otherwise(none)


def _upper(z: Column) -> Column:
    """The upper tail of the normal distribution, by a rational approximation good to 1e-7."""

    def tail(a: Column) -> Column:
        return let(1 / (1 + 0.2316419 * a), lambda t: F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))

    return let(F.abs(z), lambda a: F.when(z >= 0, tail(a)).otherwise(1 - tail(a)))


def _upper_chi2(x: Column, df: Column) -> Column:
    """The chance that chi-squared with df degrees exceeds x, by the cube root of Wilson and Hilferty."""
    return _upper((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


ALPHABETS = (DIGITS + LOWER[:6], UPPER + DIGITS[2:8], UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/")
#: Names of the parts of an alphabet, and how many there are at least and at most for strings of LEAST letters and more.
PARTS, FEWEST, MOST = DIGITS + LOWER[:6], 4, 16


def _halves(k: int) -> str:
    """For each place of an alphabet of k letters, whether it is above the middle."""
    return "".join("1" if d >= k / 2 else "0" for d in range(k))


def _part(k: int, parts: int) -> str:
    """For each place of an alphabet of k letters, its part."""
    return "".join(PARTS[math.floor(d * parts / k)] for d in range(k))


def _shares(k: int, parts: int) -> list[float]:
    return [(math.ceil((i + 1) * k / parts) - math.ceil(i * k / parts)) / k for i in range(parts)]


def _of(table: list) -> Column:
    """A list, or list of lists, of constants."""

    def text(x) -> str:
        return f"array({', '.join(map(text, x))})" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else f"{x!r}D"

    return F.expr(text(table))


def _encoded(value: Column) -> Column:
    """The smallest alphabet that holds the string: its index, the string as it is written in it, its length."""
    hexa = value.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    index = F.when(hexa, F.lit(0)).when(value.rlike("^[A-Z2-7]+$"), F.lit(1)).when(value.rlike("^[A-Za-z0-9]+$"), F.lit(2)).when(value.rlike("[_-]"), F.lit(3)).otherwise(F.lit(4))
    return let(index, lambda i: F.struct(i.alias("i"), F.when(i == 0, F.lower(value)).otherwise(value).alias("v"), F.length(value).alias("n")))


def _count(text: Column, what: Column) -> Column:
    """How often a string stands in the text."""
    return (F.length(text) - F.length(F.replace(text, what, F.lit("")))) / F.length(what)


def randomness(value: Column) -> Column:
    """p: how likely a random string of that length and encoding looks as uneven as this one, of at least LEAST letters.

    The encoding is the smallest that holds the string: hex digits, base 32, letters and digits, base 64. Three tests: chi-squared of an even use of the alphabet, cut into as many equal parts as the length
    supports; Wald-Wolfowitz runs above and below the alphabet's middle; correlation of neighbours. The least p of the
    three is made one of all, as if they were independent. A letter outside the alphabet (of + and / beside - and _) counts as its first.
    """
    sizes = [len(a) for a in ALPHABETS]

    def rewritten(e: Column, index: int, names: str) -> Column:
        more = "+/" if index == 3 else ""
        return F.translate(e["v"], ALPHABETS[index] + more, names + names[0] * len(more))

    def chi2(e: Column) -> Column:
        def of(parts: Column) -> Column:
            # one expression for each alphabet and number of parts, so that what it maps is made once; the most frequent first
            kinds = sorted(((i, p) for i in range(len(sizes)) for p in range(FEWEST, MOST + 1)), key=lambda x: (x[0] != 2, -x[1]))
            at, cells = 100 * e["i"] + parts, F
            for i, p in kinds:
                cells = cells.when(at == 100 * i + p, rewritten(e, i, _part(sizes[i], p)))
            due = _of([[1 / x for i, p in kinds if (i, p) == (j, q) for x in _shares(sizes[i], p)] for j in range(len(sizes)) for q in range(FEWEST, MOST + 1)])
            names, n = _of(list(PARTS)), e["n"].cast("double")
            squares = lambda c: F.zip_with(F.slice(names, F.lit(1), parts), F.get(due, e["i"] * (MOST - FEWEST + 1) + parts - FEWEST), lambda k, w: let(e["n"] - F.length(F.replace(c, k, F.lit(""))), lambda m: m * m * w))
            total = let(cells, lambda c: F.aggregate(squares(c), F.lit(0.0), lambda s, x: s + x)) / n - n
            return _upper_chi2(F.greatest(total, F.lit(0.0)), parts.cast("double") - 1)

        return let(F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.floor(e["n"] / 5).cast("int"))), of)

    def runs(e: Column) -> Column:
        n = e["n"].cast("double")

        def of(above: Column) -> Column:
            def z(ones: Column, changes: Column) -> Column:
                expected = 2 * ones * (n - ones) / n + 1
                spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
                return F.when((ones == 0) | (ones == n), F.lit(40.0)).otherwise(F.abs(changes - expected) / spread)

            return 2 * _upper(let(_count(above, F.lit("1")), lambda ones: z(ones, 1 + _count(above, F.lit("01")) + _count(above, F.lit("10")))))

        above = F.when(e["i"] == 2, rewritten(e, 2, _halves(sizes[2])))
        for i in (0, 1, 3, 4):
            above = above.when(e["i"] == i, rewritten(e, i, _halves(sizes[i])))
        return let(above, of)

    def serial(e: Column) -> Column:
        n = e["n"].cast("double")
        places = _of([[float(max(a.find(chr(c)), 0)) for c in range(128)] for a in ALPHABETS])
        sum_of = lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x)

        def of(c: Column) -> Column:
            var = F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
            lag = sum_of(F.zip_with(F.slice(c, 1, e["n"] - 1), F.slice(c, 2, e["n"] - 1), lambda x, y: x * y))
            return 2 * _upper(F.abs(F.coalesce(F.try_divide(lag, var), F.lit(1.0)) + 1 / n) * F.sqrt(n))

        letters = F.slice(F.split(e["v"], ""), F.lit(1), e["n"])
        d = let(F.get(places, e["i"]), lambda t: F.transform(letters, lambda c: F.get(t, F.ascii(c))))
        return let(d, lambda d: let(sum_of(d) / n, lambda m: let(F.transform(d, lambda x: x - m), of)))

    # what is surely least is not looked at further
    none = math.exp(-STEP * STEPS) / 4
    least = let(_encoded(value), lambda e: let(chi2(e), lambda p: F.when(p < none, p).otherwise(F.least(p, runs(e), serial(e)))))
    return F.greatest(let(F.least(F.greatest(least, F.lit(0.0)), F.lit(1.0)), lambda p: p * (3 - 3 * p + p * p)), F.lit(math.exp(-STEP * STEPS)))


def _length_class(value: Column) -> Column:
    return F.least(F.floor(F.log2(F.length(value) / float(LEAST))).cast("int"), F.lit(CLASSES - 1))


def _step(p: Column) -> Column:
    return F.least(F.floor(-F.log(p) / STEP), F.lit(STEPS)).cast("int")


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and kind."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(_spans(t, ASSIGN, 0, t.rlike(ASSIGN), 2, 12), _spans(t, ACCESS, 1, t.contains("AKIA")), _spans(t, HEX, 2, t.rlike(HEX)))
    return F.array_sort(found)


def _with_candidates(df: DataFrame, text: str) -> DataFrame:
    """df with __base, the spans of patterns, and __more: other candidates with their class and step of p."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("__base", base_spans(F.col(text)))
    free = F.filter(_spans(t, CANDIDATE, 3, t.rlike(CANDIDATE)), lambda c: ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("__free", free)
    return rows.withColumn("__more", F.transform("__free", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value"), _length_class(c["value"]).alias("class"), _step(randomness(c["value"])).alias("step")))).drop("__free")


def natural(text: Column) -> Column:
    """Class and step of strings that are no keys: the letters of the text, without candidates and what stands between words,
    cut end to end into strings of the least lengths of the classes in turn; of what is left at the end the longest that
    fit. Each letter is in one string, but for fewer at the end than the shortest has."""
    letters = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CANDIDATE, " "), "[^A-Za-z0-9+/_-]+", "")
    sizes = [LEAST << c for c in range(CLASSES)]
    cycle = sum(sizes)

    def cut(t: Column) -> Column:
        whole = F.array(*[F.substring(t, 1 + sum(sizes[:c]), k) for c, k in enumerate(sizes)])
        return F.when(F.length(t) == cycle, whole).otherwise(F.regexp_extract_all(t, F.lit("|".join(f".{{{k}}}" for k in sizes[::-1])), F.lit(0)))

    strings = F.flatten(F.transform(F.regexp_extract_all(letters, F.lit(f".{{1,{cycle}}}"), F.lit(0)), cut))
    return F.transform(strings, lambda v: F.struct(_length_class(v).alias("class"), _step(randomness(v)).alias("step")))


def thresholds(counts: DataFrame) -> DataFrame:
    """length class and the last step of p (lower p, higher step) that is reported; counts: class, step, natural, n.

    The hypothesis is that a candidate is natural: its p is the share of natural strings of its class, of the class's least
    length, that look as random or more. The rule of Benjamini and Hochberg at RATE over the candidates of a class then
    bounds the share of natural ones among those reported; classes have rules of their own, since longer strings are
    told apart more surely. Without natural strings to compare with nothing is reported. Steps make the table's size fixed.
    """
    w = Window.partitionBy("class")
    upto = w.orderBy("step")
    n, k = (F.sum(F.when(F.col("natural") == is_natural, F.col("n")).otherwise(0)) for is_natural in (False, True))
    both = counts.groupBy("class", "step").agg(n.alias("n"), k.alias("k"))
    p = (1 + F.sum("k").over(upto)) / (1 + F.sum("k").over(w))
    ranked = both.withColumn("found", p <= RATE * F.try_divide(F.sum("n").over(upto), F.sum("n").over(w)))
    return ranked.groupBy("class").agg(F.coalesce(F.max(F.when(F.col("found"), F.col("step"))), F.lit(-1)).alias("last"))


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base and spans: arrays of (start, kind, end, value), in code points, end exclusive, by start and kind.

    base: assign (a named value of 12 letters or more), access (AKIA and 14 or more), hex (16 or more), the leftmost
    matches of each without overlap. spans: these and random ones: runs of 24 letters of base 64 or more that overlap no
    base span and look random, as randomness() and the thresholds() say. kind is an index of KINDS. A null text counts as
    empty and has no span; very long texts are searched whole; other columns and repeated rows stay; columns of these
    names are replaced; an empty table gives none. Expressions only; the texts are read twice and not shuffled; the driver
    reads a threshold for each class of lengths.
    """
    rows = _with_candidates(df.drop("base", "spans"), text)
    seen = rows.select(F.explode(F.concat(F.transform("__more", lambda c: F.struct(c["class"].alias("class"), c["step"].alias("step"), F.lit(False).alias("natural"))), F.transform(natural(F.col(text)), lambda c: F.struct(c["class"].alias("class"), c["step"].alias("step"), F.lit(True).alias("natural"))))).alias("c")).groupBy("c.class", "c.step", "c.natural").agg(F.count("*").alias("n"))
    last = {r["class"]: r["last"] for r in thresholds(seen).collect()}
    limit = F.create_map(*[x for c, s in sorted(last.items()) for x in (F.lit(c), F.lit(s))]) if last else F.create_map(F.lit(0), F.lit(-1))
    random = F.transform(F.filter("__more", lambda c: c["step"] <= F.coalesce(F.element_at(limit, c["class"]), F.lit(-1))), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value")))
    return rows.withColumn("spans", F.array_sort(F.concat("__base", random))).withColumnRenamed("__base", "base").drop("__more")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    t = F.coalesce(text, F.lit(""))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(t, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
