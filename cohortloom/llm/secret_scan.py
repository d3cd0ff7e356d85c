"""Secrets by fixed patterns and by a battery of randomness tests. DataFrame functions only.

Every run of 20 or more key characters is a candidate. Dashes and underscores are taken out (uniform data without one of its symbols is uniform
over the others, so base64url loses nothing but those), and its encoding is the smallest alphabet that holds the rest: hex, letters, base32 (three
alphabets) and base36 of either case, letters of both cases, base58, base62, base64. Three tests ask whether it could be uniform random data in
it: the chi-squared statistic of its symbols, the number of runs of a character class (upper, lower, digit, other; not asked of letters of one
case), and the serial correlation of its symbols. Candidates the battery doesn't reject are
secrets unless they may as well be ordinary text: against the coincidences and class changes that text of the same length has,
each gets a p-value, and within each encoding and band of lengths the Benjamini-Hochberg rule keeps the share of false
discoveries below a level. Short candidates thus need to look more random than long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, staged

# The base patterns and their least lengths (of group 2 for assign, of the match otherwise). For the last two kinds
# a match is as long as its run, so the least length is part of the pattern.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

# Candidates of the battery.
LEAST = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
# Of true random data, this share is rejected by the battery; of what is reported, this share may be ordinary text.
REJECTED, FALSE_SHARE = 1e-4, 0.01
# The symbols of each encoding in the order of their values, smaller alphabets first. The first CASELESS hold either case, folded to lower.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": DIGITS + "abcdef", "base26": LOWER, "base32": LOWER + "234567", "base32hex": DIGITS + LOWER[:22], "crockford": DIGITS + "abcdefghjkmnpqrstvwxyz",
    "base36": DIGITS + LOWER, "base52": UPPER + LOWER, "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/",
}
CASELESS = 6
# Symbols of each class (upper, lower, digit, other) in an encoding, and from them the rate of class changes between neighbours of uniform data.
CLASS_SIZES = {code: [sum(x in part for x in symbols) for part in (UPPER, LOWER, DIGITS, "+/")] for code, symbols in ALPHABETS.items()}
CLASS_CHANGES = {code: 1 - sum((x / sum(sizes)) ** 2 for x in sizes) for code, sizes in CLASS_SIZES.items()}
# Ordinary text: sums of the squared and cubed shares of its symbols, and its rate of class changes.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES = 0.066, 0.0056, 0.08
# Bands of length (half powers of two from LEAST), and steps of -log10 p of a histogram: both bounded.
LENGTH_BANDS, STEPS, STEP_END = 8, 10, 40


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """(start, end, match) of the matches, in code points: what lies between them gives their places."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    kind = "struct<at:int,spans:array<struct<start:int,end:int,match:string>>>"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    first = F.expr(f"named_struct('at', 0, 'spans', cast(array() as {kind[len('struct<at:int,spans:'):-1]}))")
    return F.when(F.size(found) > 0, F.aggregate(pairs, first, step)["spans"]).otherwise(first["spans"])


def _two_sided(z: Column) -> Column:
    """Probability that a standard normal number is at least as far from 0 as z (Chebyshev fit of erfc, relative error about 1e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # The coefficients of the fit.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        power = F.lit(c) + t * power
    return F.greatest(t * F.exp(-x * x + power), F.lit(1e-300))


def _left(z: Column) -> Column:
    """Probability that a standard normal number is z or less."""
    return F.greatest(F.when(z < 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2), F.lit(1e-300))


def _fisher(*ps: Column) -> Column:
    """One p-value of several independent ones (tail of chi-squared with twice as many degrees)."""
    half = -sum((F.log(p) for p in ps[1:]), F.log(ps[0]))
    series, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, len(ps)):
        term = term * half / k
        series = series + term
    return F.greatest(F.exp(-half) * series, F.lit(1e-300))


def _by_code(code: Column, values: dict) -> Column:
    *others, last = values
    chosen = F
    for name in others:
        chosen = chosen.when(code == name, F.lit(values[name]))
    return chosen.otherwise(F.lit(values[last]))


def _judged(c: Column) -> Column:
    """A candidate's body without padding and separators, in the symbols of its encoding.

    Dashes and underscores stay as symbols where they are more than a third, as there is no key between them.
    """
    whole = F.rtrim(c["match"], F.lit("="))
    bare = F.translate(whole, "-_", "")
    body = F.when(3 * F.char_length(bare) >= 2 * F.char_length(whole), bare).otherwise(F.translate(whole, "-_", "+/"))
    code = F
    for i, (name, symbols) in enumerate(list(ALPHABETS.items())[:-1]):
        pattern = f"[{symbols}]+" + f"|[{symbols.upper()}]+" * (i < CASELESS)
        code = code.when(body.rlike(f"^({pattern})$"), name)
    code = code.otherwise(list(ALPHABETS)[-1])
    folded = F.when(code.isin(list(ALPHABETS)[:CASELESS]), F.lower(body)).otherwise(body)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), code.alias("code"), folded.alias("body"))


def _measured(c: Column) -> Column:
    """Length, squared counts of the symbols, runs of a class, and the sums that the serial correlation needs."""
    alphabet = _by_code(c["code"], ALPHABETS)
    length = F.char_length(c["body"])

    def square(total: Column, symbol: Column) -> Column:
        count = (length - F.char_length(F.replace(c["body"], symbol, F.lit("")))).cast("double")
        return total + count * count

    symbols = lambda text: F.filter(F.split(text, ""), lambda x: x != "")
    values = F.transform(symbols(c["body"]), lambda x: F.instr(alphabet, x).cast("double"))
    classes = F.translate(c["body"], UPPER + LOWER + DIGITS + "+/", "U" * 26 + "L" * 26 + "D" * 10 + "OO")
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["code"].alias("code"), length.cast("double").alias("n"),
        F.aggregate(symbols(alphabet), F.lit(0.0), square).alias("squares"), F.regexp_count(classes, F.lit("U+|L+|D+|O+")).cast("double").alias("runs"),
        values.alias("values"),
    )


def _summed(c: Column) -> Column:
    """The sums over the values, each in one pass: values, squares, products of neighbours, first and last."""
    v, n = c["values"], c["n"].cast("int")
    total = F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    squared = F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
    ahead = F.zip_with(F.slice(v, 1, n - 1), F.slice(v, 2, n - 1), lambda x, y: x * y)
    product = F.aggregate(ahead, F.lit(0.0), lambda t, x: t + x)
    ends = F.element_at(v, 1) + F.element_at(v, -1)
    names = ("start", "end", "code", "n", "squares", "runs")
    return F.struct(*(c[x].alias(x) for x in names), total.alias("total"), squared.alias("squared"), product.alias("product"), ends.alias("ends"))


def _correlated(c: Column) -> Column:
    """The serial correlation of neighbours from the sums; 1 where all values are equal."""
    mean = c["total"] / c["n"]
    spread = c["squared"] - c["total"] * mean
    together = c["product"] - mean * (2 * c["total"] - c["ends"]) + (c["n"] - 1) * mean * mean
    names = ("start", "end", "code", "n", "squares", "runs")
    return F.struct(*(c[x].alias(x) for x in names), F.when(spread > 1e-9, together / spread).otherwise(F.lit(1.0)).alias("serial"))


def _scored(c: Column) -> Column:
    """start, end, code, band of length, uniform (p-value of the battery), text (-log10 of the p-value as text, in steps)."""
    n, change = c["n"], _by_code(c["code"], CLASS_CHANGES)
    size = _by_code(c["code"], {k: float(len(v)) for k, v in ALPHABETS.items()})
    chi = (size / n * c["squares"] - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    changes = c["runs"] - 1

    def rate(expected: Column | float, shift: float) -> Column:
        return (changes + shift - (n - 1) * expected) / F.sqrt(F.greatest((n - 1) * expected * (1 - expected), F.lit(1e-9)))

    serial = (c["serial"] + 1 / n) * F.sqrt(n)
    symbols, runs, neighbours = _two_sided(chi), _two_sided(rate(change, 0.0)), _two_sided(serial)
    uniform = F.when(change > 0, _fisher(symbols, runs, neighbours)).otherwise(_fisher(symbols, neighbours))
    pairs, same = n * (n - 1) / 2, (c["squares"] - n) / 2
    spread = pairs * (TEXT_SQUARES - TEXT_SQUARES**2) + n * (n - 1) * (n - 2) * (TEXT_CUBES - TEXT_SQUARES**2)
    text = _fisher(_left((same + 0.5 - pairs * TEXT_SQUARES) / F.sqrt(spread)), _left(-rate(F.lit(TEXT_CHANGES), -0.5)))
    band = F.least(F.floor(2 * F.log2(n / LEAST)), F.lit(LENGTH_BANDS - 1)).cast("int")
    step = F.when(uniform >= REJECTED, F.least(F.floor(-F.log10(text) * STEPS), F.lit(STEP_END * STEPS))).otherwise(F.lit(0)).cast("int")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["code"].alias("code"), F.greatest(band, F.lit(0)).alias("band"), uniform.alias("uniform"), step.alias("step"))


def thresholds(candidates: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """(code, band, least): the first step of -log10 p at which at most `share` of what is reported is expected to be text.

    candidates: one row each with code, band, step. The histogram has a bounded number of rows per code and band.
    """
    steps = candidates.groupBy("code", "band", "step").agg(F.count("*").alias("n"))
    stratum = Window.partitionBy("code", "band")
    steps = steps.withColumn("all", F.sum("n").over(stratum))
    steps = steps.withColumn("reported", F.sum("n").over(stratum.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = F.col("all") * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= F.lit(share) * F.col("reported")
    return steps.where(fits & (F.col("step") > 0)).groupBy("code", "band").agg(F.min("step").alias("least"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", parts)


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, all_spans of every whole text (null: empty).

    Spans are structs (start, kind as its place in KINDS, end) in code points, end exclusive, by start, then kind. Base spans are the leftmost
    non-overlapping matches of each kind; all_spans adds the candidates of the battery that lie within no base span. Repeated rows and null
    ids are rows like others. Empty table: empty result. Thresholds depend on all candidates of the table.
    """
    text = F.col("text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    rows = documents(docs).select("doc_id", "text", *(_found(text, p).alias(f"f_{k}") for k, p in patterns.items()))
    rows = rows.select("doc_id", *(_placed(text, F.col(f"f_{k}"), p).alias(k) for k, p in patterns.items()))
    group = lambda s: F.regexp_extract(s["match"], ASSIGN, 2)
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.char_length(group(s)) >= ASSIGN_LEAST))
    for step in (_judged, _measured, _summed, _correlated, _scored):
        rows = rows.withColumn("random", F.transform("random", step))
    base = F.array_sort(F.concat(*(_spans(F.col(k), i) for i, k in enumerate(KINDS[:3]))))
    rows = staged(rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base_spans"), "random"))
    limits = thresholds(rows.select(F.inline("random")), share).collect()  # at most one row per encoding and band of length
    least = {(r["code"], r["band"]): r["least"] for r in limits}

    def reported(c: Column) -> Column:
        answer = F.lit(False)
        for (code, band), step in sorted(least.items()):
            answer = answer | ((c["code"] == code) & (c["band"] == band) & (c["step"] >= step))
        return answer & ~F.exists("base_spans", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))

    rows = rows.withColumn("random", F.filter("random", reported))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"), "base_spans",
        F.array_sort(F.concat("base_spans", _spans(F.col("random"), 3))).alias("all_spans"),
    )


def digests(found: DataFrame) -> DataFrame:
    """find_secrets() rows with the spans as text, and the digest of the base ones."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
        _written(F.col("all_spans")).alias("spans"), "n_random",
    )
