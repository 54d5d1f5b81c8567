"""Secret scan: fixed patterns, and tokens that a battery of randomness tests takes for random.

*Patterns* give the base spans ``assign``, ``access`` and ``hex``.  They are
found by what lies between the matches, as Spark has no function for places.

*Tokens* are runs of ``[A-Za-z0-9+/_-]`` of at least ``SHORTEST`` characters that
touch no base span and hold a letter and a digit.  Their encoding is the
narrowest alphabet with all their characters: hexadecimal, base 32, base 62 or
base 64, either with ``+/`` or with ``-_``.  Under the hypothesis that every character is drawn
evenly from the alphabet, each test gives a standardised value:

* chi-squared: how unevenly the characters are used, by the mean and variance
  that the statistic has for the token's length;
* runs: changes between the alphabet's halves, against half of all steps;
* serial correlation: the products of neighbours' places in the alphabet.

The largest absolute value, with a chance for each of the tests, is the token's
p-value for not being random.  Short tokens give tests little to see, so
discoveries are controlled by length: within an encoding and a doubling of
length, Benjamini and Hochberg's step-up rule at ``rate`` finds the tokens that
are not random, among which at most that share is expected to be.  The tokens
that are left get spans of kind ``random``.

p-values are kept in steps of a hundredth of a power of ten, rounded up, so the
rule needs only a count of each step: tokens are never sorted or brought
together, and what is broadcast has a row for each encoding and length class.

Each row of the documents is scanned by itself and returned; a null text is
empty, and an empty one has no spans.  Equal texts get equal spans, and repeated
rows count each in the rule.  Texts and tokens of any length count whole; runs
and products are taken within stretches of ``STRETCH`` characters.  An empty
table gives an empty result; other columns are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm import storage

#: The base patterns.  Runs of hexadecimal digits and of key characters are matched whole, so a least length may stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGNED = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 20
TOKEN = "[A-Za-z0-9+/_-]{%d,}" % SHORTEST
STRETCH = 4096
#: Steps of a power of ten in which p-values are kept, and the smallest power.
STEPS, LEAST = 100, 40

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the characters they allow, the narrowest first, with their alphabets.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "^.+$", UPPER + LOWER + DIGITS + "+/-_"),
)
TESTS = 3
#: Matches of a text that are placed in one go.
GROUP = 256
_PLACED = "array<struct<s:long,e:long,v:string>>"


def _running(items: Column, first: Column, out: str, value: Callable[[Column, Column], Column], more: Callable[[Column], Column]) -> Column:
    """An array with value(item, at) of every item, where at grows by more(item)."""
    start = F.struct(F.array().cast(out).alias("out"), first.cast("long").alias("at"))
    step = lambda z, x: F.struct(F.concat(z["out"], F.array(value(x, z["at"]))).alias("out"), (z["at"] + more(x)).alias("at"))
    return F.aggregate(items, start, step, lambda z: z["out"])


def _located(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Adds the array (s, e, v) of all matches, in code points: a match begins after the matches and gaps before it.

    Matches are placed by groups of GROUP, as an array that grows costs its square.
    """
    found, gaps, grouped = f"_{name}", f"_{name}_gaps", f"_{name}_groups"
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(F.length(g).alias("g"), v.alias("v")))
    groups = F.transform(F.sequence(F.lit(0), F.expr(f"(size({found}) - 1) div {GROUP}")), lambda i: F.slice(F.col(found + "_pairs"), i * GROUP + 1, F.lit(GROUP)))
    df = df.withColumn(found + "_pairs", F.when(F.size(found) > 0, pairs)).withColumn(grouped, F.when(F.size(found) > 0, groups))
    length = lambda x: x["g"] + F.length(x["v"])
    whole = F.transform(grouped, lambda group: F.aggregate(group, F.lit(0).cast("long"), lambda z, x: z + length(x)))
    df = df.withColumn(grouped, F.zip_with(grouped, _running(whole, F.lit(0), "array<long>", lambda x, at: at, lambda x: x), lambda group, at: F.struct(group.alias("group"), at.alias("at"))))
    placed = lambda x, at: F.struct((at + x["g"]).alias("s"), (at + length(x)).alias("e"), x["v"].alias("v"))
    spans = F.flatten(F.transform(grouped, lambda part: _running(part["group"], part["at"], _PLACED, placed, length)))
    return df.withColumn(name, F.coalesce(spans, F.array().cast(_PLACED))).drop(found, gaps, found + "_pairs", grouped)


def _span(kind: int, matches: Column) -> Column:
    """(s, kind, e): sorted by their start and then by their kind."""
    return F.transform(matches, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("kind"), m["e"].alias("e")))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def _encoding(token: Column) -> Column:
    """The place in ENCODINGS of the narrowest alphabet."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(ENCODINGS[i][1]), i).otherwise(out)
    return out


def _by_encoding(values: list, encoding: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), encoding)


def _tail(z: Column) -> Column:
    """Power of ten of the chance that a normal value is farther from zero, by the continued fraction of the tail."""
    fraction = z + 0.65
    for n in (4, 3, 2, 1):
        fraction = z + n / fraction
    return (z * z / 2 + F.lit(math.log(math.sqrt(2 * math.pi) / 2)) + F.log(fraction)) / math.log(10)


def battery(token: Column, encoding: Column) -> Column:
    """(chi, runs, serial): standardised values of the tests."""
    n = F.length(token).cast("double")
    alphabet, k = _by_encoding([e[2] for e in ENCODINGS], encoding), _by_encoding([float(len(e[2])) for e in ENCODINGS], encoding)
    halves = _by_encoding(["L" * (len(e[2]) // 2) + "H" * (len(e[2]) // 2) for e in ENCODINGS], encoding)

    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda z, c: z + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

    half = F.call_function("translate", token, alphabet, halves)
    changes = n - (F.length(F.replace(half, F.lit("LH"), F.lit(""))) + F.length(F.replace(half, F.lit("HL"), F.lit("")))) / 2
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)

    stretches = F.transform(F.sequence(F.lit(0), F.call_function("div", F.length(token) - 1, F.lit(STRETCH))), lambda i: F.substring(token, i * STRETCH + 1, F.lit(STRETCH)))
    place = lambda c: F.call_function("instr", alphabet, c) - (k + 1) / 2

    def products(stretch: Column) -> Column:
        places = F.transform(F.split(stretch, ""), place)
        return F.aggregate(places, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last")), lambda z, x: F.struct((z["sum"] + z["last"] * x).alias("sum"), x.alias("last")), lambda z: z["sum"])

    pairs = n - F.size(stretches)
    serial = F.aggregate(stretches, F.lit(0.0), lambda z, x: z + products(x)) / (F.sqrt(pairs) * (k * k - 1) / 12)
    return F.struct(chi.alias("chi"), runs.alias("runs"), serial.alias("serial"))


def _step(tests: Column) -> Column:
    """-100 log10 of the token's p-value, rounded down."""
    most = F.greatest(F.abs(tests["chi"]), F.abs(tests["runs"]), F.abs(tests["serial"]))
    return F.least(F.greatest(F.floor((_tail(most) - math.log10(TESTS)) * STEPS), F.lit(0)), F.lit(STEPS * LEAST)).cast("int")


def scanned(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns in keep, base spans, and tested tokens with their class and step."""
    df = docs.select(F.struct(*keep).alias("_row"), F.coalesce(text, F.lit("")).alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        df = _located(df, name, "_text", pattern)
    enough = F.filter("assign", lambda m: F.length(F.regexp_extract(m["v"], ASSIGN, 2)) >= ASSIGNED)
    df = df.drop("_text").withColumn("base", F.concat(_span(0, enough), _span(1, F.col("access")), _span(2, F.col("hex"))))
    df = df.select("_row", "base", F.filter("token", lambda m: m["v"].rlike("[A-Za-z]") & m["v"].rlike("[0-9]")).alias("token"))
    apart = F.filter("token", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    df = df.withColumn("token", F.transform(apart, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v"), _encoding(m["v"]).alias("encoding"))))
    tested = lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), (m["encoding"] * 100 + F.floor(F.log2((m["e"] - m["s"]).cast("double")))).cast("int").alias("class"), _step(battery(m["v"], m["encoding"])).alias("step"))
    return df.select("_row.*", "base", F.transform("token", tested).alias("tokens"))


def step_up(tokens: DataFrame, rate: float) -> DataFrame:
    """(class, least): the least step at which a class's tokens are taken for not random; classes without one are left out."""
    counts = tokens.groupBy("class", "step").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("class")
    chance = F.pow(F.lit(10.0), -F.col("step") / float(STEPS)) * F.sum("n").over(by_class)
    ranked = counts.select("class", "step", chance.alias("expected"), F.sum("n").over(by_class.orderBy(F.desc("step"))).alias("rank"))
    return ranked.where(F.col("expected") <= rate * F.col("rank")).groupBy("class").agg(F.min("step").alias("least"))


def scan(docs: DataFrame, keep: list[str], text: str = "text", rate: float = 0.05) -> DataFrame:
    """The columns in keep, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    scratch = storage.Scratch(docs.sparkSession, "secrets")
    try:
        found = scratch.written(scanned(docs, keep, text), "scanned")
        limits = step_up(found.select(F.explode("tokens").alias("t")).select("t.class", "t.step"), rate)
        bounds = limits.agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("_limits"))  # one row, of encodings x length classes
        random = F.filter("tokens", lambda t: F.coalesce(t["step"] < F.try_element_at("_limits", t["class"]), F.lit(True)))
        counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
        result = found.crossJoin(F.broadcast(bounds)).select(*keep, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", _span(3, random))).alias("spans"))
        return storage.written(result, "secrets")
    finally:
        scratch.drop()
