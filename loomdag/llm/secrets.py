"""Secret scan: fixed patterns plus a randomness test battery, in DataFrame functions.

Fixed kinds are ``assign``, ``access`` and ``hex``. Everything else that could be a
key is a candidate token (``CANDIDATE``). For a candidate the encoding is inferred from
the characters present (decimal, hex with or without dashes, letters of one case, base32,
base36, base62, base64) and three tests ask whether it looks like uniform draws from that
alphabet: chi-squared counts of its letters, the number of runs of one class (lower,
upper, digit, sign), and the serial correlation of neighbouring letters. A token that
one of them rejects at ``REJECT`` is no key, nor is one that mostly counts in even steps.

What passes still has to be improbable as writing. Small p-values of the tests speak
against a key, so they cannot be the ones that are picked; the picked one is that of
the token as writing: words, names, paths and numbers stay in a class with probability
``STAYS`` and take its letters as often as writing does (``OFTEN``). Were a token
writing, its likelihood ratio (uniform over writing) would reach r with probability
1 / r at most, which is its p-value; it falls with every letter, so a short token needs
clearer letters than a long one. The
Benjamini-Hochberg step-up then picks the tokens, separately in each class of
lengths, with ``FALSE_DISCOVERIES`` expected false ones among those picked. Its
threshold comes from a histogram of p-values whose size doesn't depend on the data. A
token inside a fixed span adds nothing.

Positions are code points, the end exclusive. Defined results: a null text counts as
empty and has no spans; an empty table gives no rows; repeated rows repeat their
result; overlapping spans are all listed; very long texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import opened, sealed, text_hash, write_table

#: The contract's patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: How often writing stays in the class (digit, lower, upper, sign) of the letter before.
STAYS = [0.7, 0.9, 0.9, 0.1]
#: Shares of digits and, in per mille, of a to z in writing, averaged over languages; none below 4.
DIGITS = [0.22, 0.17, 0.12, 0.08, 0.07, 0.10, 0.06, 0.06, 0.06, 0.06]
OFTEN = [85, 15, 32, 43, 148, 12, 17, 30, 73, 4, 5, 48, 27, 82, 62, 22, 6, 68, 70, 65, 47, 12, 8, 4, 7, 6]
REJECT = 0.001
FALSE_DISCOVERIES = 0.01
#: Upper ends of the length classes; longer ones form the last.
LENGTHS = [24, 32, 48, 64, 128]
#: p-values are binned by their decimal exponent in steps of 1 / BINS, to 10^-DEEPEST.
BINS, DEEPEST = 20, 300


def _spans(kind: str, pieces: Column, matches: Column) -> Column:
    """(start, kind index, end) of every match, from the stretches between matches."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("found"))
    k = KINDS.index(kind)

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        one = F.struct(start.cast("int").alias("start"), F.lit(k).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    places = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, step, add)["found"]


def _normal_tail(z: Column) -> Column:
    """P(N(0,1) > z) for z >= 0, by the Abramowitz-Stegun polynomial 26.2.17."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _token_stats(token: Column) -> Column:
    """codes of a token's letters, and how many digits, lower, upper and signs its alphabet has."""
    body = F.regexp_replace(token, "=+$", "")
    dashed = body.rlike("^(?=.*[a-f])[0-9a-f]+(-[0-9a-f]+)+$") | body.rlike("^(?=.*[A-F])[0-9A-F]+(-[0-9A-F]+)+$")
    body = F.when(dashed, F.regexp_replace(body, "-", "")).otherwise(body)
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: c > 0)
    encodings = [
        ("^[0-9]+$", 10, 0, 0, 0), ("^[0-9a-f]+$", 10, 6, 0, 0), ("^[0-9A-F]+$", 10, 0, 6, 0), ("^[a-z]+$", 0, 26, 0, 0), ("^[A-Z]+$", 0, 0, 26, 0),
        ("^[A-Z2-7]+$", 6, 0, 26, 0), ("^[a-z0-9]+$", 10, 26, 0, 0), ("^[A-Z0-9]+$", 10, 0, 26, 0), ("^[A-Za-z0-9]+$", 10, 26, 26, 0),
    ]
    sizes = F.array(*[F.lit(float(x)) for x in (10, 26, 26, 2)])
    for pattern, *parts in reversed(encodings):
        sizes = F.when(body.rlike(pattern), F.array(*[F.lit(float(x)) for x in parts])).otherwise(sizes)
    return F.struct(sizes.alias("sizes"), codes.alias("codes"))


def _class(code: int) -> int:
    c = chr(code)
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _writing(code: int) -> float:
    """log10 of the letter's share of its class in writing."""
    k = _class(code)
    share = DIGITS[code - 48] if k == 0 else OFTEN[(code | 32) - 97] / sum(OFTEN) if k < 3 else 0.25
    return math.log10(share)


def _battery(stats: Column) -> Column:
    """log10 of the token's p-value as writing; 0 where a test rejects randomness."""
    codes, sizes = stats["codes"], stats["sizes"]
    n = F.size(codes).cast("double")
    table = F.array(*[F.lit(_class(c)) for c in range(128)])
    shares = F.array(*[F.lit(_writing(c)) for c in range(128)])

    def kind(c: Column) -> Column:
        return F.get(table, c)

    letters = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(
        F.array_distinct(codes), F.lit(0.0),
        lambda a, c: a + F.pow(F.size(F.filter(codes, lambda d: d == c)).cast("double"), F.lit(2.0)),
    )
    chi, free = squares * letters / n - n, letters - 1
    # Wilson-Hilferty: a cube root of chi-squared over its freedom is nearly normal
    chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    chi_p = F.when(chi_z <= 0, 1.0).otherwise(_normal_tail(chi_z))
    steps = F.size(codes) - 1
    places = F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))
    changes = F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.when(kind(F.get(codes, i)) != kind(F.get(codes, i - 1)), 1.0).otherwise(0.0))
    same = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x * x) / (letters * letters)
    runs_sd = F.sqrt(F.greatest(steps * same * (1 - same), F.lit(1e-9)))
    runs_p = F.when(same >= 1, 1.0).otherwise(2 * _normal_tail(F.abs(changes - steps * (1 - same)) / runs_sd))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
    varied = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    together = F.aggregate(places, F.lit(0.0), lambda acc, i: acc + (F.get(codes, i) - mean) * (F.get(codes, i - 1) - mean))
    serial_p = F.when(varied <= 0, 0.0).otherwise(2 * _normal_tail(F.abs(together / varied) * F.sqrt(n)))
    even = F.aggregate(
        F.sequence(F.lit(2), F.greatest(steps, F.lit(2))), F.lit(0.0),
        lambda acc, i: acc + F.when(F.get(codes, i) + F.get(codes, i - 2) == 2 * F.get(codes, i - 1), 1.0).otherwise(0.0),
    )
    stays = F.array(*[F.lit(math.log10(x)) for x in STAYS])
    leaves = F.array(*[F.lit(math.log10((1 - x) / 3)) for x in STAYS])

    def step(acc: Column, i: Column) -> Column:
        was = kind(F.get(codes, i - 1))
        return acc + F.when(kind(F.get(codes, i)) == was, F.get(stays, was)).otherwise(F.get(leaves, was))

    written = F.aggregate(codes, F.lit(math.log10(1 / 4)), lambda a, c: a + F.get(shares, c)) + F.aggregate(places, F.lit(0.0), step)
    p = F.least(written + n * F.log10(letters), F.lit(0.0))
    random = (chi_p >= REJECT) & (runs_p >= REJECT) & (serial_p >= REJECT) & (2 * even < steps) & (n >= 20)
    return F.when(random, p).otherwise(0.0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__key, __hash (XXH64 of the text), __base (fixed spans) and __found (candidates with log p), written once."""
    rest = ["__key"]
    d = docs.select(F.col(key).alias("__key"), text_hash(F.col(text)).alias("__hash"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    parts, patterns = [], {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    for kind, pattern in patterns.items():
        parts.append(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)).alias(f"__m_{kind}"))
    parts.append(F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(2)).alias("__values"))
    d = d.select("*", *parts)
    # only texts with matches are split again
    cut = [F.when(F.size(f"__m_{kind}") > 0, F.split("__text", pattern, -1)).alias(f"__p_{kind}") for kind, pattern in patterns.items()]
    d = d.select(*rest, "__hash", "__values", *[f"__m_{k}" for k in KINDS], *cut)
    d = d.select(*rest, "__hash", "__values", "__m_random", *[_spans(k, F.col(f"__p_{k}"), F.col(f"__m_{k}")).alias(f"__s_{k}") for k in KINDS])
    assigned = F.filter("__s_assign", lambda s, i: F.length(F.get(F.col("__values"), i)) >= LEAST_ASSIGNED)
    base = F.sort_array(F.concat(assigned, F.col("__s_access"), F.col("__s_hex")))
    d = d.select(*rest, "__hash", base.alias("__base"), F.arrays_zip(F.col("__s_random").alias("span"), F.col("__m_random").alias("token")).alias("__cand"))
    d = d.withColumn("__cand", F.transform("__cand", lambda c: F.struct(c["span"].alias("span"), c["token"].alias("token"), _token_stats(c["token"]).alias("stats"))))
    found = F.transform("__cand", lambda c: F.struct(c["span"].alias("span"), F.length(c["token"]).alias("n"), _battery(c["stats"]).alias("p")))
    return write_table(d.select(*rest, "__hash", "__base", found.alias("__found")), "secret-candidates")


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for k, most in reversed(list(enumerate(LENGTHS))):
        out = F.when(n <= most, k).otherwise(out)
    return out


def thresholds(scanned: DataFrame) -> list[float]:
    """For each length class the largest log10 p that the step-up accepts (-inf: none).

    At most (classes x BINS x DEEPEST) histogram rows come to the driver.
    """
    tokens = scanned.select(F.explode("__found").alias("c")).select(_length_class(F.col("c.n")).alias("k"), F.col("c.p").alias("p"))
    bins = tokens.groupBy("k", F.least(F.floor(-F.col("p") * BINS), F.lit(BINS * DEEPEST)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for k in range(len(LENGTHS) + 1):
        own = sorted((r["bin"], r["n"]) for r in bins if r["k"] == k)
        total, rank, best = sum(n for _, n in own), 0, float("-inf")
        for b, n in reversed(own):
            rank += n
            if 10 ** (-b / BINS) <= FALSE_DISCOVERIES * rank / total:
                best = -b / BINS
        out.append(best)
    return out


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, base_spans and spans, sorted (start, kind, end), and __hash."""
    scanned = scan(docs, key, text)
    limits = F.array(*[F.lit(x) for x in thresholds(scanned)])
    picked = F.filter("__found", lambda c: c["p"] <= F.get(limits, _length_class(c["n"])))
    fresh = F.filter(
        F.transform(picked, lambda c: c["span"]),
        lambda s: ~F.exists("__base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
    )
    spans = F.sort_array(F.concat(F.col("__base"), fresh))
    return scanned.select(F.col("__key").alias(key), "__hash", F.col("__base").alias("base_spans"), spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark``.

    Texts without a span are passed on as they are. A row is known by its key and its
    text's hash, not by its place: another reading of ``docs`` may be split in another way.
    """
    found = secret_spans(docs, key, text).filter(F.size("spans") > 0)
    found = write_table(found.select(F.col(key).alias("__hit"), "__hash", F.col("spans").alias("__spans")).dropDuplicates(["__hit", "__hash"]), "secret-hits")
    rows, names = sealed(docs)
    text, count = names[text], names.get("n_chars")
    placed = rows.select("*", F.col(names[key]).alias("__key"), text_hash(F.col(text)).alias("__own"))
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(whole, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        first = (acc["at"] == 0) | fresh
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(first, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate("__spans", start, step)
    clean = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(done["out"], F.substring(whole, done["at"] + 1, F.length(whole))))
    joined_up = placed.join(found, F.expr("__own = __hash and __key <=> __hit"), "left").withColumn(text, clean)
    if count:
        joined_up = joined_up.withColumn(count, F.when(F.col("__spans").isNull(), F.col(count)).otherwise(F.length(text).cast("long")))
    return opened(joined_up, names)
