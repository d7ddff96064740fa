"""Quality rules with adaptive thresholds, in DataFrame functions.

Two fixed rules come first (``base_failed``). For the rest no cutoff is fixed: for
every (language, source) a mergeable quantile sketch holds the lower quartile and the
median of the logarithm of each ratio. Counts that may be zero enter the sketch half a
count larger, so that a group where most documents have none still has a spread, by the
lengths of its documents; the document's own ratio is compared as it is. The distance of the two quantiles is the group's own spread; it is
taken below the median, where no junk reaches. A document is rejected when a ratio lies further above its group's median (or, for
word length, below it) than the rule's number of such spreads. A group of fewer than
``LEAST_GROUP`` documents takes the sketch of its language, a language of as few that of
the corpus, and a corpus of as few rejects nothing.
``LEAST_SPREAD`` only keeps a group of equal values from rejecting its own half; real
groups lie far above it.

Defined results: a null text has no words and fails; a null language or source is a
group of its own; empty texts fail; an empty table gives no rows; very long texts are
read whole; rows that repeat get one verdict each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import opened, sealed, write_table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
LEAST_GROUP = 100
LEAST_SPREAD = 0.005
#: Relative rank error of a sketch is 1 / ACCURACY.
ACCURACY = 1000

#: Fences of more groups than this are joined by a shuffle, not broadcast.
BROADCAST_GROUPS = 100_000

#: Rule -> (count, of what, added to the count in sketches, how many spreads are accepted, whether small values are rejected too).
RULES = {
    "word_length": ("word_chars", "n_words", 0.0, 12.0, True),
    "symbols_per_word": ("n_symbols", "n_words", 0.5, 10.0, False),
    "repeated_lines": ("n_dup_lines", "greatest(n_lines, 1)", 0.5, 3.0, False),
    "repeated_words": ("n_repeat_words", "n_words", 0.5, 8.0, False),
}


def _covered(sorted_starts: Column, width: int) -> Column:
    """How many places the stretches [start, start + width) cover together."""
    step = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(
        sorted_starts,
        step,
        lambda acc, p: F.struct((acc["n"] + p + width - F.greatest(acc["end"], p)).alias("n"), (p + width).alias("end")),
    )
    return total["n"].cast("long")


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (sealed) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows of three words are compared by XXH64 inside one text. A text whose
    windows all differ needs no sort; else the windows are sorted by (hash, place)
    and those equal to a neighbour are repeated.
    """
    d = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    own = docs.columns
    d = d.select(
        *own,
        F.filter(F.split("__text", SPACES), lambda w: w != "").alias("__words"),
        F.translate("__text", " \t\n\x0b\x0c\r", "").alias("__bare"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words = F.col("__words")
    d = d.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.length("__bare").cast("long").alias("word_chars"),
        (F.length("__bare") - F.length(F.translate("__bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("__words") > 2,
            F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
        ).alias("__windows"),
    )
    d = d.withColumn(
        "__placed",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    placed = F.col("__placed")
    twins = F.transform(
        F.filter(placed, lambda p, i: (F.get(placed, i + 1)["h"] == p["h"]) | ((i > 0) & (F.get(placed, F.greatest(i - 1, F.lit(0)))["h"] == p["h"]))),
        lambda p: p["i"],
    )
    d = d.withColumn("__starts", F.when(F.col("__placed").isNotNull(), F.sort_array(twins)))
    return d.select(
        *own,
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(_covered(F.col("__starts"), 3), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")


def fences(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per (language, source): the accepted range of every ratio's logarithm, from merged sketches.

    __lang, __source, and per rule __max_, __min_ (where small values count) and __of_, the
    level (group, lang, all, none) whose sketch decides. One row for each group.
    """
    logs = {name: F.expr(f"ln(({count} + {more}) / {of})") for name, (count, of, more, _, _) in RULES.items()}
    ratios = features.filter(~base_failed()).select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), *[x.alias(f"__{name}") for name, x in logs.items()])
    sketches = [
        F.struct(F.count(f"__{name}").alias("n"), F.percentile_approx(f"__{name}", [0.25, 0.5], ACCURACY).alias("q")).alias(name) for name in RULES
    ]
    group = ratios.groupBy("__lang", "__source").agg(F.struct(*sketches).alias("group"))
    langs = ratios.groupBy(F.col("__lang").alias("__of_lang")).agg(F.struct(*sketches).alias("lang"))
    whole = ratios.agg(*sketches).first()
    joined = group.join(langs, F.col("__lang").eqNullSafe(F.col("__of_lang")), "left")
    bounds = []
    for name, (_, _, _, most, both) in RULES.items():
        own = whole[name]
        level = F.when(F.col(f"group.{name}.n") >= LEAST_GROUP, "group").when(F.col(f"lang.{name}.n") >= LEAST_GROUP, "lang")
        level = level.otherwise("all" if own["n"] >= LEAST_GROUP else "none")
        corpus = F.array(*[F.lit(float(x)) for x in own["q"]]) if own["n"] >= LEAST_GROUP else F.lit(None).cast("array<double>")
        q = F.when(level == "group", F.col(f"group.{name}.q")).when(level == "lang", F.col(f"lang.{name}.q")).otherwise(corpus)
        reach = F.greatest(q[1] - q[0], F.lit(LEAST_SPREAD)) * most
        bounds += [(q[1] + reach).alias(f"__max_{name}"), level.alias(f"__of_{name}")]
        if both:
            bounds.append((q[1] - reach).alias(f"__min_{name}"))
    return joined.select(F.col("__lang"), F.col("__source"), *bounds)


def judge(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``features`` with base_failed and kept; ``features`` must be written (it is read twice)."""
    limits = write_table(fences(features, lang, source), "quality-fences")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    inside = F.lit(True)
    for name, (count, of, _, _, both) in RULES.items():
        x = F.expr(f"case when {count} > 0 then ln({count} / {of}) end")
        inside = inside & F.coalesce(x <= F.col(f"__max_{name}"), F.lit(True))
        if both:
            inside = inside & F.coalesce(x >= F.col(f"__min_{name}"), F.lit(True))
    same = F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source"))
    return features.join(limits, same, "left").select(
        *features.columns,
        base_failed().alias("base_failed"),
        F.when(base_failed(), F.lit(False)).otherwise(inside).alias("kept"),
    )


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = False) -> DataFrame:
    """One row per document: features, base_failed and kept after its own columns, without
    ``text`` unless ``keep_text``; a column of the same name as a result gives way to it."""
    rows, names = sealed(docs)
    scored = text_features(rows, names[text])
    judged = judge(write_table(scored if keep_text else scored.drop(names[text]), "quality-features"), names[lang], names[source])
    results = [c for c in judged.columns if c not in names.values()]
    stay = {c: n for c, n in names.items() if c not in results and (keep_text or c != text)}
    return judged.select(*[F.col(n).alias(c) for c, n in stay.items()], *results)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    rows, names = sealed(docs)
    return opened(quality_rules(rows, names[text], names[lang], names[source], keep_text=True).filter("kept"), names)
