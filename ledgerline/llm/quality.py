"""Quality rules: distribution divergence against language references. DataFrame functions only.

Each document gets two histograms: character classes, and how often each common word of its language
occurs. Their Jensen-Shannon distances (base 2, so 0 to 1) to the language's reference histograms
decide, besides a few base rules. The references are the pooled histograms of all documents
of the language that pass the base rules, so they grow with the corpus and need no outside file.

The word limit follows from the reference: words drawn at random from it lie off it by chance, by a mean and a
spread that depend on the length (``chance``), and the limit is so many spreads above that mean. Where chance alone makes
a text without any common word all but impossible, the limit also lies below the distance of such a text.

Minimum-length guards: the word distance counts from ``min_words`` words on, the class
distance from ``min_chars`` characters on. Shorter texts are judged by the base rules alone.

Nulls and odd rows: null or wordless text has no words and fails the base rule; a null or unlisted language
has its own pooled class reference and no word reference; repeated rows are judged alike; an empty table gives no rows;
the caller chooses which columns go along, and those named like a column of the report get an underscore at their end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACES, free_names, table, words, written

# The most frequent function words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "this"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con"),
}

#: Character classes in the order in which they are taken off the text; the rest is "other".
CLASSES = (("lower", "[a-z]+"), ("space", SPACES), ("upper", "[A-Z]+"), ("digit", "[0-9]+"),
           ("symbol", r"[#*$%&|<>=+@^~_{}\[\]\\/]+"), ("punct", "[\\x21-\\x7E]+"))
SYMBOLS = "[#*$%&|<>]+"

#: Text lengths in words for which chance is computed; between them and beyond the last it goes with 1 / n.
LENGTHS = tuple(round(20 * 2 ** (k / 8)) for k in range(46))
#: A text without common words is judged to be none by chance if chance gives it less often than this.
RARE = 1e-4


class Limits(NamedTuple):
    """Verdict limits. Distances lie between 0 and 1. The squared word limit is ``word_floor`` squared plus the mean and
    ``word_spreads`` standard deviations of what chance gives at that length; characters come in words, not one by one,
    so their limit is ``class_floor + class_slack / sqrt(n_words)``."""

    min_words: int = 60
    min_chars: int = 200
    word_floor: float = 0.06
    word_spreads: float = 3.5
    class_floor: float = 0.11
    class_slack: float = 1.9
    base_words: int = 20
    base_repeat_percent: int = 30


def repeated_window_words(w: Column, n: int = 8) -> list[tuple[str, Column]]:
    """Steps (column name, expression) that end in ``n_repeat_words``: words inside windows of ``n`` words
    that occur twice or more in the text. Window keys come by doubling (pairs, fours, eights) from word
    hashes; equal keys meet by sorting (key, position). Each step uses the one before as an argument,
    never inside a lambda, so nothing is computed twice."""
    if n != 8:
        raise ValueError("windows have eight words")
    pair = lambda c, k: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - k, F.lit(0))),
                                   F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return [("__h1", F.transform(w, lambda x: F.xxhash64(x))),
            ("__h2", pair(F.col("__h1"), 1)), ("__h4", pair(F.col("__h2"), 2)), ("__h8", pair(F.col("__h4"), 4)),
            # most texts repeat nothing: they go on with an empty array
            ("__keys", F.when(F.size(F.array_distinct("__h8")) < F.size("__h8"), F.array_sort(F.transform(
                F.col("__h8"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
                F.array().cast("array<struct<h:bigint,i:int>>"))),
            ("__next", F.zip_with("__keys", F.slice("__keys", F.lit(2), F.greatest(F.size("__keys"), F.lit(1))),
                                  lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))),
            ("__both", F.zip_with("__next", F.concat(F.array(F.lit(False)), F.col("__next")),
                                  lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))),
            ("__at", F.array_sort(F.transform(F.filter(F.zip_with("__keys", "__both", lambda k, r: F.struct(k["i"].alias("i"), r.alias("r"))),
                                                       lambda x: x["r"] & x["i"].isNotNull()), lambda x: x["i"]))),
            ("n_repeat_words", F.aggregate(
                F.zip_with("__at", F.slice("__at", F.lit(2), F.greatest(F.size("__at"), F.lit(1))),
                           lambda a, b: F.least(F.coalesce(b - a, F.lit(n)), F.lit(n))),
                F.lit(0).cast("bigint"), lambda acc, x: acc + x))]


def language(lang: Column, common: Mapping[str, Sequence[str]]) -> Column:
    return F.when(lang.isin(*common), lang).otherwise(F.lit("other"))


def features(docs: DataFrame, keep: Sequence[str], text: str, lang: str, limits: Limits,
             common: Mapping[str, Sequence[str]]) -> DataFrame:
    """``row`` (the ``keep`` columns), base counts, and the histograms ``class_counts`` and ``word_counts`` (its last
    bin is all other words)."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("__text"),
                     language(F.col(lang), common).alias("__lang"))
    df = df.withColumn("__words", words(F.col("__text")))
    df = df.withColumn("__joined", F.array_join("__words", "  "))
    for name, step in repeated_window_words(F.col("__words")):
        df = df.withColumn(name, step)
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("__lines", lines)
    df = df.withColumn("n_words", F.size("__words").cast("bigint"))
    df = df.withColumn("word_chars", F.when(F.col("n_words") == 0, F.lit(0)).otherwise(
        F.length("__joined") - 2 * (F.col("n_words") - 1)).cast("bigint"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
    # character classes: each step takes one class off what is left
    left, counts = "__text", []
    for name, pattern in CLASSES:
        df = df.withColumn(f"__no_{name}", F.regexp_replace(left, pattern, ""))
        counts.append(F.length(left) - F.length(f"__no_{name}"))
        if name == "lower":
            df = df.withColumn("n_symbols", (F.length("__no_lower") - F.length(
                F.regexp_replace("__no_lower", SYMBOLS, ""))).cast("bigint"))
        left = f"__no_{name}"
    df = df.withColumn("class_counts", F.array(*[c.cast("bigint") for c in [*counts, F.length(left)]]))
    # common words: the joined words are two spaces apart, so " word " never overlaps its neighbour
    df = df.withColumn("__spaced", F.concat(F.lit(" "), F.lower("__joined"), F.lit(" ")))
    bins = max([len(x) for x in common.values()], default=0)
    size = F.length("__spaced")
    found = F.lit(None).cast("array<bigint>")
    for name, listed in common.items():
        each = [((size - F.length(F.replace("__spaced", F.lit(f" {x} ")))) / (len(x) + 2)).cast("bigint") for x in listed]
        each += [F.lit(0).cast("bigint")] * (bins - len(each))
        found = F.when(F.col("__lang") == name, F.array(*each)).otherwise(found)
    df = df.withColumn("__found", found)
    rest = F.col("n_words") - F.aggregate("__found", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    df = df.withColumn("word_counts", F.concat("__found", F.array(rest)))
    df = df.withColumn("base_failed", (F.col("n_words") < limits.base_words) | (
        100 * F.col("n_repeat_words") > limits.base_repeat_percent * F.col("n_words")))
    return df.select("row", F.col("__lang").alias("ref_lang"), "n_words", "word_chars", "n_symbols",
                     "n_dup_lines", "n_repeat_words", "base_failed", "class_counts", "word_counts")


def references(feats: DataFrame, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per language (a short fixed list and "other"): pooled histograms of the rows that pass the base rules."""
    n_class, n_word = len(CLASSES) + 1, max([len(x) for x in common.values()], default=0) + 1
    total = lambda c, n: F.array(*[F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for k in range(n)])
    return feats.filter("not base_failed").groupBy("ref_lang").agg(
        total("class_counts", n_class).alias("ref_class"), total("word_counts", n_word).alias("ref_word"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (short arrays of counts); null if either is empty."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    share = lambda c: F.transform(c, lambda x: x / total(c))
    parts = F.zip_with(share(p), share(q), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    divergence = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / 2
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def divergence_part(p: Column, q: Column) -> Column:
    """What one bin with shares ``p`` and ``q`` adds to the Jensen-Shannon divergence."""
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (term(p) + term(q)) / 2


def chance(ref: Column) -> Column:
    """For each of ``LENGTHS``: mean and variance of the divergence between the histogram ``ref`` and that of so many words
    drawn from it. Each bin's count is binomial; its probabilities follow one from the other, counted from the rarer side."""
    total = F.aggregate(ref, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    zero = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))

    def of_bin(n: Column, q: Column) -> Column:
        u = F.least(q, 1 - q)
        last = F.least(n, F.ceil(n * u + 10 * F.sqrt(n * u) + 20).cast("int"))

        def step(acc: Column, k: Column) -> Column:
            part = divergence_part(F.when(q > 0.5, n - k).otherwise(k) / n, q)
            return F.struct((acc["p"] * (n - k) / (k + 1) * u / (1 - u)).alias("p"), (acc["m1"] + acc["p"] * part).alias("m1"),
                            (acc["m2"] + acc["p"] * part * part).alias("m2"))

        start = F.struct(F.pow(1 - u, n).alias("p"), F.lit(0.0).alias("m1"), F.lit(0.0).alias("m2"))
        return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: F.struct(
            acc["m1"].alias("mean"), F.greatest(acc["m2"] - acc["m1"] * acc["m1"], F.lit(0.0)).alias("var")))

    of_length = lambda n: F.aggregate(F.transform(ref, lambda x: of_bin(n, x / total)), zero, lambda acc, x: F.struct(
        (acc["mean"] + x["mean"]).alias("mean"), (acc["var"] + x["var"]).alias("var")))
    return F.when(total > 0, F.transform(F.array(*map(F.lit, LENGTHS)), of_length))


def with_chance(refs: DataFrame) -> DataFrame:
    """Adds to each language what its word limits need: ``chance``, the share of words that aren't common (the last bin)
    and the squared distance of a text that has no other."""
    ref = F.col("ref_word")
    total = F.aggregate(ref, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    df = refs.withColumn("chance", chance(ref)).withColumn("rest_share", F.when(total > 0, F.element_at(ref, -1) / total))
    blank = divergence_part(F.lit(1.0), F.col("rest_share")) + (1 - F.col("rest_share")) / 2
    return df.withColumn("blank_squared", blank)


def word_limit(limits: Limits) -> Column:
    """The word limit of a row with ``n_words`` next to its language's columns of ``with_chance``; null without reference."""
    n = F.col("n_words")
    lengths = F.array(*map(F.lit, LENGTHS))
    at = F.greatest(F.size(F.filter(lengths, lambda x: x <= n)), F.lit(1))
    near = F.element_at("chance", at)
    scale = F.element_at(lengths, at) / n
    squared = limits.word_floor ** 2 + scale * (near["mean"] + limits.word_spreads * F.sqrt(near["var"]))
    below = 0.98 * F.col("blank_squared")
    return F.sqrt(F.when(F.pow("rest_share", n) < RARE, F.least(squared, below)).otherwise(squared))


def judge(feats: DataFrame, refs: DataFrame, limits: Limits) -> DataFrame:
    """Adds class_distance, word_distance and kept. ``refs`` has one row per listed language: broadcast."""
    df = feats.join(F.broadcast(with_chance(refs)), "ref_lang", "left")
    df = df.withColumn("class_distance", js_distance(F.col("class_counts"), F.col("ref_class")))
    df = df.withColumn("word_distance", js_distance(F.col("word_counts"), F.col("ref_word")))
    n_chars = F.aggregate("class_counts", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    root = F.sqrt(F.col("n_words"))
    far = ((n_chars >= limits.min_chars) & (F.coalesce("class_distance", F.lit(0.0)) > limits.class_floor + limits.class_slack / root)) | (
        (F.col("n_words") >= limits.min_words) & F.coalesce(F.col("word_distance") > word_limit(limits), F.lit(False)))
    far = (F.col("n_words") > 0) & far
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_report(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang",
                   limits: Limits = Limits(), common: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """``keep`` columns with counts, distances and the verdict. The texts are read once: the histograms are
    written as a small table, pooled, and judged against the pool."""
    feats = written(features(docs, keep, text, lang, limits, common), "quality")
    out = judge(feats, references(feats, common), limits)
    own = [c for c in out.columns if c != "row"]
    return out.select(*[F.col("row")[c].alias(free) for c, free in zip(keep, free_names(list(keep), own))], *own)


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_report(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance")
