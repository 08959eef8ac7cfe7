"""Quality rules: base counts against brute force, distances, verdicts."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality
from tests.llm.samples import documents, edge_docs, empty_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    cover = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark):
    lines = "one two\n one two\none two\n\n   \nx#*$\n" * 3
    more = spark.createDataFrame([(100, lines, "en"), (101, prose(40, 9) + " " + prose(40, 9), "en"), (102, "a b c d e f g h " * 20, None)],
                                 "doc_id long, text string, lang string")
    for df in (edge_docs(spark).select("doc_id", "text", "lang").unionByName(more), documents(spark)):
        got = sorted((tuple(r) for r in quality.quality_report(df, ["doc_id"]).select("doc_id", *COUNTS).collect()), key=str)
        assert got == sorted(((r["doc_id"], *slow_counts(r["text"])) for r in df.collect()), key=str)


def test_verdicts(spark):
    clean = [(k, prose(300, k), "en") for k in range(60)]
    junk = [(100, " ".join(x + "###" for x in prose(300, 77).split()), "en"), (101, " | ".join(f"zq{k}vx" for k in range(400)), "en"),
            (102, "short text", "en"), (103, None, None)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality_report(df, ["doc_id"]).filter("kept").collect()}
    assert kept == set(range(60))


def test_short_junk_is_rejected(spark):
    """Texts of 60 to 200 words without common words, between clean ones of the same lengths."""
    lengths = (60, 75, 90, 110, 130, 160, 200)
    clean = [(1000 * n + k, prose(n, 7 * n + k), "en") for n in lengths for k in range(20)]
    junk = [(-n, " ".join(f"w{(37 * n + 11 * k) % 400}x" for k in range(n)), "en") for n in lengths]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality_report(df, ["doc_id"]).filter("kept").collect()}
    assert kept == {i for i, _, _ in clean}


def test_chance_and_blank(spark):
    """Mean and spread against exact sums, and limits below a text without common words from min_words on."""
    ref = [120, 63, 50, 37, 0, 730]
    row = quality.with_chance(spark.createDataFrame([(ref,)], "ref_word array<long>")).first()
    part = lambda p, q: sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x) / 2
    for n, got in zip(quality.LENGTHS, row["chance"]):
        mean = var = 0
        for q in (x / sum(ref) for x in ref):
            each = [(math.comb(n, k) * q ** k * (1 - q) ** (n - k), part(k / n, q)) for k in range(n + 1)] if n < 200 else []
            first = sum(p * x for p, x in each)
            mean, var = mean + first, var + sum(p * x * x for p, x in each) - first * first
        if n < 200:
            assert got["mean"] == pytest.approx(mean, rel=1e-6) and got["var"] == pytest.approx(var, rel=1e-4), n
    df = quality.with_chance(spark.createDataFrame([(ref,)], "ref_word array<long>")).crossJoin(spark.range(60, 5000).withColumnRenamed("id", "n_words"))
    assert df.filter(quality.word_limit(quality.Limits()) >= F.sqrt("blank_squared")).count() == 0


def test_labelled_rows(spark):
    """Labelled documents whose ids weren't used to choose the limits (odd CRC-32): junk from 60 words on goes, clean texts stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_report(docs, ["doc_id"]).join(labels, "doc_id").filter("not base_failed and crc32(cast(doc_id as string)) % 2 = 1")
    rows = got.select("quality", "kept", "n_words").collect()
    junk = [r["kept"] for r in rows if r["quality"] == 0 and r["n_words"] >= 60]
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert len(junk) > 100 and sum(junk) <= 0.04 * len(junk) and sum(clean) >= 0.999 * len(clean)


def test_js_distance(spark):
    p, q = [5, 0, 3, 2], [1, 4, 3, 0]
    df = spark.createDataFrame([(p, q), (p, p), ([1, 0, 0, 0], [0, 1, 0, 0]), ([0, 0, 0, 0], q)], "p array<long>, q array<long>")
    got = [r[0] for r in df.select(quality.js_distance(df.p, df.q)).collect()]
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda u, v: sum(x * math.log2(x / y) for x, y in zip(u, v) if x)
    mid = [(x + y) / 2 for x, y in zip(a, b)]
    assert got[0] == pytest.approx(math.sqrt((kl(a, mid) + kl(b, mid)) / 2))
    assert got[1] == pytest.approx(0, abs=1e-7) and got[2] == pytest.approx(1) and got[3] is None


def test_empty_and_native(spark):
    assert quality.quality_report(empty_docs(spark), ["doc_id"]).count() == 0
    plan = quality.features(edge_docs(spark), ["doc_id"], "text", "lang", quality.Limits(), quality.COMMON_WORDS)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, prose(80, 1), "en", "mine", 5, "x")], "doc_id long, text string, lang string, kept string, n_words int, __text string")
    row = quality.quality_report(df, ["doc_id", "kept", "n_words", "__text"]).first()
    assert (row["doc_id"], row["kept_"], row["n_words_"], row["__text"]) == (1, "mine", 5, "x") and row["n_words"] == 80 and row["kept"] in (True, False)
