"""URL vocabulary and Wu-Manber decontamination."""

import hashlib
import random
import re

from ledgerline.llm import decontaminate, url_filter
from tests.llm.samples import edge_docs, empty_docs


def test_url_rules_and_vocabulary(spark):
    urls = [("http://a.example.com/en/x", "example.com/en/", "block"), ("http://WWW.Example.com/en/x", "www.example.com/en/", "allow"),
            ("https://b.net/es/1", "net/es/", "block"), ("https://b.net/es", None, "allow"), ("http://example.com?x=/en/", None, "allow"),
            ("http://x.org/free-porn-now", None, "block"), ("http://x.org/pornography", None, "allow"),
            ("http://x.org/casino?poker", None, "block"), ("http://x.org/casino/casino", None, "allow"),
            ("http://notcom/", None, "allow"), ("no scheme", None, "allow"), ("", None, "allow"), (None, None, "allow"),
            ("http://com/", "com/", "allow")]
    df = spark.createDataFrame([(u, "h", "p", k) for k, (u, _, _) in enumerate(urls)], "url string, host string, path string, k int")
    got = {r["k"]: r for r in url_filter.judge_urls(df).select("k", "host", "path", "url_verdict").collect()}
    for k, (url, rule, verdict) in enumerate(urls):
        assert (got[k]["url_verdict"]["rule"], got[k]["url_verdict"]["verdict"]) == (rule, verdict), url
        assert got[k]["host"] == "h"  # clashing names pass through
    assert got[1]["url_verdict"]["host"] == "www.example.com" and got[10]["url_verdict"]["host"] == ""
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_soft_limit_and_empty_vocabulary(spark):
    df = spark.createDataFrame([("http://x.org/casino/poker",)], "url string")
    verdict = lambda **k: url_filter.judge_urls(df, **k).first()["url_verdict"]["verdict"]
    assert verdict(soft_limit=3) == "allow" and verdict(strict=(), soft=()) == "allow"


def brute(text, strings):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for s, items in strings.items():
        for i in range(len(w) - len(s) + 1):
            if tuple(w[i:i + len(s)]) == s:
                hit |= set(range(i, i + len(s)))
                ids |= items
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_wu_manber_against_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    items = [(k, text(rnd.choice([1, 4, 9, 10, 11, 14]))) for k in range(12)] + [(20, None), (21, ""), (22, "..."), (None, "Zz yy")]
    docs = [(k, text(rnd.randint(0, 120))) for k in range(40)] + [(90, "zz-YY"), (91, None), (91, None), (92, "É zz yy é")]
    strings = {}
    for k, t in items:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for i in range(max(1, len(w) - 9) if w else 0):
            strings.setdefault(tuple(w[i:i + 10]), set()).add("" if k is None else str(k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, leaks string, row string").drop("leaks")
    for part_bytes in (1 << 20, 64):  # one part, and several passes
        out = decontaminate.mark_contamination(df, bench, part_bytes=part_bytes).select("doc_id", "text", *decontaminate.digest_columns())
        got = sorted(tuple(r) for r in out.fillna("").collect())
        assert got == sorted((i, t or "", *brute(t, strings)) for i, t in docs)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "w1x of the")], "item_id long, text string")
    docs = edge_docs(spark)
    assert decontaminate.mark_contamination(docs, bench).count() == docs.count()
    assert decontaminate.mark_contamination(empty_docs(spark), bench).count() == 0
    none = decontaminate.mark_contamination(docs, bench.limit(0)).select(*decontaminate.digest_columns())
    assert none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_long_and_equal_items(spark, monkeypatch):
    """An item longer than a piece, thousands of equal items, repeated rows, and parts that hold one piece each."""
    rnd = random.Random(5)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 50)
    words = [f"w{rnd.randrange(400)}" for _ in range(700)]
    same = " ".join(f"same{k}" for k in range(12))
    items = [("long", " ".join(words)), ("long", " ".join(words)), *((f"e{k:05d}", same) for k in range(10_000)), ("short", "only three words")]
    docs = [(0, " ".join(words[40:65])), (1, " ".join(words[690:])), (2, same.upper() + "!"), (3, " ".join(words)), (4, "Only, three; words"), (5, "w1 " * 500), (6, None)]
    bench, df = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {0: (25, {"long"}), 1: (10, {"long"}), 2: (12, {f"e{k:05d}" for k in range(10_000)}), 3: (700, {"long"}), 4: (3, {"short"}), 5: (0, set()), 6: (0, set())}
    for part_bytes in (1 << 20, 200_000):
        rows = decontaminate.mark_contamination(df, bench, part_bytes=part_bytes).select("doc_id", "leaks").collect()
        got = {r["doc_id"]: (sum(s["end"] - s["start"] for s in r["leaks"]["spans"]), set(r["leaks"]["items"])) for r in rows}
        assert got == want


def test_parts_are_checked(spark):
    from pyspark.sql import functions as F
    bench = spark.createDataFrame([(k, "x " * (500 if k % 7 else 4000) + str(k)) for k in range(60)], "item_id long, text string")
    parts = decontaminate.benchmark_parts(bench, "item_id", "text", 10, 20_000)
    sizes = [p.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for p in parts]
    assert len(parts) > 2 and max(sizes) <= 20_000 and sum(sizes) == bench.agg(F.sum(F.length("text"))).first()[0]


def test_tables_of_a_part_stay_small():
    rnd = random.Random(6)
    text = " ".join(f"{rnd.randrange(50_000):x}" for _ in range(200_000)).encode()
    tables = decontaminate.WuManber([("a", text)])
    assert tables.nbytes() < 40 * len(text)
    at = rnd.randrange(199_000)
    words = decontaminate.item_words(text)
    assert (0, 10, [0]) in tables.search(words[at:at + 10]) and not tables.search(words[at:at + 9])
