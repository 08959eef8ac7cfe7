"""Filter interaction audit against brute force: every order applied to every document."""

import itertools
import re

import numpy as np

from ledgerline.llm import filter_audit
from tests.llm.samples import documents, edge_docs, empty_docs, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def failures(rows):
    """Per row the set of failed filters, by the plain rules."""
    out = []
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(w) < 50 else set()
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if r["doc_id"] is not None and any((o["text"] or "") == t and o["doc_id"] is not None and o["doc_id"] < r["doc_id"] for o in rows):
            fails.add("E")
        out.append(fails)
    return out


def slow_audit(rows, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    fails = failures(rows)
    out, shapley = [], {}
    for part in {r["source"] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, fails) if (r["source"] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                redundant = sum(letter in f for _, f in mine) - len(removed)
                left = [x for x in left if letter not in x[1]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
                out.append((part, "".join(order), step, len(left), len(removed), redundant, sum(f == {letter} for _, f in mine),
                            sum(r["doc_id"] in good for r, _ in removed), sum(r["doc_id"] in toxic for r, _ in removed)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def check(docs, labels):
    got = filter_audit.interaction_audit(docs, labels)
    names = ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == slow_audit(docs.collect(), labels.collect())


def test_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0, "t"), (5, 1, 1, "t"), (5, 0, 0, "t"), (9, None, 1, "t"), (None, 1, 1, "t"), (16, 1, None, "t")], LABELS)
    docs = edge_docs(spark)
    check(docs, labels)
    check(docs, labels.limit(0))
    assert filter_audit.interaction_audit(empty_docs(spark), labels).count() == 0


def test_repeated_texts_and_ids(spark):
    """Copies over sources, ids that repeat with other sources, a text that most rows share."""
    same, other = prose(80, 1), prose(80, 2) + " $"
    rows = [(k, same, f"s{k % 3}") for k in range(40)] + [(3, other, "s0"), (3, other, "s1"), (7, other, "s1"), (3, other, "s1"), (0, same, None),
            (None, same, "s2"), (None, other, None), (50, "One TWO", "s0"), (51, "a " * 60, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check(docs, spark.createDataFrame([(k, k % 2, int(k % 5 == 0), "") for k in range(40)], LABELS))


def test_documents(spark):
    docs = documents(spark).select("doc_id", "text", "source").limit(90)
    check(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_min_plus():
    a, b = np.array([[0, 9], [4, 2]]), np.array([[5, 1], [3, 8]])
    assert filter_audit.min_plus(a, b).tolist() == [[5, 1], [5, 5]]
