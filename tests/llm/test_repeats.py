"""Repeated passages (words) and repeated strings (bytes) against brute force."""

import collections
import hashlib
import random
import re

import pytest

from ledgerline.llm import prefix_parse, repeats, substring
from tests.llm.samples import documents, edge_docs, empty_docs


def brute(text, count, length, join):
    cover = bytearray(len(text))
    for i in range(len(text) - length + 1):
        if count[join(text[i:i + length])] > 1:
            cover[i:i + length] = b"\1" * length
    kept = [x for x, c in zip(text, cover) if not c]
    rest = b" ".join(kept) if isinstance(text, list) else bytes(kept)
    return len(text), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(rest).hexdigest()


def expected(rows, length, units):
    join = tuple if units is bytes.split else bytes
    texts = [units((t or "").encode()) for _, t in rows]
    count = collections.Counter(join(t[i:i + length]) for t in texts for i in range(len(t) - length + 1))
    return sorted(((i, *brute(t, count, length, join)) for (i, _), t in zip(rows, texts)), key=str)


def planted(seed, letters, gap):
    """Texts glued from shared pieces at random cuts, so repeats start, end and overlap anywhere."""
    rnd = random.Random(seed)
    pieces = [gap.join(rnd.choice(letters) for _ in range(rnd.randint(20, 600))) for _ in range(12)]
    cut = lambda p: p[rnd.randint(0, 100):rnd.randint(100, 900)]
    return [(k, cut(rnd.choice(pieces)) + rnd.choice(["", " ", " zz "]) + cut(rnd.choice(pieces))) for k in range(80)]


CASES = [(substring.remove_repeated_passages, 35, bytes.split, "abcdefgh", " "),
         (prefix_parse.remove_repeated_bytes, 400, bytes, "abcdé ", "")]


@pytest.mark.parametrize("remove,length,units,letters,gap", CASES, ids=["words", "bytes"])
@pytest.mark.parametrize("limit", [2000, 3])  # 3: most anchor keys count as crowded
def test_planted(spark, remove, length, units, letters, gap, limit, monkeypatch):
    monkeypatch.setattr(repeats, "CLASS_LIMIT", limit)
    monkeypatch.setattr(repeats, "HELD_WINDOWS", 50)
    rows = planted(1, letters, gap) + [(None, "a " * 1500), (5, "a" * 3000), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, remove(df).collect()), key=str) == expected(rows, length, units)


@pytest.mark.parametrize("remove,length,units,letters,gap", CASES, ids=["words", "bytes"])
def test_edges_and_documents(spark, remove, length, units, letters, gap):
    for df in (edge_docs(spark), documents(spark)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, remove(df).collect()), key=str) == expected(rows, length, units)
    assert remove(empty_docs(spark)).count() == 0


def test_other_lengths(spark):
    rows = planted(2, "ab", "") + planted(3, "abc", "")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, prefix_parse.remove_repeated_bytes(df, length=64).collect()), key=str)
    assert got == expected(rows, 64, bytes)
