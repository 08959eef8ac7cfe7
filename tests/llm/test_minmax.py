"""Min-max hashing near-duplicates against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from ledgerline.llm import minmax_hash
from tests.llm.samples import documents, edge_docs, empty_docs, prose
from tests.llm.test_simhash import closure


def slow_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def slow_groups(rows, width, percent=80):
    sets = [slow_set(r["text"], width) for r in rows]
    distinct = list({s for s in sets if s})
    label = closure(range(len(distinct)), lambda a, b: 100 * len(distinct[a] & distinct[b]) >= percent * len(distinct[a] | distinct[b]))
    of = {s: label[i] for i, s in enumerate(distinct)}
    least = {}
    for r, s in zip(rows, sets):
        if s and r["doc_id"] is not None:
            least[of[s]] = min(least.get(of[s], r["doc_id"]), r["doc_id"])
    names = [least.get(of[s]) if s else r["doc_id"] for r, s in zip(rows, sets)]
    return sorted(((r["doc_id"], len(s), c, r["doc_id"] == c) for r, s, c in zip(rows, sets, names)), key=str)


def check(df, width):
    got = sorted((tuple(r) for r in minmax_hash.near_duplicates(df, shingle=width).collect()), key=str)
    assert got == slow_groups(df.collect(), width)


def test_edges(spark):
    check(edge_docs(spark), 2)
    check(edge_docs(spark), 5)
    assert minmax_hash.near_duplicates(empty_docs(spark)).count() == 0


def test_documents(spark):
    check(documents(spark), 2)


def test_large_groups(spark):
    """Copies with independent changes: many pairs of a group lie near the threshold, and groups overlap in chains."""
    rnd = random.Random(8)
    texts = []
    for g in range(3):
        base = prose(120, 50 + g).split()
        for _ in range(70):
            w = list(base)
            for _ in range(rnd.randint(1, 7)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    chain = prose(100, 60).split()
    for k in range(30):
        chain[k * 3] = f"link{k}"
        texts.append(" ".join(chain))
    texts += ["one", "ONE", "two words", "Two  Words", "two words more", texts[0], texts[0].upper()]
    check(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(5), 2)


@pytest.mark.parametrize("linear", [4, 0])  # 0: rounds of ever more centres until all have been
def test_rounds_compare_every_pair_of_a_bucket(spark, monkeypatch, linear):
    """One bucket, a least member that is like no other: the others meet in later rounds."""
    monkeypatch.setattr(minmax_hash, "LINEAR", linear)
    monkeypatch.setattr(minmax_hash, "CENTRES", 3)
    base = [prose(150, 70 + g).split() for g in range(6)]
    texts = [prose(150, 90)] + [" ".join(b[:-k] + [f"z{k}"] * k) for b in base for k in range(1, 6)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string")
    sets = {i: slow_set(t, 2) for i, t in enumerate(texts)}
    cache = minmax_hash.WordHashes()
    parity = {i: minmax_hash.parities(minmax_hash.shingle_set(t.encode(), 2, cache)).tolist() for i, t in enumerate(texts)}
    classes = spark.createDataFrame([(i, len(sets[i]), [1, 2], parity[i]) for i in sets], "rid long, size long, bands array<long>, parity array<long>")
    labels = {r["node"]: r["label"] for r in minmax_hash.set_links(classes, rows, 2, 80).collect()}
    truth = closure(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {i: labels.get(i, i) for i in sets} == truth and len(set(truth.values())) == 7


def test_signature_is_unbiased_and_varies_less():
    """Share of agreeing values over many pairs of sets, against the similarity and the variance of independent values."""
    rnd = np.random.default_rng(1)
    constants = minmax_hash.permutation_constants(minmax_hash.PERMUTATIONS)
    for n, shared in ((6, 4), (50, 40), (400, 200)):
        found = []
        for _ in range(600):
            x = rnd.integers(0, 1 << 64, 2 * n - shared, dtype=np.uint64)
            a, b = (minmax_hash.min_max(np.sort(s), constants) for s in (x[:n], x[n - shared:]))
            found.append(np.mean(np.concatenate([a[0] == b[0], a[1] == b[1]])))
        similarity = shared / (2 * n - shared)
        spread = similarity * (1 - similarity) / (2 * minmax_hash.PERMUTATIONS)
        assert abs(np.mean(found) - similarity) < 4 * (spread / 600) ** 0.5
        assert np.var(found) < 1.2 * spread


def test_bands_miss_rarely():
    """At a similarity of 0.8 a pair without a common band is rarer than 5e-4."""
    rnd = np.random.default_rng(2)
    constants = minmax_hash.permutation_constants(minmax_hash.PERMUTATIONS)
    missed = 0
    for _ in range(4000):
        x = rnd.integers(0, 1 << 64, 100, dtype=np.uint64)
        a, b = (minmax_hash.band_keys(*minmax_hash.min_max(s, constants), minmax_hash.ROWS) for s in (x[:90], x[10:]))
        missed += not (a == b).any()
    assert missed <= 2


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(5)
    for n, shared in ((5, 3), (300, 280), (300, 200), (4000, 3500)):
        x = rnd.integers(0, 1 << 64, 2 * n - shared, dtype=np.uint64)
        a, b = (np.unpackbits(minmax_hash.parities(s).view(np.uint8)).sum() for s in (x[:n], x[n - shared:]))
        differ = np.unpackbits((minmax_hash.parities(x[:n]) ^ minmax_hash.parities(x[n - shared:])).view(np.uint8)).sum()
        assert a <= n and b <= n and differ <= 2 * (n - shared) and (n > 1000 or differ > 1.2 * (n - shared))


def test_long_text_sets():
    cache = minmax_hash.WordHashes()
    words = prose(5000, 3).split()
    found = minmax_hash.shingle_set(" \n".join(words).encode(), 2, cache)
    assert len(found) == len(slow_set(" ".join(words), 2))
    assert (np.diff(found.astype(object)) > 0).all()
    assert len(list(itertools.islice(minmax_hash.text_terms(b"x " * 3_000_000, minmax_hash._WORDS), 5))) >= 3
