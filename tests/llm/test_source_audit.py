"""Source divergence audit against brute force."""

import collections
import itertools
import random
import re

import numpy as np

from ledgerline.llm import source_audit
from tests.llm.samples import documents, edge_docs, empty_docs, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow_audit(rows, min_docs=10):
    docs = [(r["lang"] or "", r["source"] or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = collections.Counter(t for _, _, w in mine for t in set(w))
        kept = {t for t, n in in_docs.items() if n >= min_docs}

        def shares(rows):
            n = collections.Counter(t for _, _, w in rows for t in w if t in kept)
            total = sum(n.values())
            return n, {t: 1 + 10 ** 9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) * (p - q) // (p + q)

        _, whole = shares(mine)
        sources = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (n, p) in sources.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, (_, q) in sources.items() if o != s]
            terms = [(t, f(p[t], whole[t])) for t in kept if n[t] > 0 and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:10])):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def check(docs, min_docs=10):
    got = source_audit.divergence_audit(docs, min_docs=min_docs)
    assert sorted(tuple(r) for r in got.collect()) == slow_audit(docs.collect(), min_docs)


def test_edges(spark):
    for least in (1, 3, 10):
        check(edge_docs(spark), least)
    assert source_audit.divergence_audit(empty_docs(spark)).count() == 0


def test_documents(spark):
    check(documents(spark))


def test_shared_paths(spark):
    """Few distinct counts over many sources: rows share long paths, equal rows merge, and one source holds most rows."""
    rnd = random.Random(3)
    rows = [(f"s{min(rnd.randrange(12), rnd.randrange(12)):02d}", " ".join(f"term{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(4))}" for _ in range(6)))
            for _ in range(400)] + [("s00", prose(30, k)) for k in range(200)] + [("Ünï", "term Große GROSSE große"), (None, None)]
    docs = spark.createDataFrame([(t, "en", s) for s, t in rows], "text string, lang string, source string").repartition(5)
    check(docs, 4)


def test_terms_of_a_long_text():
    """Pieces are cut between terms, also where a term is longer than a piece."""
    rnd = random.Random(4)
    text = " ".join("x" * rnd.randrange(1, 40) for _ in range(300)).encode()
    for piece in (1, 7, 64, 10_000):
        source_audit.PIECE, before = piece, source_audit.PIECE
        try:
            assert list(itertools.chain(*source_audit.text_terms(text))) == text.split()
            assert list(itertools.chain(*source_audit.text_terms(b"a1B c" + text))) == (b"a b c" + text).split()
        finally:
            source_audit.PIECE = before


def test_partial_counts_are_sent_in_parts(spark):
    before, source_audit.HELD = source_audit.HELD, 50
    try:
        check(documents(spark))
        source_audit.HELD = 3000
        check(documents(spark))
    finally:
        source_audit.HELD = before


def test_tree_shares_nodes():
    """Three rows over sources 0 to 3, two of them with a common prefix; every node once, multiplicities summed."""
    rows = [[(0, 5), (1, 7)], [(0, 5), (1, 7), (3, 2)], [(0, 5), (2, 7)], [(1, 4)]]
    offsets = np.cumsum([0] + [len(r) for r in rows])
    source, p = (np.array([e[k] for r in rows for e in r]) for k in (0, 1))
    entries, parent, depth, weight = source_audit.tree_nodes(offsets, source, p, np.array([10, 1, 100, 5]))
    nodes = [(int(source[e]), int(p[e]), int(a), int(d), int(w)) for e, a, d, w in zip(entries, parent, depth, weight)]
    assert nodes == [(0, 5, -1, 0, 111), (1, 7, 0, 1, 11), (3, 2, 1, 2, 1), (2, 7, 0, 1, 100), (1, 4, -1, 0, 5)]


def test_tree_against_every_row():
    rnd = random.Random(12)
    rows = sorted({tuple((s, rnd.randrange(1, 4)) for s in sorted(rnd.sample(range(6), rnd.randint(1, 5)))) for _ in range(300)})
    m, zero = [rnd.randrange(1, 50) for _ in rows], [rnd.randrange(1, 9) for _ in range(6)]
    want = collections.Counter()

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    for row, k in zip(rows, m):
        for (a, p), (b, q) in itertools.combinations(row, 2):
            want[a * 6 + b] += k * (f(1000 * p, 1000 * q) - f(1000 * p, zero[b]) - f(zero[a], 1000 * q) + f(zero[a], zero[b]))
    offsets = np.cumsum([0] + [len(r) for r in rows])
    source = np.array([e[0] for r in rows for e in r])
    p = np.array([1000 * e[1] for r in rows for e in r])
    got = source_audit.batch_corrections(offsets, source, p, np.array(zero)[source], np.array(m), 6)
    assert got == dict(want)
