"""SimHash near-duplicates against brute force."""

import itertools
import random
import re

import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import component_labels
from tests.llm.samples import documents, edge_docs, empty_docs


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_against_all_pairs(spark):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for _ in range(250):  # a crowd within a few bits, and chains
        values.add(0x1234567890ABCDEF ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))))
    for v in list(values)[:40]:
        values.add(v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    truth = closure([signed(v) for v in values], lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2)
    for limit in (1, 16, 10_000):  # all by balls, mixed, all by joins
        links = simhash.fingerprint_links(fps, 2, limit)
        labels = {r["node"]: r["label"] for r in component_labels(links).collect()}
        assert {n: labels.get(n, n) for n in truth} == truth


def check(df):
    rows = df.select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [signed(slow_fingerprint(r["text"])) for r in rows]
    label = closure(set(fps), lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2)
    least = {}
    for r, fp in zip(rows, fps):
        if r["doc_id"] is not None:
            least[label[fp]] = min(least.get(label[fp], r["doc_id"]), r["doc_id"])
    assert got == sorted(((r["doc_id"], fp, least.get(label[fp])) for r, fp in zip(rows, fps)), key=str)


def test_edges(spark):
    check(edge_docs(spark))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_documents(spark):
    check(documents(spark))


def test_chain_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1000), (7, 3)], "a long, b long")
    assert {(r["node"], r["label"]) for r in component_labels(links).collect()} == {(k, 0) for k in range(201)}
    assert component_labels(links.limit(0)).count() == 0
