"""MinHash near-duplicates by min-max hashing: every permutation gives its least and its greatest value.

A document's set holds the 64-bit hashes of its distinct word shingles. A permutation of the hashes is one multiplication; both its
minimum and its maximum are kept, and each agrees between two sets with the probability of their Jaccard similarity, so half the permutations
give a signature of the same length, unbiased, and of lower variance as minimum and maximum never miss for the same reason. Bands are
cut from minima alone or from maxima alone: a band's values come from different permutations. With 120 permutations and 6
values a band there are 40 bands; at a similarity of exactly 0.8 a pair shares none of them with probability 5e-6, at 0.85 with 6e-9.

Candidates: documents with equal sets are one class, and only a class's first row goes on. Classes that share a band form
a bucket. Buckets are not paired up: round 0 confirms every member against the bucket's least one, components follow, and only where
a bucket still holds several components do further rounds take more centres (8, 64, ... by a hash of the class) and confirm
them against the members of other components; as soon as the pairs across components are no more than ``LINEAR`` per bucket member, all
of them are taken at once. So every pair of a bucket is confirmed, ruled out or already known to be connected,
and a group of n near copies costs about n confirmations for each of few centres, not n^2. Pairs are ruled out inside the join by a bound
that never errs: the hashes of a set are dealt to ``CELLS`` cells, each element that two sets don't share changes the parity of one
cell, so they differ in at least as many elements as cells. Confirmation counts the
intersection of the full sets (sorted arrays): a centre's set meets its members in portions of ``PORTION`` pairs,
streamed one after another, so no task holds a group.

Equality of shingles is that of 64-bit hashes, equality of sets that of 128-bit digests. Memory of a task: one text, its hashes, and a word
cache of bounded size.

Nulls and odd rows: text without words has an empty set, is linked with nothing and is its own component; fewer words than the shingle give one
shingle of the whole sequence, which differs from every full shingle; repeated rows stay and share a component; null ids take part, a component's id is the smallest
non-null one, null if there is none, and ``kept`` compares null-safe; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, table, written
from ledgerline.llm.components import component_labels
from ledgerline.llm.source_audit import text_terms

SHINGLE = 5
PERCENT = 80
PERMUTATIONS = 120
ROWS = 6  # signature values of a band
CENTRES = 8  # factor by which the centres of a bucket grow per round
LINEAR = 64  # pairs across components per bucket member that one last round looks at
CELLS = 1024  # cells of the parity sketch
ALL = 1 << 34  # more centres than a bucket has members
PORTION = 64  # pairs of one centre that are confirmed one after another
CHUNK = 1 << 11  # hashes that are permuted at once
CACHE = 1 << 19  # words whose hashes a task remembers
BROADCAST_ROWS = 500_000  # of row numbers: about 20 MB
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
#: Bytes of words: A-Z to a-z, ASCII white space to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


class WordHashes(dict):
    """Word to its 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def shingle_set(text: bytes | None, width: int, cache: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    parts = [np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)) for w in text_terms(text or b"", _WORDS)]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = mixed(found * _ODD + words[k:k + n])
    return np.unique(found)


def permutation_constants(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(11)
    draw = lambda: rnd.integers(0, 1 << 32, (permutations, 1), dtype=np.uint32)
    return draw(), draw() | np.uint32(1)


def min_max(found: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a set's hashes under every permutation."""
    flips, factors = constants
    high = (found >> _HALF).astype(np.uint32)
    least = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    greatest = np.zeros(len(flips), np.uint32)
    for at in range(0, len(high), CHUNK):
        values = (high[None, at:at + CHUNK] ^ flips) * factors
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(greatest, values.max(axis=1), out=greatest)
    return least, greatest


def band_keys(least: np.ndarray, greatest: np.ndarray, rows: int) -> np.ndarray:
    """One key per band; bands of minima come first."""
    values = np.concatenate([least.reshape(-1, rows), greatest.reshape(-1, rows)]).astype(np.uint64)
    keys = np.arange(1, len(values) + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys * _ODD + values[:, k])
    return keys.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each cell, as words of 64 bits."""
    counts = np.bincount((found & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(rows: DataFrame, shingle: int, permutations: int, band_rows: int) -> DataFrame:
    """id, rid, n_shingles, digest, bands and parity (null for empty sets) of rows (id, rid, text)."""
    source = rows.select("id", "rid", F.col("text").cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, constants = WordHashes(), permutation_constants(permutations)
        for batch in batches:
            sizes, digests, marks, known = [], [], [], {None: (None, None)}
            for value in batch.column(2):
                found = shingle_set(value.as_py(), shingle, cache)
                digest = hashlib.blake2b(found, digest_size=16).digest() if len(found) else None
                if digest is not None and digest not in known:
                    known[digest] = band_keys(*min_max(found, constants), band_rows), parities(found)
                sizes.append(len(found))
                digests.append(digest)
                marks.append(known[digest])
            lists = [pa.array([m[k] for m in marks], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists],
                                             names=["id", "rid", "n_shingles", "digest", "bands", "parity"])

    shape = source.drop("bytes").withColumns({"n_shingles": F.lit(0).cast("long"), "digest": F.lit(None).cast("binary"),
                                               "bands": F.lit(None).cast("array<long>"), "parity": F.lit(None).cast("array<long>")})
    return source.mapInArrow(run, shape.schema)


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rid and its set, the sorted hashes as bytes."""
    source = rows.select("rid", F.col("text").cast("binary").alias("bytes"))
    ddl = "rid long, hashes binary"
    schema = arrow_schema(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = pa.array([shingle_set(v.as_py(), shingle, cache).tobytes() for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], schema=schema)

    return source.mapInArrow(run, ddl)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    dealt = written(pairs.join(degree, "a").withColumn("portion", F.pmod(F.xxhash64("b"), F.col("portions"))).select("a", "b", "portion"), "dealt")
    members = dealt.join(sets.withColumnRenamed("rid", "b"), "b").select("a", "portion", "b", "hashes")
    centres = dealt.select("a", "portion").distinct().join(sets.withColumnRenamed("rid", "a"), "a").select(
        "a", "portion", F.lit(None).cast("long").alias("b"), "hashes")
    ordered = members.unionByName(centres).repartition("a", "portion").sortWithinPartitions("a", "portion", F.col("b").asc_nulls_first())
    ddl = "a long, b long"
    schema = arrow_schema(pairs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                other = np.frombuffer(value.as_buffer(), np.uint64)
                if b is None:
                    centre = other.copy()
                    continue
                shared = len(np.intersect1d(centre, other, assume_unique=True))
                if 100 * shared >= percent * (len(centre) + len(other) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return ordered.mapInArrow(run, ddl)


def bucket_pairs(members: DataFrame, taken: int, centres: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's centres of this round with members of other components. ``members``: key, rid, size, parity, n, least, label.
    Earlier rounds took the least member and the first ``taken`` by hash: those are confirmed against all others."""
    place = F.pmod(F.xxhash64("rid"), F.lit(1 << 24)) * F.col("n")  # uniform below n * 2^24
    fresh = members.filter((F.col("rid") != F.col("least")) & (place >= taken << 24))
    a = fresh.filter(place < centres << 24).alias("a")
    b = fresh.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & alike("a.size", "b.size", percent)
                   & few_differences(percent))
    return pairs.select(F.least("a.rid", "b.rid").alias("a"), F.greatest("a.rid", "b.rid").alias("b")).distinct()


def alike(a: str, b: str, percent: int) -> Column:
    """Two sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def few_differences(percent: int) -> Column:
    """The parities of a and b leave room for the similarity: of sizes s and t they may differ in (s + t) (100 - p) / (100 + p) elements."""
    words = [F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(CELLS // 64)]
    return (100 + percent) * sum(words[1:], words[0]) <= (100 - percent) * (F.col("a.size") + F.col("b.size"))


def set_links(classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Component labels (node, label) of classes (rid, size, bands, parity) over all confirmed pairs; ``texts``: rid, text."""
    keys = classes.select("rid", "size", F.explode("bands").alias("key"))
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("least"), F.min_by("size", "rid").alias("least_size")).filter("n > 1"), "buckets")
    shared = written(keys.join(sizes, "key"), "shared")
    involved = written(shared.select("rid").distinct(), "involved")
    # texts stay where they are as long as the list of needed rows is small
    few = involved.count() <= BROADCAST_ROWS
    needed = texts.join(F.broadcast(involved) if few else involved, "rid", "left_semi")
    sets = written(shingle_sets(needed, shingle), "sets")

    pairs = shared.filter((F.col("least") < F.col("rid")) & alike("size", "least_size", percent)).select(
        F.col("least").alias("a"), F.col("rid").alias("b")).distinct()
    labels = written(component_labels(confirmed(written(pairs, "pairs"), sets, percent)), "labels")
    taken, centres, size = 0, CENTRES, shared.count()
    while centres <= ALL:
        known = written(shared.join(labels, shared["rid"] == labels["node"], "left").select(
            "key", "rid", "n", "least", F.coalesce("label", "rid").alias("label")), "known")
        parts = known.filter(F.col("n") > taken).groupBy("key", "label").agg(F.count("*").alias("c"))
        open_keys = written(parts.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("square")).select(
            "key", ((F.col("c") * F.col("c") - F.col("square")) / 2).alias("across")).filter("across > 0"), "open")
        across = open_keys.agg(F.sum("across")).first()[0]
        if not across:
            break
        if across <= LINEAR * size:
            centres = ALL
        members = known.join(open_keys.select("key"), "key").join(classes.select("rid", "size", "parity"), "rid")
        links = written(confirmed(written(bucket_pairs(members, taken, centres, percent), "pairs"), sets, percent), "links")
        if not links.isEmpty():
            labels = written(component_labels(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")
        taken, centres = centres, centres * CENTRES
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    permutations: int = PERMUTATIONS, band_rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("rid", F.monotonically_increasing_id()), "texts")
    signed = written(signatures(rows, shingle, permutations, band_rows), "signed")
    sets = signed.filter("digest IS NOT NULL")
    classes = written(sets.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("id").alias("least")), "classes")
    firsts = sets.select("rid", F.col("n_shingles").alias("size"), "bands", "parity").join(classes.select("rid"), "rid", "left_semi")
    labels = set_links(firsts, rows.select("rid", "text"), shingle, percent)
    named = classes.join(labels, classes["rid"] == labels["node"], "left").select("digest", "least", F.coalesce("label", "rid").alias("label"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    members = written(named.select("digest", "label").join(names, "label").select("digest", "component_id"), "members")
    out = sets.join(members, "digest").select("id", "n_shingles", "component_id").unionByName(
        signed.filter("digest IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minmax_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near duplicates: 2-word shingles, 80 percent."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM docs
), classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (SELECT c, n, unnest(s) AS x FROM classes
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes USING (s) LEFT JOIN least_of l USING (c)
"""
