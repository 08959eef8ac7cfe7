"""SimHash near-duplicates: 64-bit fingerprints, linked at a bounded Hamming distance through
deletion-variant signatures.

Fingerprint: 3-word shingles (XXH64, seed 42, unsigned); a bit is 1 if it is set in over half of them.

Links: with ``max_bits`` differing bits allowed, the fingerprint is cut into
``(max_bits + 2) // 2`` segments, so at least one segment of a linked pair differs by one bit at most.
Each distinct fingerprint is indexed under every segment with every one of its bits wiped out
(a one-wildcard variant); an equality join on the variants gives candidates and the full
distance verifies them. A pair that shares many variants is kept at its first one only.

Groups: equal fingerprints are merged before anything is joined, so exact copies cost one row. A variant
shared by more than ``join_limit`` distinct fingerprints isn't joined pairwise. Its members
are grouped by balls instead: each emits every value within ``max_bits // 2`` bits of itself, and two
of them are within ``max_bits`` exactly if they emit a common value (for even ``max_bits``); each
is tied to the least fingerprint of the ball. That finds every link of the group's closure
in linear size, with no cap on partners. Components come from ``ledgerline.llm.components``.

Nulls and odd rows: null or wordless text has fingerprint zero and links like any other; fewer words
than the shingle give one shingle of the whole sequence; repeated rows stay, each with its
component; null ids take part, and a component's id is the smallest non-null one (null if
there is none); an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table, written
from ledgerline.llm.components import component_labels

SHINGLE = 3
MAX_BITS = 2
JOIN_LIMIT = 16
CHUNK = 1 << 16
ROWS_PER_TASK = 2_000_000  # of (fingerprint, variant)
BROADCAST_ROWS = 500_000  # of (key, count): about 20 MB


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed integer; memory is bounded by the word list."""
    import xxhash
    words = text.lower().split() if text else []  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + min(CHUNK, n - at) + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(part)]
        hashes = np.array([digest(s, 42) for s in joined], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n)
    return int(bits.view(">i8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed 64-bit number)."""
    source = docs.select(*keep, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*keep, "fp"])

    return source.mapInArrow(run, source.drop("__text").withColumn("fp", F.lit(0).cast("bigint")).schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = (max_bits + 2) // 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fp: Column, max_bits: int) -> Column:
    """Array of keys: the number of the wiped bit (the slot) above 32 bits that hold the rest of its segment."""
    out = []
    for low, width in segments(max_bits):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        for bit in range(width):
            out.append(part.bitwiseAND(F.lit(~(1 << bit)).cast("bigint")).bitwiseOR(F.lit((low + bit) << 32).cast("bigint")))
    return F.array(*out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_shared_slot(diff: Column, max_bits: int) -> Column:
    """The least slot under which two fingerprints with the XOR ``diff`` meet."""
    found = F.lit(None).cast("int")
    for low, width in reversed(segments(max_bits)):
        part = F.shiftrightunsigned(diff.bitwiseAND(F.lit(_signed(((1 << width) - 1) << low)).cast("bigint")), low)
        slot = F.when(part == 0, F.lit(low)).when(
            F.bit_count(part) == 1, F.lit(low) + F.bit_count(part - 1))
        found = F.coalesce(slot, found)
    return found


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, join_limit: int = JOIN_LIMIT) -> DataFrame:
    """Links (a, b), a < b, over the distinct ``fp`` values of ``fps``, whose closure
    is that of all pairs within ``max_bits`` bits."""
    if max_bits < 2 or max_bits % 2:
        raise ValueError("max_bits must be even and positive")  # the ball radius is half of it
    # fingerprints are few bytes, but each makes many rows: they are dealt out by the rows to come
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() * 64 // ROWS_PER_TASK))
    keys = fps.repartition(parts).select("fp", F.explode(variants(F.col("fp"), max_bits)).alias("key"))
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "variants")
    # few variants are shared: where their table is small it goes to the keys, otherwise both are shuffled
    found = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    shared = written(keys.join(found, "key"), "shared")
    small = shared.filter(F.col("n") <= join_limit)
    a, b = small.alias("a"), small.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key"))
                   & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= max_bits)
                   & (first_shared_slot(diff, max_bits) == F.shiftrightunsigned("a.key", 32)))
    joined = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = shared.filter(F.col("n") > join_limit).select("fp").distinct()
    return joined.unionByName(ball_links(crowded, max_bits // 2))


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links that tie fingerprints with a common value in their balls of ``radius`` bits."""
    ball = F.array(F.col("fp"))
    for _ in range(radius):
        flips = F.flatten(F.transform(ball, lambda x: F.array(
            x, *[x.bitwiseXOR(F.lit(_signed(1 << k)).cast("bigint")) for k in range(64)])))
        ball = F.array_distinct(flips) if radius > 1 else flips
    points = fps.select("fp", F.explode(ball).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top"))
    least = least.filter(F.col("a") < F.col("top")).select("point", "a")
    return points.join(least, "point").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, join_limit: int = JOIN_LIMIT) -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id."""
    marked = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                      ["doc_id"], "text", shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = written(fingerprint_links(distinct.select("fp"), max_bits, join_limit), "links")
    labels = component_labels(links)  # node, label; only linked fingerprints
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    members = written(named.select("fp", "label").join(names, "label").select("fp", "component_id"), "members")
    return marked.join(members, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
