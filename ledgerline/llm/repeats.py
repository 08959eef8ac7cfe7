"""Repeated fixed-length strings over a whole corpus: the Spark plan shared by the word and the byte operator.

A *window* is ``length`` consecutive units (words or bytes) of one document. The plan finds every
window whose content also starts anywhere else, and returns the covered units per document. What the
units are, and how windows find an anchor, is the business of a ``Parser``:

* every window start ``p`` has one anchor, chosen by the window's content alone, so equal windows have equal
  anchors at equal offsets; the windows of one anchor are a range of starts;
* an anchor has a key (of content inside each of its windows). Equal windows have equal keys.

Steps, each a written table in the shared folder:

1. anchors: one row per anchor; those whose key occurs twice are *seeds*;
2. contexts: for each seed the string spanned by all its windows; where that string occurs twice, all its windows
   are repeated at once (this settles the inside of long repeats, one row per anchor, not per unit);
3. edges: where a context occurs once, its windows are compared with those of the other contexts of the same anchor
   key (one representative per repeated context is enough). The contexts' texts, not their windows, are sent to
   the key's task; a key with more than ``CLASS_LIMIT`` different contexts is dealt out window by window instead.

Skew and growth: every comparison is by equal fingerprints (96 bits), never by pairs. Each Arrow batch first compares
its own rows and sends one row per distinct string, so a string found in a third of all documents costs one row
per batch, not one per document. Texts move only for documents that have seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, written

ASK, MANY, KNOWN = 0, 1, 2  # one occurrence, needs an answer; stands for several; settled in its batch
#: Contexts of one anchor key that meet in a task, and windows held there before they are compared. A context has
#: at most 192 windows (bytes) or 26 (words), so the largest key holds 1.5 million of them: about 120 MB
#: with the copies for sorting, and about a second's work.
CLASS_LIMIT, HELD_WINDOWS = 8000, 500_000
BODIES = "rid bigint, cls bigint, lo int, hi int, many boolean, crowd boolean, body binary"
ROWS = "rid bigint, lo int, hi int, key bigint, chk int, kind tinyint, cls bigint"


class Parsed(Protocol):
    """One parsed document."""

    anchors: np.ndarray  # positions, ascending
    lo: np.ndarray  # first window start of each anchor
    hi: np.ndarray  # last window start of each anchor

    def keys(self) -> np.ndarray: ...
    def limits(self, seeds: np.ndarray) -> np.ndarray: ...
    def strings(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class Parser(NamedTuple):
    """``parse(text, anchors wanted)`` gives a Parsed document, ``cut(text, spans)`` the result columns,
    ``slices(text, ranges)`` the texts of unit ranges."""

    length: int
    parse: Callable[[memoryview, bool], Parsed]
    cut: Callable[[bytes, list], tuple[int, int, bytes]]
    slices: Callable[[memoryview, list], list[bytes]]


def combined(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, chk: np.ndarray, cls: np.ndarray,
             many: np.ndarray, runs: bool) -> dict[str, np.ndarray]:
    """Compare the rows of a batch with each other. A string found once goes on as it is; one found
    again settles all its rows and goes on as one row that stands for many. ``runs`` merges settled
    neighbours (consecutive ``lo`` of one document) into one row."""
    n = len(rid)
    if not n:
        return {}
    order = np.lexsort((chk, key))
    k, c = key[order], chk[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group, weights=np.where(many[order], 2, 1)).astype(np.int64)
    again = size[group] > 1
    first = order[new]
    sent = np.where(size > 1, MANY, ASK).astype(np.int8)
    settled = np.sort(order[again & ~many[order]])
    s_rid, s_lo, s_hi = rid[settled], lo[settled], hi[settled]
    if runs and len(settled):
        start = np.ones(len(settled), bool)
        start[1:] = (s_rid[1:] != s_rid[:-1]) | (s_lo[1:] != s_lo[:-1] + 1)
        at = np.flatnonzero(start)
        s_rid, s_lo, s_hi = s_rid[at], s_lo[at], s_lo[np.append(at[1:], len(settled)) - 1]
    zeros = np.zeros(len(s_rid), np.int64)
    return {"rid": np.concatenate([rid[first], s_rid]), "lo": np.concatenate([lo[first], s_lo]).astype(np.int32),
            "hi": np.concatenate([hi[first], s_hi]).astype(np.int32), "key": np.concatenate([key[first], zeros]),
            "chk": np.concatenate([chk[first], zeros.astype(np.int32)]),
            "kind": np.concatenate([sent, np.full(len(s_rid), KNOWN, np.int8)]),
            "cls": np.concatenate([cls[first], zeros])}


def emitting(per_doc: Callable, target: pa.Schema, runs: bool) -> Callable:
    """A mapInArrow function: ``per_doc(row) -> (lo, hi, key, chk, cls, many)`` arrays, combined by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[] for _ in range(7)]
            rids = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                found = per_doc(*(column[i] for column in batch.columns[1:]))
                if found is not None and len(found[0]):
                    for part, values in zip(parts, (np.full(len(found[0]), rids[i]), *found)):
                        part.append(values)
            if parts[0]:
                rid, lo, hi, key, chk, cls, many = map(np.concatenate, parts)
                out = combined(rid, lo, hi, key, chk, cls, many, runs)
                size = len(out["rid"])
                for at in range(0, size, 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name][at:at + (1 << 16)], f.type) for f in target], schema=target)

    return run


def view(value: pa.BinaryScalar) -> memoryview:
    buffer = value.as_buffer()
    return memoryview(b"") if buffer is None else memoryview(buffer)


def occurrences(rows: DataFrame) -> DataFrame:
    """The rows sent on, with ``n``: how often their string occurs (a row that stands for many counts two).
    A string has one row per batch at most, so the groups of this window stay small."""
    sent = rows.filter(F.col("kind") != KNOWN)
    same = Window.partitionBy("key", "chk")
    return sent.withColumn("n", F.sum(F.when(F.col("kind") == MANY, 2).otherwise(1)).over(same))


def settled(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """(rid, lo, hi) of everything known to repeat."""
    known = rows.filter(F.col("kind") == KNOWN).select("rid", "lo", "hi")
    return known.unionByName(seen.filter((F.col("kind") == ASK) & (F.col("n") > 1)).select("rid", "lo", "hi"))


def by_document(spans: DataFrame, name: str, *columns: str) -> DataFrame:
    return spans.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias(name))


def remove_repeats(docs: DataFrame, doc_id: str, text: str, parser: Parser, n_units: Column, full_digest: Column) -> DataFrame:
    """One row per input row: doc_id, n (units), n_removed, n_spans, kept_sha256.

    ``n_units`` and ``full_digest`` are column expressions over the binary column ``text``, for documents that keep everything.
    """
    spark = docs.sparkSession
    length, parse, cut, cutter = parser
    target = arrow_schema(spark, ROWS)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumn("rid", F.monotonically_increasing_id())
    texts = written(rows.select("rid", "doc_id", n_units.alias("n"), full_digest.alias("sha"), "text"), "texts")

    def anchors(value):
        parsed = parse(view(value), True)
        if parsed is None:
            return None
        at = np.arange(len(parsed.anchors), dtype=np.int32)
        zero = np.zeros(len(at), np.int64)
        return at, at, parsed.keys(), zero.astype(np.int32), zero, np.zeros(len(at), bool)

    found = written(texts.filter(F.octet_length("text") >= length).select("rid", "text").mapInArrow(
        emitting(anchors, target, True), ROWS), "anchors")
    seeds = by_document(settled(found, occurrences(found)), "seeds", "lo", "hi")
    seeded = written(texts.select("rid", "text").join(seeds, "rid"), "seeded")

    def contexts(value, listed):
        parsed = parse(view(value), True)
        flags = np.zeros(len(parsed.anchors) + 1, np.int32)
        lows, highs = ranges(listed, "lo", "hi")
        np.add.at(flags, lows, 1)
        np.add.at(flags, highs + 1, -1)
        is_seed = np.cumsum(flags[:-1]) > 0
        hi = np.minimum(parsed.hi, parsed.limits(is_seed))
        use = np.flatnonzero(is_seed & (hi >= parsed.lo))
        lo, hi = parsed.lo[use], hi[use]
        key, chk = parsed.strings(lo, hi + length, parsed.anchors[use] - lo)
        return lo, hi, key, chk, parsed.keys()[use], np.zeros(len(use), bool)

    wide = written(seeded.select("rid", "text", "seeds").mapInArrow(emitting(contexts, target, False), ROWS), "contexts")
    same = Window.partitionBy("key", "chk").orderBy("rid", "lo")
    seen = written(occurrences(wide).withColumn("k", F.row_number().over(same)), "seen")
    # edges: contexts that occur once, and one representative of each other context with the same anchor key
    single = seen.filter((F.col("kind") == ASK) & (F.col("n") == 1))
    asked = written(single.select("cls").distinct(), "asked")
    others = seen.filter((F.col("n") > 1) & (F.col("k") == 1)).join(asked, "cls", "left_semi")
    edges = written(single.select("cls", "rid", "lo", "hi", F.lit(False).alias("many")).unionByName(
        others.select("cls", "rid", "lo", "hi", F.lit(True).alias("many"))), "edges")
    crowds = written(edges.groupBy("cls").count().filter(F.col("count") > CLASS_LIMIT).select("cls", F.lit(True).alias("crowd")), "crowds")
    listed = by_document(edges.join(crowds, "cls", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))),
                         "edges", "cls", "lo", "hi", "many", "crowd")
    bodies_schema = arrow_schema(spark, BODIES)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_pylist()
            for i, rid in enumerate(rids):
                rows = batch.column(2)[i].as_py()
                if not rows:
                    continue
                slices = cutter(view(batch.column(1)[i]), [(r["lo"], r["hi"] + length) for r in rows])
                columns = [pa.array([r[name] for r in rows], bodies_schema.field(name).type) for name in ("cls", "lo", "hi", "many", "crowd")]
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(rows), pa.int64()), *columns, pa.array(slices, pa.binary())], schema=bodies_schema)

    body = written(seeded.select("rid", "text").join(listed, "rid").select("rid", "text", "edges").mapInArrow(bodies, BODIES), "bodies")

    def windows_of(value, lo: int, hi: int, many: bool):
        n = hi - lo + 1
        starts = np.arange(n)
        key, chk = parse(view(value), False).strings(starts, starts + length, np.zeros(n, np.int64))
        at = (starts + lo).astype(np.int32)
        return at, at, key, chk, np.zeros(n, np.int64), np.full(n, many)

    # an anchor key's contexts meet in one task, sorted, and their windows are compared there ...
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for cls, rid, lo, hi, many, value in zip(*(batch.column(k) for k in range(6))):
                cls = cls.as_py()
                if cls != last and size >= HELD_WINDOWS:
                    yield known(held)
                    held, size = [], 0
                last = cls
                found = windows_of(value, lo.as_py(), hi.as_py(), many.as_py())
                held.append((np.full(len(found[0]), rid.as_py()), *found))
                size += len(found[0])
        if held:
            yield known(held)

    def known(held: list[tuple]) -> pa.RecordBatch:
        out = combined(*map(np.concatenate, zip(*held)), True)
        at = out["kind"] == KNOWN
        return pa.RecordBatch.from_arrays([pa.array(out[name][at], t) for name, t in (("rid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))],
                                          names=["rid", "lo", "hi"])

    near = body.filter(~F.col("crowd")).repartition("cls").sortWithinPartitions("cls").select("cls", "rid", "lo", "hi", "many", "body").mapInArrow(
        compare, "rid bigint, lo int, hi int")

    # ... but those of a key with very many contexts are dealt out window by window
    def windows(lo, hi, many, value):
        return windows_of(value, lo.as_py(), hi.as_py(), many.as_py())

    narrow = written(body.filter("crowd").select("rid", "lo", "hi", "many", "body").mapInArrow(emitting(windows, target, True), ROWS), "windows")
    spans = written(settled(wide, seen).unionByName(near).unionByName(settled(narrow, occurrences(narrow))), "settled")
    spans = by_document(spans, "spans", "lo", "hi")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, listed in zip(batch.column(1), batch.column(2)):
                lows, highs = ranges(listed, "lo", "hi")
                out.append(cut(value.as_py(), covered(lows, highs + length)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                names=["rid", "n_removed", "n_spans", "kept"])

    less = seeded.select("rid", "text").join(spans, "rid").select("rid", "text", "spans").mapInArrow(
        removed, "rid bigint, n_removed bigint, n_spans bigint, kept string")
    less = written(less, "removed")
    return texts.select("rid", "doc_id", "n", "sha").join(less, "rid", "left").select(
        "doc_id", "n", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def ranges(listed: pa.ListScalar, *names: str) -> list[np.ndarray]:
    """Integer fields of a list-of-structs value."""
    return [listed.values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint half-open runs covered by the given ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return list(zip(starts[at].tolist(), ends[last].tolist()))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the position of the least value among the next ``width`` (leftmost of equals),
    by doubling, in blocks of bounded size. The low bits of a value give way to its position."""
    n = len(values) - width + 1
    out = np.empty(max(n, 0), np.int64)
    block, bits = (1 << 18) - width, np.uint64(18)
    for at in range(0, n, block):
        part = values[at:min(at + block, n) + width - 1]
        packed = ((part >> bits) << bits) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            packed = np.minimum(packed[:-span], packed[span:])
            span *= 2
        if span < width:
            rest = width - span
            packed = np.minimum(packed[:len(packed) - rest], packed[rest:])
        out[at:at + len(packed)] = (packed & np.uint64((1 << 18) - 1)).astype(np.int64) + at
    return out


def anchor_ranges(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, lo, hi) from the anchor position of each window start (non-decreasing)."""
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    lo = np.flatnonzero(new)
    return chosen[lo], lo, np.append(lo[1:], len(chosen)) - 1


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
