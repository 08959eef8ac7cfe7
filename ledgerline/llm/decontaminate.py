"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Every ``window`` consecutive words of a benchmark item form a test string (an item with fewer words
is one test string). The alphabet is the word, coded as a number. For each string length ``m`` there is a shift table
over hashes of blocks of ``b`` words: a block that ends no prefix of any string lets the search jump
``m - b + 1`` words ahead; a block with shift zero selects by its hash the strings that
end (within ``m`` words) in it, and direct comparison of the words confirms an occurrence. A test string is a place in one array of
all item words, so a table takes about 50 bytes per string beside its vocabulary.

Size rules: long items are cut into overlapping pieces of at most ``PIECE_WORDS`` words, equal pieces of one item id are taken once, and the pieces are
handed to the tasks in parts of at most ``part_bytes`` of text; the size of every part is checked before anything is collected. One
part is the rule; more parts make more passes over the documents, each from a written table, and a part's broadcast is
given up after its pass, so no broadcast grows with the benchmark. A worker process builds the tables of a part once.

Nulls and odd rows: null text (document or item) has no words; items without words select nothing;
equal windows in several items count for each item; repeated documents are searched row by row;
an empty benchmark leaves every document clean. Null item ids are reported as the empty string.
Document columns pass through, and the results arrive in one struct column of the caller's naming.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ledgerline.llm.common import table, written

WINDOW = 10
PART_BYTES = 8 << 20
PIECE_WORDS = 20_000
#: Words of lower-cased text: runs of a-z, 0-9 and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased (bytes.lower() touches only ASCII), then split into words; UTF-8 bytes beyond
    ASCII are all word bytes, so the split is the same on bytes as on characters."""
    return WORD.findall(text.lower()) if text else []


_ODD, _MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def block_hashes(words: np.ndarray, b: int) -> np.ndarray:
    """A 64-bit hash of every ``b`` consecutive words."""
    n = max(0, len(words) - b + 1)
    out = np.full(n, b, np.uint64)
    for k in range(b):
        out = (out ^ words[k:k + n].astype(np.uint64)) * _ODD
        out = (out ^ (out >> _HALF)) * _MIX
    return out ^ (out >> _HALF)


class Strings(NamedTuple):
    """The test strings of one length, sorted by the hashes of their last block and of the whole string."""
    m: int
    b: int
    shift: np.ndarray  # by the low bits of a block's hash: words to go on
    suffix: np.ndarray
    whole: np.ndarray
    place: np.ndarray  # first word in the array of all item words


class WuManber:
    """Shift tables and suffix-hash buckets for the test strings of one benchmark part."""

    def __init__(self, items: list[tuple], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        coded, code = [np.zeros(0, np.int32)], self.vocabulary
        for _, text in items:
            w = item_words(text)
            coded.append(np.fromiter((code.setdefault(x, len(code) + 1) for x in w), np.int32, len(w)))
        self.ids = [item_id for item_id, _ in items]
        self.words = np.concatenate(coded)
        lengths = np.array([len(c) for c in coded[1:]], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.tables: list[Strings] = []
        for m in np.unique(np.minimum(lengths[lengths > 0], window)).tolist():
            of = np.flatnonzero(lengths >= window if m == window else lengths == m)
            n = lengths[of] - m + 1
            place = np.repeat(self.starts[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.tables.append(self._strings(m, place))

    def _strings(self, m: int, place: np.ndarray) -> Strings:
        b = min(m, 3)
        blocks = block_hashes(self.words, b)
        shift = np.full(1 << max(10, int(4 * len(place) - 1).bit_length()), m - b + 1, np.int32)
        mask = np.uint64(len(shift) - 1)
        for end in range(b, m + 1):
            np.minimum.at(shift, (blocks[place + end - b] & mask).astype(np.int64), m - end)
        suffix, whole = blocks[place + m - b], block_hashes(self.words, m)[place]
        order = np.lexsort((whole, suffix))
        return Strings(m, b, shift, suffix[order], whole[order], place[order].astype(np.int32 if len(self.words) < 1 << 31 else np.int64))

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Words as numbers; 0 for words that no item has."""
        get = self.vocabulary.get
        return np.fromiter((get(x, 0) for x in words), np.int32, len(words))

    def search(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """(start, length, numbers of the items) of every occurrence in ``words``."""
        text, found = self.coded(words), []
        for m, b, shift, suffix, whole, place in self.tables:
            if len(text) < m:
                continue
            blocks = block_hashes(text, b)
            steps = shift[(blocks & np.uint64(len(shift) - 1)).astype(np.int64)].tolist()
            end, strings = m, None
            while end <= len(text):
                step = steps[end - b]
                if step:
                    end += step
                    continue
                low, high = np.searchsorted(suffix, blocks[end - b], "left"), np.searchsorted(suffix, blocks[end - b], "right")
                if low < high:
                    strings = block_hashes(text, m) if strings is None else strings
                    first, last = (low + np.searchsorted(whole[low:high], strings[end - m], side) for side in ("left", "right"))
                    at = place[first:last].astype(np.int64)
                    same = at[(self.words[at[:, None] + np.arange(m)] == text[end - m:end]).all(axis=1)]
                    if len(same):
                        found.append((end - m, m, np.unique(np.searchsorted(self.starts, same, "right") - 1).tolist()))
                end += 1
        return found

    def nbytes(self) -> int:
        """Memory of the arrays, and about that of the vocabulary."""
        return self.words.nbytes + sum(t.shift.nbytes + t.suffix.nbytes + t.whole.nbytes + t.place.nbytes for t in self.tables) + sum(
            len(w) + 130 for w in self.vocabulary)


def item_pieces(text: bytes, window: int) -> list[bytes]:
    """An item as texts of at most ``PIECE_WORDS`` words (and a window) whose windows are those of the item."""
    w = item_words(text)
    if len(w) <= PIECE_WORDS + window - 1:
        return [b" ".join(w)]
    return [b" ".join(w[at:at + PIECE_WORDS + window - 1]) for at in range(0, len(w) - window + 1, PIECE_WORDS)]


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str, window: int, part_bytes: int) -> list[DataFrame]:
    """The items' pieces (id, text), split by hash into parts of at most ``part_bytes`` of text (or one piece)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("binary").alias("text"))

    def cut(batches):
        for batch in batches:
            found = [(i, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in item_pieces(t, window) if p]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["id", "text"])

    pieces = written(items.mapInArrow(cut, "id string, text binary").distinct().withColumn("h", F.xxhash64("id", "text")), "pieces")
    total, largest = pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(total / part_bytes))
    while parts > 1:
        most = pieces.groupBy(F.pmod("h", F.lit(parts))).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
        if most <= max(part_bytes, largest):
            break
        parts = math.ceil(1.2 * parts) + 1
    return [pieces.filter(F.pmod("h", F.lit(parts)) == k).select("id", "text") for k in range(parts)]


FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", out: str = "leaks", window: int = WINDOW,
                       part_bytes: int = PART_BYTES) -> DataFrame:
    """Add the struct column ``out``: n_words, spans (merged half-open word ranges that are hit) and
    items (sorted ids of the items with an occurring window). A narrow pass, no shuffle."""
    spark = docs.sparkSession
    marked = docs
    parts = benchmark_parts(benchmark, item_id, item_text, window, part_bytes)
    for k, part in enumerate(parts):
        held = spark.sparkContext.broadcast({"items": [(r["id"], bytes(r["text"])) for r in part.collect()]})
        marked = _search_part(marked, held, text, out, window, first=k == 0)
        if k + 1 < len(parts):
            marked = written(marked, "leaks")
            held.unpersist()
    return marked


def _search_part(docs: DataFrame, held, text: str, out: str, window: int, first: bool) -> DataFrame:
    kept = [f"`{c}`" for c in docs.columns if c != out]
    source = docs.select(F.struct(*kept).alias("row"), F.col(text).cast("binary").alias("bytes"),
                         *([] if first else [F.col(out).alias("before")]))
    schema = StructType([source.schema["row"], StructField("found", StructType.fromDDL(FOUND))])
    found_type = to_arrow_type(schema["found"].dataType)

    def run(batches):
        part = held.value  # stays in the worker process, and the tables with it
        if "tables" not in part:
            part["tables"] = WuManber(part["items"], window)
        tables = part["tables"]
        for batch in batches:
            found = []
            before = batch.column(2) if not first else None
            for i, value in enumerate(batch.column(1)):
                w = item_words(value.as_py())
                spans, ids = ([], set()) if first else _open(before[i].as_py())
                for start, length, items in tables.search(w):
                    spans.append((start, start + length))
                    ids.update(tables.ids[k] for k in items)
                found.append({"n_words": len(w), "spans": merged(spans), "items": sorted(ids)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=found_type)], names=["row", "found"])

    return source.mapInArrow(run, schema).select("row.*", F.col("found").alias(out))


def _open(before: dict) -> tuple[list, set]:
    return [(s["start"], s["end"]) for s in before["spans"]], set(before["items"])


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Sorted disjoint half-open ranges."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def digest_columns(out: str = "leaks") -> list:
    """n_words, n_hit, n_items, items_sha256, contaminated from the struct column ``out``."""
    hit = F.aggregate(F.col(f"{out}.spans"), F.lit(0).cast("bigint"),
                      lambda acc, s: acc + (s["end"] - s["start"]).cast("bigint"))
    return [F.col(f"{out}.n_words").alias("n_words"), hit.alias("n_hit"),
            F.size(f"{out}.items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join(f"{out}.items", ","), 256).alias("items_sha256"),
            (F.size(f"{out}.spans") > 0).alias("contaminated")]


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark window: one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", *digest_columns())


ORACLE = """
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), strings AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS s, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM strings
), docwords AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM docwords, lengths WHERE len(w) >= m)
), occ AS (SELECT doc_id, i, windows.m, item_id FROM windows JOIN strings USING (s, m)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
    SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS pos FROM occ) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docwords d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
