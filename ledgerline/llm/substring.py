"""Substring dedup by seed and extend, on words.

Seeds: the hashes of ``GRAM`` consecutive words are winnowed: a window of ``length`` words holds
``length - GRAM + 1`` of them and its least one is its anchor, so equal windows share an anchor at the same offset.
Documents are joined on equal anchors; from each the match is extended both ways, to the context that all windows of the
anchor span, and to single windows where contexts differ. Extension compares each occurrence
with its whole anchor class by fingerprint instead of pair by pair, so a class of n copies costs n rows, not n
squared, and finds the same repeats. Overlapping repeated windows merge into maximal repeats; each is at least
``length`` words long. The plan is in ``ledgerline.llm.repeats``.

Nulls and odd rows: null text has no words; a text shorter than the window has no window and stays whole;
repeated rows are separate documents, so their texts repeat each other; ids may be null or repeat; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table, words
from ledgerline.llm.repeats import Parser, anchor_ranges, remove_repeats, sha256, sliding_argmin

LENGTH = 35
GRAM = 10
#: Two odd bases of the polynomial fingerprints, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of a document, their winnowed anchors and the fingerprints of word ranges."""

    def __init__(self, text: memoryview, length: int, gram: int, anchored: bool) -> None:
        import xxhash
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for w in bytes(text).split()], np.uint64)
        self.n = len(hashes)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(b, self.n), dtype=np.uint64)]) for b in BASES]
        self.scale = [powers(i, self.n + 1) for i in INVERSES]
        if anchored and self.n >= length:
            grams = np.arange(self.n - gram + 1)
            self.grams = self._of(0, grams, grams + gram) * np.uint64(0xFF51AFD7ED558CCD)
            self.grams ^= self.grams >> np.uint64(32)
            self.anchors, self.lo, self.hi = anchor_ranges(sliding_argmin(self.grams * np.uint64(BASES[1]), length - gram + 1))

    def _of(self, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[k][ends] - self.sums[k][starts]) * self.scale[k][starts]

    def keys(self) -> np.ndarray:
        return self.grams[self.anchors].view(np.int64)

    def limits(self, seeds: np.ndarray) -> np.ndarray:
        return self.hi

    def strings(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (ends - starts).astype(np.uint64) << np.uint64(32) | salt.astype(np.uint64)
        key = self._of(0, starts, ends) + size * np.uint64(BASES[1])
        chk = (self._of(1, starts, ends) >> np.uint64(32)).astype(np.uint32)
        return key.view(np.int64), chk.view(np.int32)


def word_parser(length: int = LENGTH, gram: int = GRAM) -> Parser:
    def parse(text: memoryview, anchored: bool) -> Words | None:
        found = Words(text, length, gram, anchored)
        return found if found.n >= length else None

    def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
        listed = text.split()
        kept, at = [], 0
        for start, end in spans:
            kept += listed[at:start]
            at = end
        kept += listed[at:]
        return len(listed) - len(kept), len(spans), sha256(b" ".join(kept))

    def slices(text: memoryview, wanted: list[tuple[int, int]]) -> list[bytes]:
        listed = bytes(text).split()
        return [b" ".join(listed[a:b]) for a, b in wanted]

    return Parser(length, parse, cut, slices)


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                             gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_sha256 of every row."""
    listed = words(F.col("text").cast("string"))
    out = remove_repeats(docs, doc_id, text, word_parser(length, gram), F.size(listed).cast("bigint"),
                         F.sha2(F.array_join(listed, " "), 256))
    return out.withColumnRenamed("n", "n_words")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its words inside repeated 35-word windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs)
