"""Repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut each text into phrases: the hash of ``TRIGGER`` bytes at a position is a trigger if it is the
least of a run of ``RUN`` positions. Every run has one, so phrases are at most ``RUN`` bytes plus the trigger, and a
string of ``length`` bytes holds at least one whole phrase wherever it starts: equal strings cut equally,
starting from the first run inside them. Consecutive phrases overlap by the trigger, which makes the parse
prefix-free: no phrase ends inside the trigger of another.

The dictionary is the set of distinct phrases; the parse is each text's phrase sequence. Corpus order puts two
positions next to each other when the rest of their phrase is equal and the parse goes on equally. As only
equality over ``length`` bytes is asked, not the full order, the dictionary and parse suffixes are grouped by
fingerprint instead of being sorted: (1) phrases that occur once drop out together with all strings that
hold them; (2) the suffixes of a phrase with their parse continuation are compared as one context;
(3) at the edges of repeats the single suffixes of a phrase are compared. So highly
repetitive text costs one row per phrase, not one per byte. The plan is in ``ledgerline.llm.repeats``.

Nulls and odd rows: null text is empty; a text shorter than the string stays whole; runs of one byte
make every position a trigger and still give right results; repeated rows are separate documents and repeat
each other; ids may be null or repeat; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table
from ledgerline.llm.repeats import Parser, anchor_ranges, remove_repeats, sha256, sliding_argmin

LENGTH = 400
TRIGGER = 16
BLOCK = 1 << 20


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value per byte."""
    return np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 63, 256, dtype=np.uint64)


def rolling_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of the ``TRIGGER`` bytes at each position, by doubling."""
    h = values[data]
    span, base = 1, np.uint64(0x9E3779B97F4A7C15)
    while span < TRIGGER:
        h = h[:-span] * base + h[span:]
        base = base * base if base.ndim else np.uint64(int(base) ** 2 % (1 << 64))
        span *= 2
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Phrases:
    """Trigger positions of a text, its phrases and the fingerprints of byte ranges."""

    def __init__(self, text: memoryview, length: int, anchored: bool, values: np.ndarray) -> None:
        self.text, self.length = text, length
        self.run = (length - TRIGGER) // 2
        self._keys: np.ndarray | None = None
        if anchored:
            data = np.frombuffer(text, np.uint8)
            starts = len(data) - TRIGGER - self.run + 2  # whole runs; the last triggers only end phrases
            chosen = np.empty(starts, np.int64)
            for at in range(0, starts, BLOCK):
                n = min(BLOCK, starts - at)
                h = rolling_hashes(data[at:at + n + self.run + TRIGGER - 2], values)
                chosen[at:at + n] = sliding_argmin(h, self.run) + at
            self.anchors, self.lo, hi = anchor_ranges(chosen)
            self.hi = np.minimum(hi, len(data) - length)

    def keys(self) -> np.ndarray:
        """Fingerprint of the phrase that starts at each trigger. The text's last one is open; no window holds it."""
        if self._keys is None:
            import xxhash
            digest, text = xxhash.xxh3_64_intdigest, self.text
            ends = np.append(self.anchors[1:] + TRIGGER, len(text)).tolist()
            self._keys = np.array([digest(text[a:b]) for a, b in zip(self.anchors.tolist(), ends)], np.uint64).view(np.int64)
        return self._keys

    def limits(self, seeds: np.ndarray) -> np.ndarray:
        """The last window start of each trigger before a window would hold a later phrase that occurs once."""
        n = len(self.anchors)
        single = np.where(seeds, n, np.arange(n))
        after = np.minimum.accumulate(single[::-1])[::-1]  # first single phrase at or after each
        after = np.append(after[1:], n)
        bound = np.append(self.anchors, 1 << 62)[after] + self.run + 1 + TRIGGER - self.length - 1
        return np.minimum(self.hi, bound)

    def strings(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import xxhash
        digest, text, low = xxhash.xxh3_128_intdigest, self.text, (1 << 64) - 1
        found = [digest(text[a:b], s) for a, b, s in zip(starts.tolist(), ends.tolist(), salt.tolist())]
        key = np.array([x & low for x in found], np.uint64).view(np.int64)
        chk = np.array([x >> 96 for x in found], np.uint32).view(np.int32)
        return key, chk


def byte_parser(length: int = LENGTH) -> Parser:
    if length < 4 * TRIGGER:
        raise ValueError(f"strings need {4 * TRIGGER} bytes at least")
    values = byte_values()

    def parse(text: memoryview, anchored: bool) -> Phrases | None:
        return Phrases(text, length, anchored, values) if len(text) >= length else None

    def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
        kept, at = [], 0
        for start, end in spans:
            kept.append(text[at:start])
            at = end
        kept.append(text[at:])
        rest = b"".join(kept)
        return len(text) - len(rest), len(spans), sha256(rest)

    def slices(text: memoryview, wanted: list[tuple[int, int]]) -> list[bytes]:
        return [bytes(text[a:b]) for a, b in wanted]

    return Parser(length, parse, cut, slices)


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every row."""
    out = remove_repeats(docs, doc_id, text, byte_parser(length), F.octet_length("text").cast("bigint"), F.sha2("text", 256))
    return out.withColumnRenamed("n", "n_bytes")


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its bytes inside repeated 400-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs)
