"""Filter interaction audit: what every order of a set of filters removes, repeats and loses, by min-plus removal ranks.

A filter either fails a document or not, so all that an order of filters does to a document follows from its mask (one
bit per filter) and is counted once per (part, mask). For one part the mask matrix holds 0 where the mask fails a
filter and infinity elsewhere; the position matrix holds the inverse permutations, the step at which each order
applies each filter. Their min-plus product is the removal step of every mask under every order. Weighted scatter
adds give the counts of each (order, step); what fails a filter but isn't removed by it was removed before, so it is redundant.

Five filters over whole texts: A too few words, B too few distinct words, C too many capitals, D control-like symbols, E text
identical to that of a smaller id anywhere in the table. E is counted, not joined: of each text the rows with the
least id pass, all others fail, so the failing count is the total less these first rows. Copies of one text are reduced by
minimum before and after the shuffle, so a text that a third of all rows share costs no task more than the rest.
Texts are equal if their 128-bit digests (BLAKE2b) are. Only one number table per part (at most 128 rows) meets in one task.

Nulls and odd rows: null text counts as empty, null source as the part with the empty name; a null id neither fails E nor makes
another fail, and has no label; rows that repeat an id are counted each, equal ids don't fail E against each other; an id
labelled more than once is good (toxic) if any of its labels says so; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import UPPER, arrow_schema, table, written

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
SYMBOLS = "#$%&*|"
GROUP = ["part", "mask", "good", "toxic"]
_CAPITALS, _SYMBOLS = UPPER.encode(), SYMBOLS.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that start no code point
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the text fails filters A to D."""
    words = text.split()  # bytes: ASCII white space only
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATION))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
             100 * capitals > MAX_CAPITAL_PERCENT * points, len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(bit << k for k, bit in enumerate(fails))


def marked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, mask of filters A to D and digest of every row; one narrow pass over whole texts."""
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                value = value.as_py()
                masks.append(text_mask(value))
                digests.append(hashlib.blake2b(value, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["id", "part", "mask", "digest"])

    shape = source.drop("bytes").withColumn("mask", F.lit(0)).withColumn("digest", F.lit(b""))
    return source.mapInArrow(run, shape.schema)


def mask_weights(marked: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, mask (E is bit 4), good, toxic, n: the number of rows of each kind."""
    flags = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = written(marked.filter("id IS NOT NULL").join(flags, "id", "left").fillna(False, ["good", "toxic"]), "audit-named")
    unnamed = marked.filter("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    rows = named.groupBy("digest", "id", *GROUP).agg(F.count("*").alias("n"))
    # rows of one text and one id differ at most in part; of each text those with the least id are first
    same = rows.groupBy("digest", "id").agg(F.collect_list(F.struct(*GROUP, "n")).alias("kinds"))
    least = same.groupBy("digest").agg(F.min_by("kinds", "id").alias("kinds"))
    first = least.select(F.inline("kinds")).groupBy(*GROUP).agg(F.sum("n").alias("n"))
    e = 1 << FILTERS.index("E")
    failing = F.col("mask").bitwiseOR(F.lit(e)).alias("mask")
    first = written(first, "audit-first")
    kinds = [named.groupBy(*GROUP).agg(F.count("*").alias("n")).select("part", failing, "good", "toxic", "n"),
             first.select("part", failing, "good", "toxic", (-F.col("n")).alias("n")),
             first, unnamed.groupBy(*GROUP).agg(F.count("*").alias("n"))]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out.groupBy(*GROUP).agg(F.sum("n").alias("n"))


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The matrix product with minimum for sum and sum for product."""
    return (left[:, :, None] + right[None, :, :]).min(axis=1)


def removal_counts(weights: DataFrame, n_filters: int = len(FILTERS), names: str = FILTERS) -> DataFrame:
    """One row per part, order of all filters and step; see the module's text."""
    schema = arrow_schema(weights.sparkSession, AUDIT)

    def audit(rows: pa.Table) -> pa.Table:
        masks, n = (rows.column(c).to_numpy() for c in ("mask", "n"))
        weight = np.stack([n, np.where(rows.column("good").to_numpy(), n, 0), np.where(rows.column("toxic").to_numpy(), n, 0)])
        fails = (masks[:, None] >> np.arange(n_filters)) & 1 == 1
        orders = np.array(list(permutations(range(n_filters))))
        position = np.argsort(orders, axis=1).T + 1  # filter x order: the step that applies it
        never = n_filters + 1
        step = np.minimum(min_plus(np.where(fails, 0, never), position), never)  # kind x order
        lost = np.zeros((3, len(orders), never + 1), np.int64)
        for k in range(3):
            np.add.at(lost[k], (np.arange(len(orders))[None, :], step), weight[k][:, None])
        removed = lost[0, :, 1:never]
        failing = (fails * n[:, None]).sum(axis=0)
        alone = np.array([n[masks == 1 << f].sum() for f in range(n_filters)])
        shapley = np.array([removed[np.arange(len(orders)), position[f] - 1].sum() for f in range(n_filters)])
        columns = [n.sum() - removed.cumsum(axis=1), removed, failing[orders] - removed, alone[orders],
                   lost[1, :, 1:never], lost[2, :, 1:never], shapley[orders]]
        labels = ["".join(names[f] for f in order) for order in orders]
        size = len(orders) * n_filters
        return pa.table([pa.array([rows.column("part")[0].as_py()] * size), pa.array(np.repeat(labels, n_filters).tolist()),
                         pa.array(np.tile(np.arange(1, never, dtype=np.int32), len(orders))),
                         *(pa.array(c.reshape(-1).astype(np.int64)) for c in columns)], schema=schema)

    return weights.groupBy("part").applyInArrow(audit, AUDIT)


def interaction_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      part: str = "source") -> DataFrame:
    """The audit of filters A to E over ``docs``, with ``labels`` (id, quality, toxic)."""
    marked = written(marked_documents(docs, doc_id, text, part), "audit-marked")
    return removal_counts(mask_weights(marked, labels, doc_id))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters, per source."""
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = f"""
WITH flags AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), marks AS (
  SELECT part, CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > {MAX_CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END
         + CASE WHEN length(translate(t, '{SYMBOLS}', '')) < length(t) THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts LEFT JOIN flags USING (doc_id)
), kinds AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM marks GROUP BY ALL
), letters AS (SELECT unnest(range(5)) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o, s AS step, o[s] AS f, list_sum(list_transform(o[1:s - 1], lambda x: 1 << x)) AS earlier FROM orders, range(1, 6) r(s)
), counts AS (
  SELECT part, o, step, f,
         sum(CASE WHEN mask & (coalesce(earlier, 0) | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0) = 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0) = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM kinds, steps GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('{FILTERS}', x + 1, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counts
"""
