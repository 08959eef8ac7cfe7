"""Source divergence audit: how far the term use of the sources of a language lies apart, over a frequent-pattern tree of term rows.

Terms are runs of letters (ASCII letters and everything above ASCII), A-Z lower-cased. A language keeps the terms in at least
``min_docs`` of its documents. Shares are smoothed integers, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and a term's divergence
between two sources is f = floor((p - q)^2 / (p + q)); all arithmetic is on integers.

A term's row lists its nonzero counts in the order of the sources. Most terms miss most sources, so the sum of f over all
terms is taken apart: V times the f of two zero counts; per source, how its nonzero counts change that against a zero (a histogram
of counts times the other sources); and per pair a correction for terms that both have, which comes from the tree. Equal rows are merged with
their multiplicity and sorted; each batch of sorted rows is inserted into a tree whose rows share the nodes of their common prefix, multiplicities
are summed towards the root, and every node's multiplicity is applied once to each of its ancestors. Nodes that a batch
border cuts are treated twice with parts of their multiplicity, which adds up to the same. A task holds one batch and one sum per pair of sources.

Scale: texts are counted in one narrow pass. A task holds ``HELD`` terms at most; beyond that it sends the rare ones and keeps
counting the frequent ones, so a frequent term costs one row per task and source. Those rows move once, by (language, term);
counts, document frequencies and the choice of terms follow in the same stage. A term's row has one entry per source of its language at most.

Nulls and odd rows: null text, language and source count as empty strings; repeated rows count each; groups without terms take part with zero
counts; a language without kept terms has pairs of value 0 and no terms; one source alone has no pairs; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, UPPER, arrow_schema, table, written

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HELD = 200_000  # partial counts that a task holds before it sends rare ones
RARE = 4  # documents below which a held count is rare
PIECE = 1 << 20  # bytes of a text that are split at once
#: Bytes of terms: A-Z to a-z, other ASCII to a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def text_terms(text: bytes, letters: bytes = _LETTERS) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; ``letters`` maps what separates them to a blank."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        piece = text[at:end].translate(letters)
        if end < len(text):  # cut after the last blank; a term longer than a piece takes in what follows
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):
                end = min(end + PIECE, len(text))
                piece = text[at:end].translate(letters)
                cut = piece.rfind(b" ")
            if end < len(text):
                piece, end = piece[:cut], at + cut + 1
        yield piece.split()
        at = end


def partial_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs: sums over parts of the table, several rows per key."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))),
                       F.col(text).cast("binary").alias("bytes"))
    ddl = "lang string, source string, term string, n long, docs long"
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[dict, dict]] = {}  # occurrences and documents of each term
        held = 0

        def sent(rare: bool) -> Iterator[pa.RecordBatch]:
            for (g_lang, g_source), (n, in_docs) in groups.items():
                terms = [t for t, d in in_docs.items() if d < RARE] if rare else list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g_lang] * len(terms), pa.string()), pa.array([g_source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n.pop(t) for t in terms], pa.int64()),
                     pa.array([in_docs.pop(t) for t in terms], pa.int64())], schema=schema)

        for batch in batches:
            for g_lang, g_source, value in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
                value = value.as_py()
                if not value:
                    continue
                found: Counter = Counter()
                for terms in text_terms(value):
                    found.update(terms)
                n, in_docs = groups.setdefault((g_lang, g_source), ({}, {}))
                before = len(n)
                for t, k in found.items():
                    n[t] = n.get(t, 0) + k
                    in_docs[t] = in_docs.get(t, 0) + 1
                held += len(n) - before
                if held > HELD:
                    yield from sent(rare=True)
                    held = sum(len(n) for n, _ in groups.values())
                    if held > HELD // 2:  # frequent terms alone fill the room
                        yield from sent(rare=False)
                        held = 0
        yield from sent(rare=False)

    return rows.mapInArrow(run, ddl)


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed integer share; ``div`` on decimals is exact."""
    top = (n.cast("decimal(20,0)") + 2) * F.lit(SCALE)
    return F.call_function("div", top.cast("decimal(38,0)"), (total + 2 * terms).cast("decimal(38,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tree_nodes(offsets: np.ndarray, source: np.ndarray, p: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of sorted rows: row i is the path of entries offsets[i]:offsets[i + 1], with multiplicity m[i]. A node per new entry of a
    row after what it shares with the row before: (its entry, its parent or -1, its depth, its multiplicity)."""
    lengths = np.diff(offsets)
    rows = np.arange(len(lengths))
    shared = np.zeros(len(lengths), np.int64)
    alive = rows[1:]
    while len(alive):  # rows whose first entries, as many as ``shared`` says, equal those of the row before
        depth = shared[alive]
        alive = alive[(depth < lengths[alive]) & (depth < lengths[alive - 1])]
        here, above = offsets[alive] + shared[alive], offsets[alive - 1] + shared[alive]
        alive = alive[(source[here] == source[above]) & (p[here] == p[above])]
        shared[alive] += 1
    depth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    entries = np.flatnonzero(depth >= np.repeat(shared, lengths))
    number = np.full(offsets[-1], -1, np.int64)
    number[entries] = np.arange(len(entries))
    parent, weight = np.full(len(entries), -1, np.int64), np.zeros(len(entries), np.int64)
    before = np.full(len(rows), -1, np.int64)
    for level in range(int(lengths.max(initial=0))):
        long = rows[lengths > level]
        place = offsets[long] + level
        at = np.full(len(rows), -1, np.int64)
        at[long] = number[place]
        at = np.maximum.accumulate(at)  # a shared entry is the node of the row before
        fresh = number[place] >= 0
        parent[number[place][fresh]] = before[long][fresh]
        ends = long[lengths[long] == level + 1]
        np.add.at(weight, at[ends], m[ends])
        before = at
    depth = depth[entries]
    for level in range(int(depth.max(initial=0)), 0, -1):
        nodes = np.flatnonzero(depth == level)
        np.add.at(weight, parent[nodes], weight[nodes])
    return entries, parent, depth, weight


def batch_corrections(offsets: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray, m: np.ndarray, sources: int) -> dict[int, int]:
    """Sums of multiplicity times correction over all (node, ancestor), keyed by ancestor's source * ``sources`` + node's source."""
    entries, parent, depth, weight = tree_nodes(offsets, source, p, m)
    source, p, zero = source[entries], p[entries], zero[entries]
    sums: dict[int, int] = {}
    node, up = np.flatnonzero(depth > 0), parent[depth > 0]
    while len(node):
        value = weight[node] * (_f(p[node], p[up]) - _f(p[node], zero[up]) - _f(zero[node], p[up]) + _f(zero[node], zero[up]))
        keys, where = np.unique(source[up] * sources + source[node], return_inverse=True)
        found = np.zeros(len(keys), np.int64)
        np.add.at(found, where, value)
        for key, v in zip(keys.tolist(), found.tolist()):
            sums[key] = sums.get(key, 0) + v
        up = parent[up]
        node, up = node[up >= 0], up[up >= 0]
    return sums


def tree_corrections(paths: DataFrame) -> DataFrame:
    """lang, a, b, value over term rows ``paths`` (lang, path of (source, p, zero), m): for sources a < b the sum over terms that both
    have of f(p, q) - f(p, zero q) - f(zero p, q) + f(zero p, zero q), as sums of parts."""
    ddl = "lang string, a string, b string, value long"
    schema = arrow_schema(paths.sparkSession, ddl)
    # ranges by a path's first shares: what the planner samples for them stays small; the hash parts paths that begin alike
    first = [F.get("path", F.lit(k))["p"] for k in range(3)]
    ordered = paths.repartitionByRange("lang", *first, F.xxhash64("path")).sortWithinPartitions("lang", "path").select("lang", "path", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, paths = batch.column(0).to_pylist(), batch.column(1)
            borders = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
            for start, end in zip(borders, borders[1:]):
                if start == end:
                    continue
                part = paths.slice(start, end - start)
                flat = part.flatten()
                coded = flat.field("source").dictionary_encode()
                names = coded.dictionary.to_pylist()
                offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(part)))]).astype(np.int64)
                sums = batch_corrections(offsets, np.asarray(coded.indices).astype(np.int64), np.asarray(flat.field("p")),
                                         np.asarray(flat.field("zero")), np.asarray(batch.column(2))[start:end], len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[start]] * len(sums), pa.string()), pa.array([names[k // len(names)] for k in sums], pa.string()),
                     pa.array([names[k % len(names)] for k in sums], pa.string()), pa.array(sums.values(), pa.int64())], schema=schema)

    return ordered.mapInArrow(run, ddl)


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
                     top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, q, value, rank; part ``pair`` has a row per other source of the language, part ``term``
    the ``top`` terms that the source uses more than its language."""
    # one move by (lang, term); the sums below need no other
    parts = partial_counts(docs, text, lang, source).repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    entries = counts.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)}).filter(F.col("in_docs") >= min_docs)
    entries = written(entries.select("lang", "source", "term", "n", "lang_n"), "audit-entries")

    kept = entries.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    present = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    groups = present.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    groups = written(groups.withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))), "audit-groups")
    scored = written(entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "zero", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "audit-scored")

    return source_pairs(scored, groups).unionByName(leading_terms(scored, top))


def source_pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: the divergence of every two sources of a language over all its terms."""
    paths = scored.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
    paths = written(paths.groupBy("lang", "path").agg(F.count("*").alias("m")), "audit-paths")
    both = tree_corrections(paths).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("other"))
    histogram = scored.groupBy("lang", F.col("source").alias("a"), "zero", "p").agg(F.count("*").alias("m"))
    single = histogram.join(other, "lang").filter("a <> b").select(
        "lang", "a", "b", (F.col("m") * (divergence(F.col("p"), F.col("other")) - divergence(F.col("zero"), F.col("other")))).alias("value"))
    base = groups.select("lang", F.col("source").alias("a"), "zero", "terms").join(other, "lang").filter("a < b").select(
        "lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * divergence(F.col("zero"), F.col("other"))).otherwise(0).alias("value"))
    single = single.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    sums = written(base.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    rows = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    return ranked(rows, "pair")


def leading_terms(scored: DataFrame, top: int) -> DataFrame:
    """Part ``term``: the terms of largest divergence that a source uses more than its language."""
    rows = scored.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"),
                                                         divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(rows, "term").filter(F.col("rank") <= top)  # Spark limits each task's rows before the shuffle


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and the leading terms of every source."""
    return divergence_audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), words AS (SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}
), langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
         1 + {SCALE}::HUGEINT * (k.lang_n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
       LEFT JOIN totals t USING (lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM grid WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
