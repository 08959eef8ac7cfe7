"""CSV files whose quoted fields hold line breaks, read by many tasks per file.

A line break ends a record only outside quotes, and whether a place lies inside quotes depends on all quotes before it. So the file
is read as physical lines, which Spark splits like any text, in two passes: the first counts the quotes of every split (one row per
split), a running sum per file tells each split whether it starts inside quotes, and the second cuts every split into records on its own. A record that a
split border cuts leaves fragments (two per split at most), which are put together per file. Then each record is parsed alone.

RFC 4180: fields with quotes, commas or line breaks are quoted with ``"`` and quotes inside are doubled, so every record holds an even number of
quotes. Records end at ``\\n`` or ``\\r\\n``; empty lines are skipped; line breaks inside quotes stay as they are. A file that ends inside
quotes, or a record that does not fit the header, is an error. Every file starts with a header; the first one names the columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

# Kinds of rows that the cutting pass gives: whole records, and what split borders leave of one.
WHOLE, HEAD, TAIL, MIDDLE = range(4)
CUT = "file string, block long, place long, kind int, record string"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as split at ``\\n``, with their file and the start of their split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_states(lines: DataFrame) -> DataFrame:
    """file, block, inside (whether the split starts within quotes), last: one row per split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    in_file = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("odd").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("odd").over(in_file) % 2
    return odd.select("file", "block", (before % 2 == 1).alias("inside"), (after == 1).alias("ends_inside"),
                      F.lead("block").over(in_file).isNull().alias("last"))


class _Cutter:
    """The records of one split, fed line by line."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.held: list[str] = []
        self.own = not inside  # the held lines start in this split
        self.place = 0

    def row(self, kind: int, record: str) -> tuple:
        self.place += 1
        return self.file, self.block, self.place - 1, kind, record

    def feed(self, lines: list[str], odd: np.ndarray) -> Iterator[tuple]:
        for line, flips in zip(lines, odd):
            self.held.append(line)
            self.inside ^= bool(flips)
            if not self.inside:
                yield self.row(WHOLE if self.own else HEAD, "\n".join(self.held))
                self.held, self.own = [], True

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self.row(TAIL if self.own else MIDDLE, "\n".join(self.held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of value, file, block, inside in the order of the file, to rows of ``CUT``."""
    names = ["file", "block", "place", "kind", "record"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    cutter = None
    for batch in batches:
        values, files, blocks, inside = batch.columns
        odd = np.asarray(pc.count_substring(values, '"')) % 2 == 1
        block = np.asarray(blocks)
        at, rows = 0, []
        changes = np.flatnonzero(block[1:] != block[:-1]) + 1
        names_change = [i for i in range(1, batch.num_rows) if i in changes or files[i] != files[i - 1]] if pc.count_distinct(files).as_py() > 1 else changes
        for end in [*names_change, batch.num_rows]:
            if end == at:
                continue
            place = (files[at].as_py(), int(block[at]))
            if cutter is None or (cutter.file, cutter.block) != place:
                if cutter is not None:
                    rows.extend(cutter.end())
                cutter = _Cutter(*place, inside[at].as_py())
            rows.extend(cutter.feed(values[at:end].to_pylist(), odd[at:end]))
            at = end
        yield batch_of(rows)
    if cutter is not None:
        yield batch_of(list(cutter.end()))


def cut_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, record: every record of the files, the header included (block 0, place 0)."""
    lines = physical_lines(spark, path)
    states = cut_lineage(split_states(lines))
    bad = states.filter("last AND ends_inside").select("file").limit(5).collect()
    if bad:
        raise ValueError("files end inside quotes: " + ", ".join(r["file"] for r in bad))
    # one row per split of the input (128 MB by default); a broadcast keeps the lines in their order
    placed = lines.join(F.broadcast(states.select("file", "block", "inside")), ["file", "block"]).select("value", "file", "block", "inside")
    rows = cut_lineage(placed.mapInArrow(_cut, CUT))
    whole = rows.filter(F.col("kind") == WHOLE).select("file", "block", "place", "record")
    order = Window.partitionBy("file").orderBy("block", "place")
    fragments = rows.filter(F.col("kind") != WHOLE).withColumn("number", F.count_if(F.col("kind") == TAIL).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "record")))
    joined = fragments.groupBy("file", "number").agg(parts.alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined)


def read_multiline_csv(spark: SparkSession, path: str, parse: dict | None = None) -> DataFrame:
    """All records of the CSV file or folder as string columns named by the header."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST", **(parse or {})}
    records = cut_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", ""))
    header = (F.col("block") == 0) & (F.col("place") == 0)
    first = records.filter(header).orderBy("file").first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = _names(spark, first["record"], options)
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = F.from_csv(F.col("record"), F.lit(schema), options)
    return records.filter(~header & (F.col("record") != "")).select(parsed.alias("r")).select(
        *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def _names(spark: SparkSession, header: str, options: dict) -> list[str]:
    wide = ", ".join(f"`c{i}` string" for i in range(header.count(",") + 1))
    row = spark.range(1).select(F.from_csv(F.lit(header.lstrip("﻿")), F.lit(wide), {**options, "mode": "PERMISSIVE"}).alias("r")).first()["r"]
    names = [n for n in row if n is not None]
    return [n.strip() for n in names]
