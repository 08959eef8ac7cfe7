"""Small frames with the awkward cases every operator must take: nulls, empty and long texts, ties, repeated rows,
extra columns whose names clash with internal ones."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, size string, row string, fp string, key string, n string, kept string"
VOCABULARY = "the of and to in is that it for was on are with as this river stone cloud engine market garden".split()


def prose(n: int, seed: int, extra: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY) if rnd.random() < 0.4 else f"w{rnd.randrange(extra)}x" for _ in range(n))


def rows() -> list[tuple]:
    long, passage, near = prose(30_000, 1), prose(60, 2), prose(300, 3).split()
    changed = list(near)
    changed[150] = "different"
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, long), (6, prose(80, 4) + " " + passage), (7, passage + "\n" + prose(90, 5)),
             (8, " ".join(near)), (9, " ".join(changed)), (9, " ".join(changed)), (None, prose(50, 6)), (None, None), (10, "a " * 500),
             (11, "é" * 900), (12, "One two"), (13, passage), (14, prose(200, 7).upper()), (15, "x" * 2000), (16, "\x00\x1f odd \x85 text  ")]
    return [(i, t, lang, src, None if t is None else len(t), "r", "s", "w", "f", "k", "n", "y")
            for (i, t), lang, src in zip(texts, ["en", None, "xx", "de"] * 9, ["a", "b", None, "a", "c"] * 9)]


def edge_docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf: str = SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
