"""The pipeline against stage-by-stage brute force, registered queries against their SQL, and the entry's guard."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from ledgerline.llm.registry import LLM_ORACLE, LLM_QUERIES
from ledgerline.llm import secret_scan
from tests.llm.samples import SF, documents, edge_docs, empty_docs
from tests.llm.test_filters import brute as brute_leaks
from tests.llm.test_simhash import closure, signed, slow_fingerprint

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_on_edges(spark):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, empty_docs(spark), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == docs.count()


def test_dedup_keeps_one_of_each_group(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], signed(slow_fingerprint(r["text"]))) for r in docs.collect()]
    label = closure({fp for _, fp in rows}, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2)
    least = {}
    for i, fp in rows:
        least[label[fp]] = min(least.get(label[fp], i), i)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_decontamination_keeps_clean_documents(spark):
    docs = documents(spark)
    strings = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        from ledgerline.llm.decontaminate import item_words
        w = [x.decode() for x in item_words((r["text"] or "").encode())]
        for i in range(max(1, len(w) - 9) if w else 0):
            strings.setdefault(tuple(w[i:i + 10]), set()).add(str(r["item_id"]))
    clean = sorted(r["doc_id"] for r in docs.collect() if not brute_leaks(r["text"], strings)[-1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, SF).collect()) == clean


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in docs.collect())
    assert not docs.filter("text rlike 'token = \"[0-9a-f]{40}'").count()
    assert docs.filter(docs.text.contains(secret_scan.MASK) & (docs.n_chars != __import__("pyspark").sql.functions.length("text"))).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = LLM_QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({LLM_ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in LLM_QUERIES) == list(range(1, 14))


def test_entry_without_the_subpackage():
    code = ("import sys; sys.modules['ledgerline.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; "
            "assert 'kpi_overall' in e.queries() and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()") % ROOT
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
