"""End to end through the command line, in a process of its own: CSV files -> ingest -> run jobs -> result tables."""

import os
import subprocess
import sys

from ledgerline.plans import kpis
from ledgerline.sources.csv_ingest import CSV_FILES
from ledgerline.sources.tables import export_csv

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cli(tmp_path, *args):
    settings = f"--master local[3] --conf spark.checkpoint.dir={tmp_path}/shared --conf spark.sql.shuffle.partitions=5 pyspark-shell"
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": settings}
    return subprocess.run([sys.executable, "-m", "ledgerline", *args], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)


def test_cli_ingest_and_run(spark, model_check, tmp_path):
    csv_dir, table_dir, out_dir = (str(tmp_path / x) for x in ("csv", "tables", "out"))
    for name, df in model_check.tables().items():
        export_csv(df, f"{csv_dir}/{CSV_FILES[name]}")
    done = cli(tmp_path, "ingest", csv_dir, table_dir)
    assert done.returncode == 0, done.stderr[-2000:]
    jobs = ["kpi_overall", "state_revenue", "cohort_retention", "rfm_segment_summary"]
    done = cli(tmp_path, "run", table_dir, out_dir, *jobs, "--delivered", model_check.delivered)
    assert done.returncode == 0, done.stdout + done.stderr[-2000:]
    got, want = spark.read.parquet(f"{out_dir}/kpi_overall").first(), kpis.kpi_overall(model_check).first()
    assert got == want  # every value, not only the counts
    assert spark.read.parquet(f"{out_dir}/rfm_segment_summary").count() == 8
    # checkpoints and scratch tables are gone
    assert not [f for _, _, files in os.walk(tmp_path / "shared") for f in files]


def test_caller_settings_are_kept(tmp_path):
    code = ("from ledgerline.session import build_session; s = build_session(); "
            "print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[3] --conf spark.sql.shuffle.partitions=5 pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200).stdout
    assert out.split()[-2:] == ["local[3]", "5"]


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from ledgerline import session

    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake)
