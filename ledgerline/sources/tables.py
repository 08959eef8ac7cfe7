"""Named result tables: replace by name, reopen by name from any later session.

A table is a folder ``<root>/<name>`` with one folder per version and a small ``_current`` file that
names the version in force. Replacing writes the new version in full first and then switches the file
by an atomic rename, so readers see the old or the new table, a failed write changes nothing, and a table may
be replaced by a plan that reads it. The file also names the version before, which is kept for plans that still read it; when a version is
replaced, only the one before it goes, so a version that another writer is writing is never touched. Versions that no file names
(a writer failed, or two switched at the same moment) go after ``ORPHAN_DAYS``.

The root is ``spark.ledgerline.tables.dir`` if set, otherwise ``ledgerline`` in the session's warehouse folder
(shared by all executors).
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ORPHAN_DAYS = 7
SWITCH_ATTEMPTS = 8
ROOT_SETTING = "spark.ledgerline.tables.dir"


def table_root(spark: SparkSession) -> str:
    return spark.conf.get(ROOT_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/ledgerline"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    p = hadoop.fs.Path(path)
    return hadoop, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folder(spark: SparkSession, name: str, root: str | None) -> str:
    return f"{(root or table_root(spark)).rstrip('/')}/{name}"


def _versions(spark: SparkSession, name: str, root: str | None = None) -> list[str]:
    """The version in force and the one before, as far as there are any."""
    _, path, fs = _fs(spark, f"{_folder(spark, name, root)}/_current")
    for attempt in range(SWITCH_ATTEMPTS):  # during a switch the file may be gone, or not fit its checksum file, for a moment
        if not fs.exists(path):
            return []
        try:
            stream = fs.open(path)
            try:
                return [v for v in (stream.readLine(), stream.readLine()) if v]
            finally:
                stream.close()
        except Py4JJavaError:
            if attempt + 1 == SWITCH_ATTEMPTS:
                raise
            time.sleep(0.1 * 2 ** attempt * random.random())


def current_version(spark: SparkSession, name: str, root: str | None = None) -> str | None:
    """The version in force, or None."""
    return next(iter(_versions(spark, name, root)), None)


def open_table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    version = current_version(spark, name, root)
    if version is None:
        raise FileNotFoundError(f"no saved table {name} under {root or table_root(spark)}")
    return spark.read.parquet(f"{_folder(spark, name, root)}/{version}")


def write_table(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Replace the table ``name`` with ``df`` and reopen it."""
    spark, folder = df.sparkSession, _folder(df.sparkSession, name, root)
    version = f"v-{uuid.uuid4().hex}"
    hadoop, fresh, fs = _fs(spark, f"{folder}/_next-{version}")
    try:
        df.write.parquet(f"{folder}/{version}")
    except Exception:
        fs.delete(hadoop.fs.Path(f"{folder}/{version}"), True)
        raise
    option = getattr(hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context = hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    for attempt in range(SWITCH_ATTEMPTS):  # a store without atomic renames refuses one of two switches at the same moment
        before = _versions(spark, name, root)  # read after the write: another writer may have switched meanwhile
        out = fs.create(fresh, True)
        out.writeBytes("".join(v + "\n" for v in (version, *before[:1])))
        out.close()
        try:
            context.rename(fs.makeQualified(fresh), fs.makeQualified(hadoop.fs.Path(f"{folder}/_current")), options)
            break
        except Py4JJavaError:
            if attempt + 1 == SWITCH_ATTEMPTS:
                raise
            time.sleep(0.1 * 2 ** attempt * random.random())
    for old in before[1:]:
        fs.delete(hadoop.fs.Path(f"{folder}/{old}"), True)
    named, limit = {version, *before}, (time.time() - ORPHAN_DAYS * 86_400) * 1000
    for status in fs.listStatus(hadoop.fs.Path(folder)):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in named and status.getModificationTime() < limit:
            fs.delete(status.getPath(), True)
    return spark.read.parquet(f"{folder}/{version}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the folder ``path`` by what ``write(folder)`` writes: in full to a folder beside it first, then by two renames, so a failed
    write leaves the old data as it was."""
    mark = uuid.uuid4().hex[:12]
    hadoop, place, fs = _fs(spark, path.rstrip("/"))
    fresh, old = (hadoop.fs.Path(f"{path.rstrip('/')}{tag}-{mark}") for tag in ("_next", "_old"))
    try:
        write(fresh.toString())
    except Exception:
        fs.delete(fresh, True)
        raise
    held = fs.exists(place)
    if held and not fs.rename(place, old):
        raise OSError(f"can't move {place}")
    if not fs.rename(fresh, place):
        if held:
            fs.rename(old, place)
        raise OSError(f"can't move {fresh} to {place}")
    if held:
        fs.delete(old, True)


def export_csv(df: DataFrame, path: str) -> str:
    """Write ``df`` as headed CSV (used to round-trip the ingest path)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
