"""Types that lose nothing, and tables that are replaced only when complete."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import tables
from ledgerline.sources.csv_ingest import ingest_tables, read_csv_tables


def inferred(spark, tmp_path, columns):
    """Types found for columns of texts (None is an empty field)."""
    names = list(columns)
    lines = [",".join(names)] + [",".join("" if v is None else f'"{v}"' if "," in v else v for v in row) for row in zip(*columns.values())]
    (tmp_path / "sellers.csv").write_text("\n".join(lines) + "\n")
    df = read_csv_tables(spark, str(tmp_path), {"sellers": "sellers.csv"}, infer=True)["sellers"]
    return dict(df.dtypes), df


def test_only_types_that_give_the_text_again(spark, tmp_path):
    columns = {
        "zip": ["01037", "22041", None], "count": ["7", "-12", "0"], "wide": ["7", "3000000000", None], "huge": ["7", "12345678901234567890", "1"],
        "plus": ["+5", "6", "7"], "weight": ["1.5", "2", "-0.25"], "price": ["10.50", "3.00", None], "version": ["1.10", "1.1", "2.0"],
        "long": ["0.12345678901234567", "1.5", "2.25"], "exponent": ["1e3", "2", "3"], "flag": ["true", "false", "true"], "loud": ["TRUE", "false", "true"],
        "day": ["2020-02-29", "2019-01-01", None], "nodate": ["2020-02-30", "2019-01-01", None], "time": ["2017-10-02 10:56:33", "2017-10-02 00:00:00.5", None],
        "offset": ["2017-10-02 10:56:33+02:00", "2017-10-02 10:56:33", None], "empty": [None, None, None], "minus": ["-0", "1", "2"], "name": ["a", "b", "c"],
    }
    types, df = inferred(spark, tmp_path, columns)
    assert types == {
        "zip": "string", "count": "int", "wide": "bigint", "huge": "decimal(20,0)", "plus": "string", "weight": "double", "price": "decimal(4,2)",
        "version": "string", "long": "string", "exponent": "string", "flag": "boolean", "loud": "string", "day": "date", "nodate": "string",
        "time": "timestamp_ntz", "offset": "string", "empty": "string", "minus": "string", "name": "string"}
    row = df.filter("name = 'a'").first()
    assert row.zip == "01037" and str(row.price) == "10.50" and row.huge == 7 and row.offset.endswith("+02:00")


def test_texts_survive_the_round_trip(spark, tmp_path):
    """Whatever type is chosen, casting back gives the file's text."""
    import random
    rnd = random.Random(6)
    pool = ["0", "7", "-3", "12.5", "0.5", "3.10", "0012", "1e5", "true", "2020-01-05", "2020-01-05 07:08:09", "x", "99999999999", "-0.0", ".5", "5."]
    columns = {f"c{k}": [rnd.choice(rnd.sample(pool, 2) + [None]) for _ in range(6)] for k in range(40)}
    columns["id"] = [f"r{i}" for i in range(6)]
    types, df = inferred(spark, tmp_path, columns)
    rows = {r["id"]: r for r in df.select("id", *[F.col(c).cast("string").alias(c) for c in columns if c != "id"]).collect()}
    for c, values in columns.items():
        for i, v in enumerate(values):
            got = rows[f"r{i}"][c]
            plain = got[:-2] if types[c] == "double" and got is not None and got.endswith(".0") else got
            assert plain == v, (c, types[c], v, got)


def test_offsets_and_fractions_are_reported(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,order_purchase_timestamp\na,2017-10-02 10:56:33+02:00\nb,2017-10-02 10:56:33\nc,2017-10-02T10:56:33Z\n")
    (tmp_path / "r.csv").write_text("order_id,review_score\na,4.7\nb,5\n")
    with pytest.raises(ValueError, match="order_purchase_timestamp 2"):
        read_csv_tables(spark, str(tmp_path), {"orders": "o.csv"})
    with pytest.raises(ValueError, match="review_score 1"):
        read_csv_tables(spark, str(tmp_path), {"order_reviews": "r.csv"})


def test_a_failed_load_leaves_the_old_table(spark, tmp_path):
    src, dst = tmp_path / "csv", str(tmp_path / "tables")
    src.mkdir()
    (src / "s.csv").write_text("seller_id\na\nb\n")
    ingest_tables(spark, str(src), dst, {"sellers": "s.csv"})
    (src / "s.csv").write_text("seller_id\na,too,many\n")
    with pytest.raises(Exception):
        ingest_tables(spark, str(src), dst, {"sellers": "s.csv"})
    assert spark.read.parquet(f"{dst}/sellers").count() == 2
    (src / "s.csv").write_text("seller_id\nc\n")
    ingest_tables(spark, str(src), dst, {"sellers": "s.csv"})
    assert [r[0] for r in spark.read.parquet(f"{dst}/sellers").collect()] == ["c"]
    assert sorted(p.name for p in (tmp_path / "tables").iterdir()) == ["sellers"]


def test_two_writers_of_one_table(spark, tmp_path):
    """Writers that overlap never touch each other's version; one of the two is in force at the end."""
    root, errors = str(tmp_path), []

    def writer(k):
        try:
            for i in range(2):
                tables.write_table(spark.range(50).select((F.col("id") + 1000 * k + 100 * i).alias("id")).repartition(3), "t", root)
        except Exception as exc:
            errors.append(exc)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert {r[0] // 100 for r in tables.open_table(spark, "t", root).collect()} in ({1}, {11})


def test_reading_during_a_switch(spark, tmp_path):
    """Between the renames of a switch, the file in force has the other version's checksum file."""
    tables.write_table(spark.range(5), "t", str(tmp_path))
    version, checksum = tables.current_version(spark, "t", str(tmp_path)), tmp_path / "t" / "._current.crc"
    right = checksum.read_bytes()
    checksum.write_bytes(right[:-1] + bytes([right[-1] ^ 1]))
    switched = threading.Timer(0.3, checksum.write_bytes, [right])
    switched.start()
    try:
        assert tables.current_version(spark, "t", str(tmp_path)) == version
    finally:
        switched.join()
