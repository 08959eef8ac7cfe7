"""Dashboard cards from saved cells: equal to the cards over the items, for any range and state list."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.filters import SalesFilter
from ledgerline.plans import cells, dashboard
from tests.helpers import simple_model

FILTERS = [
    SalesFilter(), SalesFilter("1997-01-01", "1999-06-30"), SalesFilter("1996-03-15", "1998-12-31", ("NATION_1", "NATION_20")),
    SalesFilter("1997-02-01", "1997-02-28"), SalesFilter("1997-02-02", "1997-02-27", ("NATION_3",)), SalesFilter("1997-02-28", "1997-03-01"),
    SalesFilter(None, "1996-05-17"), SalesFilter("1998-01-31", None), SalesFilter("1997-05-05", "1997-05-05"), SalesFilter("2050-01-01", None),
    SalesFilter("1997-01-01", "1996-01-01"),
]


@pytest.fixture(scope="module")
def saved(spark, model_small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cells"))
    cells.save_sales_cells(model_small, root, sketches=True)
    return root


@pytest.mark.parametrize("flt", FILTERS, ids=lambda f: f"{f.start}-{f.end}-{len(f.states)}")
def test_equal_to_the_cards(spark, model_small, saved, flt):
    assert cells.kpi_cards_saved(spark, flt, saved).collect() == dashboard.kpi_cards(model_small, flt).collect()


def test_sketches_are_close(spark, model_small, saved):
    want = dashboard.kpi_cards(model_small).first()
    got = cells.kpi_cards_saved(spark, root=saved, exact=False).first()
    assert abs(got.customers - want.customers) <= 0.05 * want.customers and got.revenue == want.revenue
    plain = cells.save_sales_cells(model_small, saved + "/plain")
    with pytest.raises(ValueError):
        cells.cards_from_cells(*plain, exact=False)


def test_a_click_reads_the_saved_tables_only(spark, saved):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        cells.kpi_cards_saved(spark, FILTERS[2], saved).explain("formatted")
    plan = buf.getvalue()
    assert cells.CELLS in plan and cells.BITMAPS in plan and "lineitem" not in plan
    assert plan.count("Location:") == 2


def test_whole_months_are_read_as_months(spark, saved):
    bitmaps = spark.read.parquet(f"{saved}/{cells.BITMAPS}/" + next(
        p for p in open(f"{saved}/{cells.BITMAPS}/_current").read().split()))
    days = lambda flt: bitmaps.filter(cells.bitmap_rows(flt)).agg(F.count("day")).first()[0]
    assert days(SalesFilter("1997-01-01", "1997-12-31")) == 0 == days(SalesFilter())
    assert days(SalesFilter("1997-01-31", "1997-12-31")) > 0


def test_many_buckets_and_reviews(spark, tmp_path, monkeypatch):
    """Customers over several bitmap buckets, reviews that repeat items, customers who come back."""
    rnd = random.Random(2)
    monkeypatch.setattr(cells, "global_rank", lambda df, order, rank_col: df.withColumn(
        rank_col, F.col("customer_id").substr(2, 9).cast("long") * 9001 + 1))  # numbers far apart: one bucket per few customers
    orders = [(f"o{i}", f"c{rnd.randrange(40)}", "delivered" if i % 9 else "lost", f"2020-0{1 + i % 4}-{1 + i % 28:02d} 10:00:00") for i in range(300)]
    items = [(f"o{rnd.randrange(300)}", "p", rnd.randrange(1, 90), 1) for _ in range(700)]
    customers = [(f"c{k}", f"S{k % 3}" if k else None, "x") for k in range(40)]
    reviews = [(f"o{rnd.randrange(300)}", rnd.choice([None, 1, 5])) for _ in range(400)]
    model = simple_model(spark, orders, items, customers, reviews=reviews)
    for flt in (SalesFilter(), SalesFilter("2020-01-09", "2020-03-31", ("S1", "S2")), SalesFilter("2020-02-01", "2020-02-29")):
        tables = cells.save_sales_cells(model, str(tmp_path))
        assert tables[1].agg(F.count_distinct("bucket")).first()[0] > 5
        assert cells.cards_from_cells(*tables, flt).collect() == dashboard.kpi_cards(model, flt).collect()
