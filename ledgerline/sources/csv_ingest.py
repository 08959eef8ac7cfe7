"""CSV ingest of the nine source tables into typed Parquet tables, and the load/audit around it.

Files are read with their header as text; the columns the jobs use get declared types, ``infer=True`` also types the
others, and every other column stays text. Types never lose anything: a column's
values are checked first, in one aggregate per table, money takes the scale its text needs, and a value that can't be read as
its type (a time with an offset, say) stops the load with the count of such values per column (or, on request, goes to a reject table as
whole rows). Inference rides in the same aggregate: each value has a bit per type from which its very text could be written again, and
the bits common to all values decide; leading zeros, offsets and exponents so stay text. All inputs are checked first and a single error
names every missing one. Tables are loaded side by side, each file is parsed twice (check, write), and a table is replaced only
when its new version is complete.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.model import LOGICAL_TABLES, SalesModel
from ledgerline.sources.multiline_csv import read_multiline_csv
from ledgerline.sources.tables import replace_folder

# Input file of each logical table (public e-commerce dataset layout).
CSV_FILES = {
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
    "geolocation": "olist_geolocation_dataset.csv",
}

MONEY = "money"  # DECIMAL with the scale the column's text needs (two places at least)

# Declared types of the columns the jobs read.
TYPED_COLUMNS = {
    "orders": {"order_purchase_timestamp": "timestamp_ntz"},
    "order_items": {"price": MONEY, "freight_value": MONEY},
    "order_payments": {"payment_value": MONEY},
    "order_reviews": {"review_score": "int"},
}

# Unique keys the jobs rely on (see ledgerline.model).
UNIQUE_KEYS = {"orders": "order_id", "customers": "customer_id", "products": "product_id"}

# Tables whose text fields may contain quoted line breaks (free-text review comments): their files are cut into records first
# (ledgerline.sources.multiline_csv), so that a file is still read by many tasks.
MULTILINE_TABLES = ("order_reviews",)
PARALLEL_TABLES = 4


def _read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """RFC 4180 CSV as text columns: header row, '"' quotes escaped by doubling. A record that does not fit the header is an error."""
    if multiline:
        return read_multiline_csv(spark, path)
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    # a UTF-8 byte-order mark at the start of a file would otherwise stick to the first header
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def _missing(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return True
        raise
    return False


def each_table(names, work) -> dict:
    """``work(name)`` of several tables side by side: their jobs are small next to a cluster."""
    names = list(names)
    with ThreadPoolExecutor(max_workers=max(1, min(PARALLEL_TABLES, len(names)))) as pool:
        return dict(zip(names, pool.map(work, names)))


def read_csv_tables(spark: SparkSession, data_dir: str, files: dict[str, str] | None = None,
                    infer: bool = False, rejects: str | None = None) -> dict[str, DataFrame]:
    """The typed tables. ``rejects``: a folder that takes the rows with unreadable values, as text, one
    Parquet table per source table; without it such rows stop the load."""
    paths = {table: f"{data_dir.rstrip('/')}/{name}" for table, name in (files or CSV_FILES).items()}
    missing = [path for path in paths.values() if _missing(spark, path)]
    if missing:
        raise FileNotFoundError("Missing input files: " + ", ".join(missing))
    return each_table(paths, lambda table: _typed(
        table, _read_csv(spark, paths[table], table in MULTILINE_TABLES), dict(TYPED_COLUMNS.get(table, {})), infer, rejects))


NUMBER = r"^\s*[+-]?([0-9]+)?(\.([0-9]*))?\s*$"
#: What a declared type may look like; casts alone would drop an offset or a fraction.
READABLE = {
    "int": r"^\s*[+-]?[0-9]+\s*$",
    "timestamp_ntz": r"^\s*[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]{0,6})?)?)?\s*$",
}


def _unreadable(col: str, kind: str) -> Column:
    """Text that is there but can't be read as its type without loss."""
    c = F.col(f"`{col}`")
    if kind == MONEY:
        return c.isNotNull() & ~(c.rlike(NUMBER) & c.rlike("[0-9]"))
    shaped = c.rlike(READABLE[kind]) if kind in READABLE else F.lit(True)
    return c.isNotNull() & (~shaped | F.trim(c).try_cast(kind).isNull())


#: Inferred types in the order of choice.
KINDS = ("boolean", "int", "bigint", "double", "decimal", "date", "timestamp_ntz")
PLAIN = r"^-?(0|[1-9][0-9]*)(\.([0-9]+))?$"
EXACT_DIGITS = 15  # a decimal of so many digits survives a double


def open_kinds(text: Column) -> Column:
    """A bit per type of ``KINDS`` that can give the value's text again; all bits for null."""
    again = lambda kind: text.try_cast(kind).cast("string") == text
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[-.]", ""), "^0+", ""))
    plain = text.rlike(PLAIN)
    fits = {
        "boolean": text.isin("true", "false"), "int": again("int"), "bigint": again("bigint"),
        "double": plain & ~text.rlike(r"\.[0-9]*0$") & (digits <= EXACT_DIGITS) & (text != "-0"),
        "decimal": plain & (digits <= 38) & ~text.rlike(r"^-[0.]*$"),  # if all values have the same number of places
        "date": again("date"), "timestamp_ntz": again("timestamp_ntz"),
    }
    bits = sum((F.when(F.coalesce(fits[k], F.lit(False)), 1 << i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    return F.when(text.isNull(), (1 << len(KINDS)) - 1).otherwise(bits)


def _inference(c: str) -> list[Column]:
    """The aggregates that decide the type of column ``c``."""
    text = F.col(f"`{c}`")
    places = F.length(F.regexp_extract(text, PLAIN, 3))
    return [F.bit_and(open_kinds(text)).alias(f"kinds_{c}"), F.count(text).alias(f"there_{c}"), F.min(places).alias(f"least_{c}"),
            F.max(places).alias(f"most_{c}"), F.max(F.length(F.regexp_extract(text, PLAIN, 1))).alias(f"digits_{c}")]


def _inferred(c: str, found) -> str | None:
    """The first type that is open for all values; None is text."""
    if not found[f"there_{c}"]:
        return None
    for i, kind in enumerate(KINDS):
        if found[f"kinds_{c}"] >> i & 1:
            if kind != "decimal":
                return kind
            width = found[f"digits_{c}"] + found[f"most_{c}"]
            if found[f"least_{c}"] == found[f"most_{c}"] and width <= 38:
                return f"decimal({width},{found[f'most_{c}']})"
    return None


def _typed(table: str, df: DataFrame, types: dict[str, str], infer: bool, rejects: str | None) -> DataFrame:
    types = {c: t for c, t in types.items() if c in df.columns}
    open_columns = [c for c in df.columns if c not in types] if infer else []
    if not types and not open_columns:
        return df
    checks = []
    for c, kind in types.items():
        checks.append(F.count_if(_unreadable(c, kind)).alias(f"bad_{c}"))
        if kind == MONEY:
            whole = F.length(F.regexp_replace(F.regexp_extract(c, NUMBER, 1), "^0+", ""))
            checks += [F.max(whole).alias(f"whole_{c}"), F.max(F.length(F.regexp_extract(c, NUMBER, 3))).alias(f"scale_{c}")]
    for c in open_columns:
        checks += _inference(c)
    found = df.agg(*checks).first()
    bad = {c: found[f"bad_{c}"] for c in types if found[f"bad_{c}"]}
    if bad and not rejects:
        raise ValueError(f"{table}: values that can't be read as declared: " + ", ".join(f"{c} {n}" for c, n in bad.items()))
    if bad:
        wrong = reduce(Column.__or__, [_unreadable(c, types[c]) for c in bad])
        replace_folder(df.sparkSession, f"{rejects.rstrip('/')}/{table}", df.filter(wrong).write.parquet)
        df = df.filter(~wrong)
    casts = {c: kind for c in open_columns if (kind := _inferred(c, found))}
    for c, kind in types.items():
        if kind == MONEY:
            whole, scale = found[f"whole_{c}"] or 0, max(2, found[f"scale_{c}"] or 0)
            if whole + scale > 38:
                raise ValueError(f"{table}.{c}: amounts need {whole + scale} digits; 38 are possible")
            kind = f"decimal({min(38, max(12, whole + scale))},{scale})"
        casts[c] = kind
    return df.select(*[F.trim(F.col(f"`{c}`")).cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns])


# Tables keyed by order: bucketing them alike lets the item -> order aggregate and the joins on
# order_id run without any shuffle.
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")
MONTH = "order_month"


def ingest_tables(spark: SparkSession, data_dir: str, out_dir: str,
                  files: dict[str, str] | None = None,
                  orders_by_month: bool = False, buckets: int | None = None,
                  table_prefix: str = "sales_", infer: bool = False, rejects: str | None = None) -> DataFrame:
    """Replace each table under ``out_dir/<table>`` with the typed CSV contents; return the
    audit of what was written (:func:`column_audit_of`).

    ``orders_by_month``: store orders and their items partitioned by purchase month, so date-range jobs read only
    the months they need. ``buckets``: store the order-keyed tables bucketed (and sorted) by
    ``order_id`` into that many buckets, registered as external catalog tables
    ``<table_prefix><table>`` over ``out_dir``; read them back with :func:`load_model` and the
    same prefix. ``infer`` and ``rejects``: see :func:`read_csv_tables`."""
    frames = read_csv_tables(spark, data_dir, files, infer, rejects)
    base = out_dir.rstrip("/")
    if orders_by_month and "orders" in frames:
        month = F.trunc(F.to_date("order_purchase_timestamp"), "month").alias(MONTH)
        months = frames["orders"].select("order_id", month)
        frames["orders"] = frames["orders"].select("*", month)
        if "order_items" in frames:
            frames["order_items"] = frames["order_items"].join(months, on="order_id", how="left")

    def load(table: str) -> None:
        df, path = frames[table], f"{base}/{table}"
        months = [MONTH] if MONTH in df.columns else []
        if buckets and table in ORDER_KEYED:
            _replace_bucketed(spark, df, f"{table_prefix}{table}", path, buckets, months)
        else:
            replace_folder(spark, path, df.write.partitionBy(*months).parquet)

    each_table(frames, load)
    return column_audit_of(_open_tables(spark, base, list(frames), table_prefix if buckets else None))


def _replace_bucketed(spark: SparkSession, df: DataFrame, name: str, path: str, buckets: int, months: list[str]) -> None:
    """The external catalog table ``name`` over ``path``: written in full beside it, then both folder and entry change over."""
    def write(folder: str) -> None:
        fresh = f"{name}_next_{folder.rsplit('-', 1)[-1]}"
        df.write.partitionBy(*months).bucketBy(buckets, "order_id").sortBy("order_id").option("path", folder).saveAsTable(fresh)
        spark.sql(f"DROP TABLE `{fresh}`")  # external: the files stay

    replace_folder(spark, path, write)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet " + (f"PARTITIONED BY (`{MONTH}`) " if months else "")
              + f"CLUSTERED BY (order_id) SORTED BY (order_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    if months:
        spark.sql(f"ALTER TABLE `{name}` RECOVER PARTITIONS")


def _open_tables(spark: SparkSession, table_dir: str, names, table_prefix: str | None):
    out = {}
    for name in names:
        if table_prefix and name in ORDER_KEYED:
            out[name] = spark.table(f"{table_prefix}{name}")  # an absent table is an error, not a lost layout
        else:
            out[name] = spark.read.parquet(f"{table_dir.rstrip('/')}/{name}")
    return out


def load_model(spark: SparkSession, table_dir: str, delivered: str = "delivered",
               table_prefix: str | None = None) -> SalesModel:
    """A model over tables written by :func:`ingest_tables` (``table_prefix`` when the
    order-keyed tables were bucketed)."""
    return SalesModel(delivered=delivered, **_open_tables(spark, table_dir, LOGICAL_TABLES, table_prefix))


def row_count_audit_of(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def row_count_audit(model: SalesModel) -> DataFrame:
    """(tbl, rows) for all nine logical tables."""
    return row_count_audit_of(model.tables())


def column_audit_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, col, rows, nulls, total): one row per column; ``total`` is the exact sum of a DECIMAL
    column as text at four places or its own scale, null for other types. One aggregate per table."""
    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema if f.name != MONTH]
        total = lambda f: F.sum(f.name).cast(T.DecimalType(38, max(4, f.dataType.scale))).cast("string") \
            if isinstance(f.dataType, T.DecimalType) else F.lit(None).cast("string")
        each = F.array(*[F.struct(F.lit(f.name).alias("col"), F.count(F.lit(1)).alias("rows"),
                                  F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"), total(f).alias("total")) for f in fields])
        parts.append(df.agg(each.alias("each")).select(F.lit(name).alias("tbl"), F.explode("each").alias("e")).select("tbl", "e.*"))
    return reduce(DataFrame.unionAll, parts)


def key_audit(model: SalesModel) -> DataFrame:
    """(tbl, key, rows, distinct_keys, null_keys): the jobs need rows = distinct_keys for each of these tables."""
    parts = [model.table(t).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(k).alias("distinct_keys"), F.count_if(F.col(k).isNull()).alias("null_keys"))
             .select(F.lit(t).alias("tbl"), F.lit(k).alias("key"), "rows", "distinct_keys", "null_keys") for t, k in UNIQUE_KEYS.items()]
    return reduce(DataFrame.unionAll, parts)


def schema_summary(model: SalesModel) -> DataFrame:
    """(table, rows, columns) for all nine logical tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
             for name, df in model.tables().items()]
    return reduce(DataFrame.unionAll, parts)
