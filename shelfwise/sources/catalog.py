"""Schemas of the retail tables and explicit readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "products": "product_id STRING, product_name STRING, category STRING, segment STRING, "
    "size STRING, price DOUBLE, cogs DOUBLE",
    "customers": "customer_id STRING, zip STRING, age_group STRING, gender STRING, "
    "acquisition_channel STRING, signup_date DATE",
    "geography": "zip STRING, region STRING, city STRING",
    "promotions": "promo_id STRING, promo_name STRING, promo_type STRING, discount_value DOUBLE, "
    "start_date DATE, end_date DATE, applicable_category STRING, promo_channel STRING, "
    "stackable_flag INT, min_order_value DOUBLE",
    "orders": "order_id STRING, customer_id STRING, order_date DATE, zip STRING, "
    "order_status STRING, payment_method STRING, order_source STRING",
    "order_items": "order_id STRING, product_id STRING, quantity INT, unit_price DOUBLE, "
    "discount_amount DOUBLE, promo_id STRING, promo_id_2 STRING",
    "payments": "order_id STRING, payment_method STRING, payment_value DOUBLE, installments INT",
    "shipments": "order_id STRING, ship_date DATE, delivery_date DATE, "
    "estimated_delivery_date DATE, shipping_fee DOUBLE",
    "returns": "order_id STRING, product_id STRING, return_date DATE, return_reason STRING, "
    "return_quantity INT, refund_amount DOUBLE",
    "reviews": "review_id STRING, order_id STRING, product_id STRING, customer_id STRING, "
    "review_date DATE, rating INT, review_title STRING",
    "sales": "date DATE, revenue DOUBLE, cogs DOUBLE",
    "inventory": "snapshot_date DATE, product_id STRING, stock_on_hand DOUBLE, units_sold DOUBLE, "
    "stockout_days INT, stockout_flag BOOLEAN, fill_rate DOUBLE, days_of_supply DOUBLE, "
    "overstock_flag BOOLEAN, reorder_flag BOOLEAN, reorder_quantity DOUBLE, "
    "sell_through_rate DOUBLE",
    "web_traffic": "date DATE, traffic_source STRING, sessions BIGINT, unique_visitors BIGINT, "
    "page_views BIGINT, bounce_rate DOUBLE, avg_session_duration_sec DOUBLE",
}


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    fmt: str = "csv",
    encoding: str = "UTF-8",
    columns: list[str] | None = None,
) -> DataFrame:
    """Read a table with an explicit schema; bad fields become null.

    ``schema`` is a DDL text or the name of a retail table. Parquet and ORC carry
    their own schema.
    """
    reader = spark.read.format(fmt)
    ddl = SCHEMAS.get(schema or "", schema)
    if ddl:
        reader = reader.schema(ddl)
    if fmt == "csv":
        reader = reader.options(header=True, encoding=encoding, mode="PERMISSIVE")
    df = reader.load(path)
    return df.select(*columns) if columns else df


def read_with_fallback(spark: SparkSession, path: str, schema: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Read text in the first encoding that leaves no replacement character."""
    for encoding in encodings[:-1]:
        df = read_table(spark, path, schema, encoding=encoding)
        texts = [F.col(n) for n, t in df.dtypes if t == "string"]
        broken = F.coalesce(F.concat_ws("", *texts).contains("�"), F.lit(False))
        if df.where(broken).isEmpty():
            return df
    return read_table(spark, path, schema, encoding=encodings[-1])


def conform(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename columns: ``{retail name: source name}``."""
    return df.select(*[F.col(source).alias(name) for name, source in mapping.items()])


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make frames available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql_over_files(spark: SparkSession, text: str, **paths: str) -> DataFrame:
    """Run SQL whose ``{name}`` fields are Parquet paths read in place."""
    return spark.sql(text.format(**{n: f"parquet.`{p}`" for n, p in paths.items()}))
