"""Staging models: projections of the raw tables, money from cents to currency."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usd(cents: str) -> Column:
    return F.col(cents) / F.lit(100.0)


def stg_users(raw_users: DataFrame) -> DataFrame:
    """Test users are left out; an unknown flag drops the row as well."""
    return raw_users.filter(~F.col("is_test")).select("user_id", "email", "signup_date", "country")


def stg_orders(raw_orders: DataFrame) -> DataFrame:
    return raw_orders.select("order_id", "cust_id", "order_date", "status", "channel")


def stg_order_items(raw_items: DataFrame) -> DataFrame:
    return raw_items.select(
        "item_id", "order_id", "sku", "quantity", usd("unit_price_cents").alias("unit_price_usd")
    )


def stg_payments(raw_payments: DataFrame) -> DataFrame:
    return raw_payments.select(
        "payment_id", "order_id", usd("amount_cents").alias("amount_usd"), "method", "paid_at"
    )


def stg_refunds(raw_refunds: DataFrame) -> DataFrame:
    return raw_refunds.select(
        "refund_id", "order_id", usd("refund_amount_cents").alias("refund_amount_usd"),
        "refund_date", "reason",
    )


def mart_finance_summary(extract: DataFrame) -> DataFrame:
    return extract.select("period", "region", "reported_revenue_usd")
