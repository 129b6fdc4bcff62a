"""Customer, order and revenue marts, and the data steps that feed the raw tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_customers(users: DataFrame, orders: DataFrame) -> DataFrame:
    per_user = orders.groupBy(F.col("cust_id").alias("user_id")).agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count(F.lit(1)).alias("_n"),
    )
    return users.join(per_user, "user_id", "left").select(
        "user_id", "email", "country", "signup_date", "first_order_date", "last_order_date",
        F.coalesce("_n", F.lit(0)).alias("order_count"),
    )


def fct_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    sums = items.groupBy("order_id").agg(
        F.sum("quantity").alias("_units"),
        F.sum(F.col("quantity") * F.col("unit_price_usd")).alias("_gross"),
    )
    return orders.join(sums, "order_id", "left").select(
        "order_id", "cust_id", "order_date", "status", "channel",
        F.coalesce("_units", F.lit(0)).alias("total_units"),
        F.coalesce("_gross", F.lit(0.0)).alias("gross_value_usd"),
    )


def fct_revenue(payments: DataFrame, orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Refund sums are taken per order before the join."""
    refunded = refunds.groupBy("order_id").agg(F.sum("refund_amount_usd").alias("_refunded"))
    back = F.coalesce("_refunded", F.lit(0.0))
    return (
        payments.select("order_id", "amount_usd")
        .join(orders.select("order_id", "cust_id", "order_date"), "order_id")
        .join(refunded, "order_id", "left")
        .select(
            "order_id", "cust_id", "order_date",
            F.col("amount_usd").alias("gross_revenue_usd"),
            back.alias("refunded_usd"),
            (F.col("amount_usd") - back).alias("net_revenue_usd"),
        )
    )


def customer_ltv(revenue: DataFrame) -> DataFrame:
    return revenue.groupBy("cust_id").agg(
        F.count_distinct("order_id").alias("paid_order_count"),
        F.sum("net_revenue_usd").alias("lifetime_value_usd"),
        F.min("order_date").alias("first_paid_date"),
        F.max("order_date").alias("last_paid_date"),
    )


def order_totals(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Cents per completed order, zero where an order has no items."""
    sums = items.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price_cents")).alias("_cents")
    )
    return (
        orders.filter(F.col("status") == "completed")
        .join(sums, "order_id", "left")
        .select("order_id", "order_date", "channel", F.coalesce("_cents", F.lit(0)).alias("amount_cents"))
    )


DIGITS = 4


def seeded_share(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """A fixed-size pseudo-random share of the rows: the first ``round(share · n)`` in hash order.

    The cut is found by radix selection: rows are counted by the next four hex digits of their hash,
    at most 65,536 numbers, and only the digits that hold the cut are gone into, until a whole bucket
    ends there. The share is then a filter. Rows of one key follow each other by a hash of the whole
    row; of rows that are equal, as many are taken as belong to the share. An empty table gives none.
    """
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    digest = F.concat(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), F.md5(row))
    hashed = df.withColumn("_h", F.coalesce(digest, F.concat(F.lit("0" * 32), F.md5(row))))
    need = int(df.agg(F.round(F.count(F.lit(1)) * share)).first()[0])
    if need <= 0:
        return df.limit(0)
    prefix = ""
    while len(prefix) < 64:
        inside = hashed.filter(F.col("_h").startswith(prefix))
        digits = F.substring("_h", len(prefix) + 1, DIGITS).alias("digits")
        counts = inside.groupBy(digits).agg(F.count(F.lit(1)).alias("n")).orderBy("digits").collect()
        for r in counts:
            if r["n"] >= need:
                break
            need -= r["n"]
        prefix += r["digits"]
        if r["n"] == need:
            return hashed.filter(F.substring("_h", 1, len(prefix)) <= prefix).select(*df.columns)
    below = hashed.filter(F.col("_h") < prefix).select(*df.columns)
    return below.unionByName(hashed.filter(F.col("_h") == prefix).select(*df.columns).limit(need))
