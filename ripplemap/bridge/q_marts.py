"""Warehouse queries: staging, marts, segments and the combined check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.bridge.registry import query
from ripplemap.bridge.q_catalog import _SEGMENT
from ripplemap.bridge.tables import Driver
from ripplemap.marts import facts, staging
from ripplemap.marts.segments import customer_segments


def _usd(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 2))
    return df


@query("t1_stg_users", "SELECT * FROM fx_stg_users")
def _(d: Driver) -> DataFrame:
    return staging.stg_users(d.raw_users())


@query("t2_stg_orders", "SELECT * FROM fx_stg_orders")
def _(d: Driver) -> DataFrame:
    return staging.stg_orders(d.raw_orders())


@query("t3_stg_order_items", "SELECT item_id, order_id, sku, quantity, unit_price_usd::DOUBLE AS unit_price_usd FROM fx_stg_items")
def _(d: Driver) -> DataFrame:
    return staging.stg_order_items(d.raw_order_items())


@query("t4_stg_payments", "SELECT payment_id, order_id, amount_usd::DOUBLE AS amount_usd, method, paid_at FROM fx_stg_payments")
def _(d: Driver) -> DataFrame:
    return staging.stg_payments(d.raw_payments())


@query(
    "t5_stg_refunds",
    "SELECT refund_id, order_id, refund_amount_usd::DOUBLE AS refund_amount_usd, refund_date, reason FROM fx_stg_refunds",
)
def _(d: Driver) -> DataFrame:
    return staging.stg_refunds(d.raw_refunds())


@query(
    "t6_finance_summary",
    """SELECT 'Q' || p AS period, r_name AS region, (r_regionkey::BIGINT + 1) * p * 1000 AS reported_revenue_usd
FROM region CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS p)""",
)
def _(d: Driver) -> DataFrame:
    return staging.mart_finance_summary(d.finance_extract())


@query(
    "t7_dim_customers",
    """SELECT u.user_id, u.email, u.country, u.signup_date, o.first_order_date, o.last_order_date,
  coalesce(o.n, 0) AS order_count FROM fx_stg_users u LEFT JOIN (
  SELECT cust_id, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) AS n
  FROM fx_stg_orders GROUP BY cust_id) o ON o.cust_id = u.user_id""",
)
def _(d: Driver) -> DataFrame:
    s = d.staging()
    return facts.dim_customers(s["stg_users"], s["stg_orders"])


@query(
    "t8_fct_orders",
    """SELECT o.*, coalesce(i.units, 0)::BIGINT AS total_units, round(coalesce(i.gross, 0)::DOUBLE, 2) AS gross_value_usd
FROM fx_stg_orders o LEFT JOIN (
  SELECT order_id, sum(quantity) AS units, sum(quantity * unit_price_usd) AS gross FROM fx_stg_items GROUP BY order_id) i
USING (order_id)""",
)
def _(d: Driver) -> DataFrame:
    s = d.staging()
    return _usd(facts.fct_orders(s["stg_orders"], s["stg_order_items"]), "gross_value_usd")


@query(
    "t9_fct_revenue",
    """SELECT order_id, cust_id, order_date, round(gross_revenue_usd, 2) AS gross_revenue_usd,
  round(refunded_usd, 2) AS refunded_usd, round(net_revenue_usd, 2) AS net_revenue_usd FROM fx_revenue""",
)
def _(d: Driver) -> DataFrame:
    return _usd(d.revenue(), "gross_revenue_usd", "refunded_usd", "net_revenue_usd")


@query(
    "t10_customer_ltv",
    """SELECT cust_id, paid_order_count, round(lifetime_value_usd, 2) AS lifetime_value_usd, first_paid_date,
  last_paid_date FROM fx_ltv""",
)
def _(d: Driver) -> DataFrame:
    return _usd(d.ltv(), "lifetime_value_usd")


@query(
    "t11_customer_segments",
    f"SELECT cust_id, round(lifetime_value_usd, 5) AS lifetime_value_usd, {_SEGMENT} AS segment FROM fx_segment_input",
)
def _(d: Driver) -> DataFrame:
    segments = customer_segments(d.segment_input())
    return segments.withColumn("lifetime_value_usd", F.round("lifetime_value_usd", 5))


@query("t12_order_totals", "SELECT * FROM fx_order_totals")
def _(d: Driver) -> DataFrame:
    return facts.order_totals(d.raw_order_items(), d.raw_orders())


@query(
    "t13_seeded_share",
    """SELECT payment_id, amount_cents FROM fx_raw_payments
QUALIFY row_number() OVER (ORDER BY md5('seed-42' || payment_id), payment_id) <= (SELECT round(count(*) * 0.08) FROM fx_raw_payments)""",
)
def _(d: Driver) -> DataFrame:
    payments = d.raw_payments().select("payment_id", "amount_cents")
    return facts.seeded_share(payments, "payment_id", 0.08, "seed-42")


# Models of the combined check; inputs in braces.
CHECK_MODELS = {
    "shop_orders": "SELECT order_id, cust_id, order_date FROM {stg_orders}",
    "order_counts": "SELECT cust_id, count(*) AS orders, min(order_date) AS since FROM {shop_orders} GROUP BY cust_id",
    "paid_orders": "SELECT p.order_id, o.cust_id, p.amount_usd FROM {stg_payments} p "
    "JOIN {shop_orders} o ON o.order_id = p.order_id",
    "order_days": "SELECT order_date, count(*) AS orders FROM {shop_orders} GROUP BY order_date",
}


@query(
    "m15_combined_check",
    """SELECT variant, model, attempt, exit_code, CASE WHEN exit_code = 0 THEN n END AS "rows", exit_code = 0 AS matches
FROM (SELECT * FROM (VALUES ('change_only', 1), ('change_and_edits', 2)) v(variant, attempt)) v
CROSS JOIN (
  SELECT 'shop_orders' AS model, false AS reads, count(*) AS n FROM fx_stg_orders
  UNION ALL SELECT 'order_counts', true, count(DISTINCT cust_id) FROM fx_stg_orders
  UNION ALL SELECT 'paid_orders', true, count(*) FROM fx_stg_payments
  UNION ALL SELECT 'order_days', false, count(DISTINCT order_date) FROM fx_stg_orders) m
CROSS JOIN LATERAL (SELECT CASE WHEN v.variant = 'change_only' AND m.reads THEN 1 ELSE 0 END AS exit_code)""",
)
def _(d: Driver) -> DataFrame:
    from ripplemap.plans.combined import combined_check

    s = d.staging()
    inputs = {"stg_orders": s["stg_orders"], "stg_payments": s["stg_payments"]}
    change = {"model": "shop_orders", "column": "cust_id", "new_value": "customer_id"}
    checked = combined_check(d.spark, inputs, CHECK_MODELS, change, ["order_counts", "paid_orders"])
    return checked.drop("output_tail")
