"""Value segments with right-closed bins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: upper bounds and labels --------------------------------
LOWEST = -1
BINS = ((500, "low"), (2000, "mid"), (10000, "high"))
TOP = "whale"
MISSING = "nan"


def customer_segments(ltv: DataFrame) -> DataFrame:
    value = F.col("lifetime_value_usd")
    label = F.when(value.isNull() | (value <= LOWEST) | F.isnan(value), MISSING)
    for bound, name in BINS:
        label = label.when(value <= bound, name)
    return ltv.select("cust_id", "lifetime_value_usd", label.otherwise(TOP).alias("segment"))
