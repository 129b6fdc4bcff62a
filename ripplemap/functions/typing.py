"""Native column type to type family."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplemap.functions.constants import TYPE_FAMILIES


def type_family(native: Column) -> Column:
    upper = F.upper(native)
    branches = [
        (reduce(lambda a, b: a | b, [F.contains(upper, F.lit(k)) for k in keys]), family)
        for family, keys in TYPE_FAMILIES
    ]
    out = F.when(branches[0][0], branches[0][1])
    for condition, family in branches[1:]:
        out = out.when(condition, family)
    return out.otherwise("string")
