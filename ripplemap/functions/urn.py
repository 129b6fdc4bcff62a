"""Build and parse dataset, field and registry URNs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplemap.functions.constants import ENV, REGISTRY_PLATFORM, URN_PATTERN


def dataset_urn(platform: Column, name: Column, env: str = ENV) -> Column:
    return F.concat(
        F.lit("urn:li:dataset:(urn:li:dataPlatform:"), platform, F.lit(","), name, F.lit(f",{env})")
    )


def field_urn(urn: Column, column: Column) -> Column:
    return F.concat(F.lit("urn:li:schemaField:("), urn, F.lit(","), column, F.lit(")"))


def registry_urn(platform: Column) -> Column:
    return dataset_urn(F.lit(REGISTRY_PLATFORM), F.concat(F.lit("registry."), platform))


def _part(urn: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(urn, URN_PATTERN, group), F.lit(""))


def urn_platform(urn: Column) -> Column:
    """Platform of a dataset URN, null when the text is not one."""
    return _part(urn, 1)


def urn_name(urn: Column) -> Column:
    return _part(urn, 2)


_HEAD = "urn:li:dataset:(urn:li:dataPlatform:"
_TAIL = f",{ENV})"


def compact(urn: Column) -> Column:
    """Short join key of a dataset URN: ``platform,name``. Any other text stays as it is.

    Keys are a third of the length of URNs, which is what the expansion shuffles. ``expanded`` is
    the exact inverse: texts that a short key could be mistaken for are not shortened.
    """
    short = F.substr(urn, F.lit(len(_HEAD) + 1), F.length(urn) - (len(_HEAD) + len(_TAIL)))
    fits = urn.startswith(_HEAD) & urn.endswith(_TAIL) & ~urn.startswith(_HEAD + "urn:")
    return F.when(fits, short).otherwise(F.concat(F.lit("urn:"), urn))


def dataset_key(platform: Column, name: Column) -> Column:
    """``compact(dataset_urn(platform, name))`` without making the URN first."""
    urn = F.concat(F.lit("urn:"), dataset_urn(platform, name))
    return F.when(platform.startswith("urn:"), urn).otherwise(F.concat(platform, F.lit(","), name))


def expanded(key: Column) -> Column:
    return F.when(key.startswith("urn:"), F.substring(key, 5, 2_147_483_647)).otherwise(
        F.concat(F.lit(_HEAD), key, F.lit(_TAIL))
    )


def key_kind(key: Column) -> Column:
    """The platform of a compact key, for most; any text before a comma will do."""
    return F.substring_index(key, ",", 1)


def key_platform(key: Column) -> Column:
    """Platform of the URN behind a short key, null when that is not a dataset URN.

    A short key with one comma between two texts says it itself; only others are matched as URNs.
    """
    comma = F.instr(key, ",")
    rest = F.substr(key, comma + 1)
    plain = (comma > 1) & (F.length(rest) > 0) & (F.instr(rest, ",") == 0) & ~key.startswith("urn:")
    return F.when(plain, F.substr(key, F.lit(1), comma - 1)).otherwise(urn_platform(expanded(key)))
