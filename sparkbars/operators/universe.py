"""Symbol universe: code normalisation, eligibility filters and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exchange_code(code: Column) -> Column:
    """Six-digit code with its exchange suffix, null for other boards."""
    return F.when(code.startswith("6"), F.concat(code, F.lit(".SH"))).when(
        code.startswith("0") | code.startswith("3"), F.concat(code, F.lit(".SZ")))


def vendor_code(symbol: Column) -> Column:
    """600519.SH -> sh.600519"""
    return F.concat(F.lower(F.split_part(symbol, F.lit("."), F.lit(2))), F.lit("."), F.split_part(symbol, F.lit("."), F.lit(1)))


def from_vendor(code: Column) -> Column:
    """sh.600519 -> 600519.SH"""
    return F.concat(F.split_part(code, F.lit("."), F.lit(2)), F.lit("."), F.upper(F.split_part(code, F.lit("."), F.lit(1))))


def regular_name(name: Column) -> Column:
    """Name prefixes of specially treated and newly listed symbols."""
    return ~(name.startswith("ST") | name.startswith("*ST") | name.startswith("N"))


def eligible(df: DataFrame, listed_before: Column) -> DataFrame:
    listed = F.col("symbol").endswith(".SH") | F.col("symbol").endswith(".SZ")
    board = ~(F.col("symbol").startswith("8") | F.col("symbol").startswith("9"))
    return df.where(listed & board & regular_name(F.col("name")) & (F.col("list_date") < listed_before))


def tradable(df: DataFrame, least_price: float = 3.0) -> DataFrame:
    """Spot rows worth scanning."""
    keep = regular_name(F.col("name")) & ~F.col("name").contains("退") & (F.col("volume") > 0)
    df = df.withColumn("symbol", exchange_code(F.col("code")))
    return df.where(keep & F.col("symbol").isNotNull() & (F.col("last") >= least_price))


def sample(df: DataFrame, n: int, seed: str) -> DataFrame:
    """Reproducible sample: the n smallest hashes, a distributed top-n."""
    return df.withColumn("key", F.md5(F.concat(F.lit(seed), F.col("sym").cast("string")))).orderBy("key").limit(n)


def strong_industries(changes: DataFrame) -> DataFrame:
    """Industries whose change is at least the median; one row per industry comes in."""
    return changes.where(F.col("change") >= changes.agg(F.median("change")).scalar()).select("industry")
