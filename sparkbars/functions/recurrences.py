"""Exponential recurrences as plain running sums, without UDFs or per-symbol arrays.

e(0) = x(0), e(t) = a*x(t) + (1-a)*e(t-1) has the closed form
q^t * (x(0) + sum a*x(i)*q^-i) with q = 1-a, which is a running sum. Rows are cut into
blocks so that q^-i cannot overflow. A block takes over the end value of the block before
it; anything older is damped by q^length, below double precision: factors for which BLOCK
rows are too few or too many get blocks of their own length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbars.functions.windows import BLOCK


def span(n: int) -> float:
    return 2.0 / (n + 1)


def center_of_mass(c: float) -> float:
    return 1.0 / (1.0 + c)


def block_length(alpha: float) -> int:
    """Rows of a block: BLOCK where q^BLOCK is below double precision and q^-BLOCK is a double, else as many as fit."""
    digits = -math.log10(1.0 - alpha)
    return BLOCK if 16 / BLOCK <= digits <= 290 / BLOCK else max(1, int(280 / digits))


def ewm(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, float]]) -> DataFrame:
    """Add one smoothed column per spec ``{output: (input, alpha)}`` with 0 < alpha <= 1; df needs rn and blk.

    Rows with rn 0 are before the series starts and stay null. Specs of one block length share the same two window passes.
    """
    local, final, blocks = {}, {}, {}
    for out, (source, alpha) in specs.items():
        if alpha == 1.0:
            final[out] = F.col(source)
            continue
        length = block_length(alpha)
        if length == BLOCK:
            block = "blk"
        else:
            block = f"_blk{length}"
            blocks[block] = F.floor((F.col("rn") - 1) / length).cast("int")
        place = ((F.col("rn") - 1) % length).cast("double")
        in_block = Window.partitionBy(*keys, block).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        before = (Window.partitionBy(*keys) if keys else Window).orderBy(block).rangeBetween(-1, -1)
        q = 1.0 - alpha
        gain = F.when(F.col("rn") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
        term = F.when(F.col("rn") > 0, gain * F.col(source) * F.pow(F.lit(q), -place))
        local[f"_{out}"] = F.pow(F.lit(q), place) * F.sum(term).over(in_block)
        ends = F.when((place == length - 1) & (F.col("rn") > 0), F.col(f"_{out}"))
        carry = F.coalesce(F.sum(ends).over(before), F.lit(0.0))
        final[out] = F.when(F.col("rn") > 0, F.col(f"_{out}") + carry * F.pow(F.lit(q), place + 1))
    return df.withColumns(blocks).withColumns(local).withColumns(final).drop(*local, *blocks)
