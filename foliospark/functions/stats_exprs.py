"""Statistics as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import as_col

Z95 = 1.959963984540054


def wilson(successes: Column | str, n: Column | str, z: float = Z95) -> Column:
    """Score interval of a share as a struct estimate, low, high; exact 0 and 1 at the edges; null for n = 0."""
    k, n = as_col(successes).cast("double"), as_col(n).cast("double")
    p = k / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    low = F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, F.struct(p.alias("estimate"), low.alias("low"), high.alias("high")))
