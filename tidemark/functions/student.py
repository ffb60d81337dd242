"""Student t distribution as a plain expression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes of the quadrature and steps of the normalizing product: the same work for any degrees of freedom.
NODES, SHIFT = 192, 24
#: Asymptotic series of the ratio of the gamma function at z + 1/2 and z, over sqrt(z), in powers of 1/z.
SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)
#: From ``MANY`` degrees of freedom on, no statistic beyond ``FAR`` has a p-value above 1e-30.
MANY, FAR = 30, 60.0


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value, with work that does not depend on the degrees of freedom.

    With theta = atan(|t| / sqrt(df)) the central probability is the integral of cos^(df - 1) from 0 to theta over that from 0 to
    pi / 2. The first is a Gauss-Legendre sum; the second is sqrt(pi) / 2 times the ratio of the gamma function at df / 2 and
    (df + 1) / 2, from its asymptotic series after ``SHIFT`` steps of the recurrence.
    """
    df = df.cast("double")
    size = F.when(df < MANY, F.abs(t)).otherwise(F.least(F.abs(t), F.lit(FAR)))
    theta = F.atan(size / F.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    table = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(nodes, weights, strict=True)])

    def add(total: Column, node: Column) -> Column:
        sine = F.sin(theta * node["x"])
        return total + node["w"] * F.exp((df - 1) / 2 * F.log1p(-sine * sine))

    integral = theta * F.aggregate(table, F.lit(0.0), add)
    a = df / 2
    z = a + SHIFT
    series = F.sqrt(z) * sum((F.lit(c) / F.pow(z, F.lit(i)) for i, c in enumerate(SERIES)), F.lit(0.0))
    steps = F.array(*[F.lit(float(j)) for j in range(SHIFT)])
    ratio = series * F.aggregate(steps, F.lit(1.0), lambda product, j: product * (a + j) / (a + j + 0.5))
    central = integral * ratio * F.lit(2 / math.sqrt(math.pi))
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), F.lit(1.0) - central))
