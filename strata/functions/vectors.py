"""Vector math as Column expressions over ``array<double>``.

Higher-order functions keep this JVM-side; the hot all-vs-queries cosine kernel lives in
``operators.knn`` instead (Arrow batches + BLAS), where it pays off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(as_double_array(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def cosine(a, b) -> Column:
    """Cosine similarity in double; NULL when either vector has zero length, differs in
    size or is NULL (undefined direction: no hit)."""
    same = F.size(as_double_array(a)) == F.size(as_double_array(b))
    val = F.try_divide(dot(a, b), F.sqrt(sq_norm(a) * sq_norm(b)))
    return F.when(same & (sq_norm(a) > 0) & (sq_norm(b) > 0), val)


def l2_normalize(v) -> Column:
    """Unit vector; NULL for the zero vector instead of a division error.

    The norm is computed once per row: ``array_repeat`` evaluates it a single time and the
    lambda only reads it (an expression inside a lambda is re-evaluated per element)."""
    x = as_double_array(v)
    n = l2_norm(x)
    pairs = F.arrays_zip(x.alias("x"), F.array_repeat(n, F.size(x)).alias("n"))
    return F.when(n > 0, F.transform(pairs, lambda p: p["x"] / p["n"]))


def softmax_entropy_bits(v) -> Column:
    """Entropy in bits of softmax(v) with probabilities clipped to [1e-10, 1].

    Max-shifted for stability. The max and the normaliser ride in the accumulator struct,
    so each is computed once per row rather than once per element."""
    x = as_double_array(v)
    mz = F.aggregate(x, F.struct(F.lit(0.0).alias("z"), F.array_max(x).alias("m")),
                     lambda acc, e: F.struct((acc["z"] + F.exp(e - acc["m"])).alias("z"), acc["m"].alias("m")))

    def step(acc, e):
        p = F.exp(e - acc["m"]) / acc["z"]
        term = p * F.ln(F.least(F.greatest(p, F.lit(1e-10)), F.lit(1.0)))
        return F.struct((acc["h"] + term).alias("h"), acc["m"].alias("m"), acc["z"].alias("z"))

    init = F.struct(F.lit(0.0).alias("h"), mz["m"].alias("m"), mz["z"].alias("z"))
    return F.aggregate(x, init, step, lambda acc: -acc["h"] / F.lit(math.log(2.0)))
