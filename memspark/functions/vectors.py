"""Vector expressions over array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when lengths differ, a vector is empty, or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(F.lit(0.0))


def dist_to_sim(distance: Column) -> Column:
    """Cosine distance in [0, 2] to a similarity in [0, 1]."""
    return 1.0 - distance / 2.0


def sigmoid(x: Column) -> Column:
    return F.when(x > 20, F.lit(1.0)).when(x < -20, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def cls_pool(token_vectors: Column) -> Column:
    """The first token's vector."""
    return F.get(token_vectors, 0)


def mask_mean_pool(token_vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros when the mask is all 0."""
    pairs = F.arrays_zip(token_vectors.alias("v"), mask.alias("m"))
    kept = F.transform(F.filter(pairs, lambda p: p["m"] == 1), lambda p: F.transform(p["v"], lambda x: x.cast("double")))
    zeros = F.transform(F.get(token_vectors, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    n = F.greatest(F.size(kept), F.lit(1))
    return F.transform(total, lambda x: x / n)
