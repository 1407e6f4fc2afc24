"""Vector arithmetic on ARRAY<FLOAT> columns, computed in DOUBLE; rows against one known vector as matrix products, the rest inside the JVM."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(x: Column, y: Column) -> Column:
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def distance(x: Column, y: Column) -> Column:
    """1 - dot, clamped to [0, 1]; unit vectors are assumed.

    Vectors that are missing, of different lengths or not finite are at distance 1: least() skips NULL and sorts NaN and
    infinity last, and a product of plus infinity counts as NULL.
    """
    product = F.nullif(dot(x, y), F.lit(float("inf")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - product))


def distance_to(v: Column, query: list[float] | None) -> Column:
    """``distance`` to one vector that is known: a matrix product per Arrow batch, in double."""
    q = np.array([] if query is None else query, np.float64)

    @F.arrow_udf(T.DoubleType())
    def measured(rows: pa.Array) -> pa.Array:
        out = np.ones(len(rows))
        fits = pc.equal(pc.list_value_length(rows), q.size).fill_null(False)
        if q.size and fits.true_count:
            x = rows.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.size)
            with np.errstate(invalid="ignore"):
                product = np.concatenate([x[low:low + 1024].astype(np.float64) @ q for low in range(0, len(x), 1024)])
                near = np.clip(1.0 - product, 0.0, 1.0)
            out[fits.to_numpy(zero_copy_only=False)] = np.where(np.isfinite(product), near, 1.0)
        return pa.array(out)

    return measured(v)


def finite(value: Column) -> Column:
    """Neither NULL nor NaN (which sorts above infinity) nor infinite."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """L2 normalise; the zero vector, and one with a NaN, stay as they are.

    The norm is spread next to the values once; inside a lambda it would be computed again for each of them.
    """
    length = F.coalesce(F.nullif(F.nanvl(norm(v), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda a, n: (a.cast("double") / n).cast("float"))


def fit_dim(v: Column, dim: int) -> Column:
    """Cut or zero-pad to ``dim`` values."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def needs_vector(v: Column, dim: int) -> Column:
    """No usable vector: NULL, wrong length, or NaN in slot 0."""
    return v.isNull() | (F.size(v) != dim) | F.coalesce(F.isnan(F.get(v, F.lit(0))), F.lit(False))


@F.arrow_udf(T.BinaryType())
def vector_to_bytes(v: pa.Array) -> pa.Array:
    """Little-endian float32 bytes.  The list array's value buffer already has that layout, so it is re-viewed."""
    flat = v.flatten().fill_null(float("nan"))
    ends = pc.cumulative_sum(pc.multiply(pc.list_value_length(v).fill_null(0), 4))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    values = flat.slice(0).to_numpy(zero_copy_only=False).tobytes()
    view = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, offsets.buffers()[1], pa.py_buffer(values)])
    return pc.if_else(v.is_null(), pa.scalar(None, pa.binary()), view)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def bytes_to_vector(b: pa.Array) -> pa.Array:
    """The inverse; a byte length that is no multiple of 4 gives NULL."""
    lengths = pc.binary_length(b).fill_null(0)
    whole = pc.equal(pc.bit_wise_and(lengths, 3), 0)
    ok = pc.and_(b.is_valid(), whole)
    kept = pc.if_else(ok, b, pa.scalar(b"", pa.binary()))
    ends = pc.cumulative_sum(pc.binary_length(kept))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.divide(ends, 4).cast(pa.int32())])
    raw = b"".join(kept.to_pylist())
    floats = pa.Array.from_buffers(pa.float32(), len(raw) // 4, [None, pa.py_buffer(raw)])
    lists = pa.ListArray.from_arrays(offsets, floats)
    return pc.if_else(ok, lists, pa.scalar(None, lists.type))
