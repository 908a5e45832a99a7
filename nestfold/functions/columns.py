"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A 32-bit word of a SHA-256 digest is uniform on [0, 2^32).
WORD_RANGE = 4294967296.0


def key_text(*parts) -> Column:
    """Join literals and columns with '|' into the text that is hashed."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def key_hash(*parts) -> Column:
    """SHA-256 (lower-case hex) of the joined parts."""
    return F.sha2(key_text(*parts), 256)


def hash_word(digest: Column, word: int = 0) -> Column:
    """32-bit word ``word`` (0-7) of a hex digest as BIGINT."""
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def hash_uniform(digest: Column, word: int = 0) -> Column:
    """Uniform number in [0, 1) taken from a digest."""
    return hash_word(digest, word) / F.lit(WORD_RANGE)


def hash_normal(digest: Column, word: int = 0) -> Column:
    """Standard normal number by Box-Muller from two words of a digest."""
    u1 = (hash_word(digest, word) + F.lit(1.0)) / F.lit(WORD_RANGE + 1.0)
    u2 = hash_uniform(digest, word + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def array_dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def as_float_array(values: Column) -> Column:
    """Round to 32-bit at the places where the protocol stores 32-bit matrices."""
    return values.cast("array<float>")


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Columns of a one-row table as literals of ``df``: no join, also on a stream."""
    row = one.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in one.schema.fields})


def missing_to_null(x: Column) -> Column:
    """NaN is 'missing' in the data contract, so it becomes null once, at ingest."""
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))
