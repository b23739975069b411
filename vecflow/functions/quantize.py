"""Scalar quantization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import total


def row_code(v: Column) -> Column:
    """Row-wise codes 0..255: code, and the scale and offset that decode it."""
    low, high = F.array_min(v), F.array_max(v)
    span = F.when(high - low == 0, F.lit(1e-8)).otherwise(high - low)
    return F.struct(
        F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((x - low) / span * 255))).cast("smallint")).alias("code"),
        (span / 255).alias("scale"),
        low.alias("offset"),
    )


def adc(query: Column, code: Column, scale: Column, offset: Column) -> Column:
    """Distance between a whole query and a coded row."""
    return F.sqrt(total(F.zip_with(query, code, lambda q, c: (q - (c * scale + offset)) * (q - (c * scale + offset)))))


def dimension_ranges(vectors: DataFrame) -> DataFrame:
    """pos, low, high, scale of each dimension: the parameters of per-dimension codes."""
    spread = vectors.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return spread.withColumn("scale", F.when(F.col("high") - F.col("low") < 1e-8, F.lit(1.0)).otherwise((F.col("high") - F.col("low")) / 255))


def as_arrays(ranges: DataFrame) -> DataFrame:
    """One row: lows and scales in order of dimension (as wide as the vectors, so small)."""
    return ranges.agg(F.sort_array(F.collect_list(F.struct("pos", "low", "scale"))).alias("p")).select(F.col("p.low").alias("lows"), F.col("p.scale").alias("scales"))


def _steps(v: Column, lows: Column, scales: Column) -> Column:
    return F.transform(v, lambda x, i: F.rint((x - lows[i]) / scales[i]))


def unsigned_codes(v: Column, lows: Column, scales: Column) -> Column:
    return F.transform(_steps(v, lows, scales), lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)).cast("int"))


def signed_codes(v: Column, lows: Column, scales: Column) -> Column:
    clipped = F.transform(v, lambda x, i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - lows[i]) / scales[i])))
    return F.transform(clipped, lambda c: F.rint(c - 128).cast("int"))


def decoded(codes: Column, lows: Column, scales: Column, shift: int = 0) -> Column:
    return F.transform(codes, lambda c, i: (c + shift) * scales[i] + lows[i])


def code_distance(a: Column, b: Column, scales: Column) -> Column:
    """Squared distance of two coded vectors."""
    return total(F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), scales.alias("s")), lambda z: F.pow((z["a"] - z["b"]) * z["s"], 2)))


def symmetric_codes(v: Column) -> Column:
    """Codes -127..127 of a unit vector's values, without an offset."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x * 127))).cast("int"))
