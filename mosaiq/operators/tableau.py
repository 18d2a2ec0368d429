"""Stabiliser rows as columns: x and z (one bit for each qubit, as BIGINT) and a phase bit. Gates are bit operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(qubit: int):
    return F.lit(1 << qubit).cast("bigint")


def hadamard(rows: DataFrame, qubit: int) -> DataFrame:
    """Exchanges x and z of a qubit; where both are set the phase turns."""
    differ = F.col("x").bitwiseXOR(F.col("z")).bitwiseAND(_one(qubit))
    both = F.col("x").bitwiseAND(F.col("z")).bitwiseAND(_one(qubit)) != 0
    return rows.withColumns({"x": F.col("x").bitwiseXOR(differ), "z": F.col("z").bitwiseXOR(differ), "phase": F.col("phase").bitwiseXOR(both.cast("int"))})


def phase(rows: DataFrame, qubit: int) -> DataFrame:
    """x joins z; where both were set the phase turns."""
    own = F.col("x").bitwiseAND(_one(qubit))
    both = own.bitwiseAND(F.col("z")) != 0
    return rows.withColumns({"z": F.col("z").bitwiseXOR(own), "phase": F.col("phase").bitwiseXOR(both.cast("int"))})
