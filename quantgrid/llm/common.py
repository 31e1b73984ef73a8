"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_at_exit, materialize, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, the bytes 20 and 09 to 0D; bytes.split() and bytes.strip() use the same set.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(column, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_of(rows: int, size: int) -> int:
    """How many groups hold `rows` rows at about `size` rows each; 1 at least."""
    return max(1, -(-rows // size))
