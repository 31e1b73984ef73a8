"""Sinks: a protein matrix as a table, and bundles of matrix, samples and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError, WriteError
from ..model import Dataset

MAX_SAMPLES = 10_000  # columns of a wide table


def protein_matrix(ds: Dataset, *, assay: str = "proteins", layer: str = "raw", feature_column: str = "feature_id") -> DataFrame:
    """Features as rows, samples as columns by name; for up to MAX_SAMPLES samples."""
    cells = ds.layer(assay, layer)
    samples = [r[0] for r in ds.obs.select("sample_id").distinct().orderBy("sample_id").limit(MAX_SAMPLES + 1).collect()]
    if len(samples) > MAX_SAMPLES:
        raise ValidationError(f"more than {MAX_SAMPLES} samples; write the long layer")
    if feature_column in samples:
        raise ValidationError(f"a sample is called {feature_column!r}")
    return cells.groupBy(F.col("feature_id").alias(feature_column)).pivot("sample_id", samples).agg(F.first("value"))


def write_bundle(ds: Dataset, folder: str, *, assay: str = "proteins", layer: str = "raw", form: str = "csv") -> None:
    """Write folder/matrix, folder/obs and folder/var, tab-separated (csv) or as parquet."""
    if form not in ("csv", "parquet"):
        raise WriteError(f"form is csv or parquet, not {form!r}")
    for name, df in (("matrix", protein_matrix(ds, assay=assay, layer=layer)), ("obs", ds.obs), ("var", ds.assay(assay).var)):
        writer = df.write.mode("errorifexists")
        writer.csv(f"{folder}/{name}", sep="\t", header=True) if form == "csv" else writer.parquet(f"{folder}/{name}")
