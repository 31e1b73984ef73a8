"""Reading vendor tables: files, software and column detection, long and wide layouts."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatError, ValidationError
from ..model import Assay, Dataset, MaskCode, clean

SUFFIXES = (".tsv", ".txt", ".csv", ".parquet")
#: Texts that stand for a missing value.
NULLS = ("", "NA", "NaN", "nan", "NULL", "null")


@dataclass(frozen=True)
class Profile:
    """Names to look for, in order."""

    features: tuple[str, ...]
    quantities: tuple[str, ...]
    samples: tuple[str, ...]
    fdr: tuple[str, ...]
    metadata: tuple[str, ...]


#: The vendors' column names by software and level.
PROFILES = {
    ("diann", "protein"): Profile(
        ("Protein.Group", "Protein.Groups", "Protein.Ids"),
        ("PG.MaxLFQ", "PG.TopN", "PG.Quantity", "PG.Normalised"),
        ("Run",),
        ("PG.Q.Value", "Global.PG.Q.Value", "Lib.PG.Q.Value"),
        ("Protein.Group", "Protein.Groups", "Protein.Ids", "Protein.Names", "Genes", "First.Protein.Description", "PG.Q.Value", "Global.PG.Q.Value", "Lib.PG.Q.Value"),
    ),
    ("diann", "peptide"): Profile(
        ("Precursor.Id", "EG.PrecursorId", "Modified.Sequence", "Stripped.Sequence"),
        ("Precursor.Normalised", "Precursor.Quantity"),
        ("Run",),
        ("Q.Value", "Global.Q.Value", "Lib.Q.Value"),
        ("Precursor.Id", "Modified.Sequence", "Stripped.Sequence", "Precursor.Charge", "Protein.Group", "Protein.Ids", "Protein.Names", "Genes", "Q.Value", "Global.Q.Value", "Lib.Q.Value"),
    ),
    ("spectronaut", "protein"): Profile(
        ("PG.ProteinGroups", "PG.ProteinAccessions", "ProteinGroups", "ProteinGroup"),
        ("PG.Quantity", "PG.Normalized", "PG.Normalised"),
        ("R.FileName", "R.File.Name"),
        ("PG.Qvalue", "PG.QValue", "PG.Q.Value"),
        ("PG.ProteinGroups", "PG.ProteinAccessions", "PG.ProteinNames", "PG.Genes", "PG.Description", "PG.Qvalue", "PG.QValue", "PG.Q.Value"),
    ),
    ("spectronaut", "peptide"): Profile(
        ("EG.PrecursorId", "PEP.GroupingKey", "EG.ModifiedSequence", "FG.PrecursorId", "FG.Id"),
        ("EG.TotalQuantity", "PEP.Quantity", "FG.Quantity", "F.NormalizedPeakArea", "F.PeakArea"),
        ("R.FileName", "R.File.Name"),
        ("EG.Qvalue", "EG.QValue", "PEP.Qvalue", "PEP.QValue", "Q.Value"),
        ("EG.PrecursorId", "PEP.GroupingKey", "PEP.GroupingKeyType", "EG.ModifiedSequence", "FG.PrecursorId", "FG.Id", "PG.ProteinGroups", "PG.ProteinAccessions", "EG.ProteinId", "EG.Qvalue", "EG.QValue", "PEP.Qvalue", "PEP.QValue", "Q.Value"),
    ),
}
#: Endings of sample columns in wide tables, and isobaric label channels, which aren't runs.
WIDE_SUFFIXES = ("_Quantity", "_PeptideQuantity", "_PrecursorQuantity", "_TotalQuantity", "_Intensity", "_PeakArea", "_NormalizedPeakArea")
PRECURSOR = re.compile(r"(?:\[[^\]]+\]\s*)?(.+?)\.(?:PEP|Precursor)\.(?:Quantity|Intensity)$", re.IGNORECASE)
CHANNEL = re.compile(r"(?:^|[_-])(126|12[789][NC]|13[0-3][NC]|134N)$", re.IGNORECASE)
BRACKET = re.compile(r"^\[[^\]]+\]\s*")


def separator(path: str, given: str | None = None) -> str:
    return given or ("\t" if path.lower().endswith((".tsv", ".txt")) else ",")


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A Parquet table, or a delimited one with all columns as text; texts that stand for nothing become null."""
    if not path.lower().endswith(SUFFIXES):
        raise FormatError(f"{path}: known endings are {', '.join(SUFFIXES)}")
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, sep=separator(path, delimiter), header=True, inferSchema=False)
    return raw.select(*(F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns))


def detect_software(columns: list[str]) -> str | None:
    """By the sample column, then feature columns, then the look of wide columns."""
    have = set(columns)
    if have & {"R.FileName", "R.File.Name"}:
        return "spectronaut"
    if "Run" in have:
        return "diann"
    for software in ("spectronaut", "diann"):
        if have & {f for (s, _), p in PROFILES.items() if s == software for f in p.features}:
            return software
    if any(PRECURSOR.match(c) for c in columns):
        return "diann"
    return "spectronaut" if any(c.endswith(WIDE_SUFFIXES) for c in columns) else None


def profile_of(columns: list[str], software: str = "auto", level: str = "protein") -> tuple[str, Profile]:
    found = detect_software(columns) if software == "auto" else software
    if (found, level) not in PROFILES:
        raise ValidationError(f"software {found!r} and level {level!r} aren't known; columns: {columns[:12]}")
    return found, PROFILES[found, level]


def pick(columns: list[str], names: tuple[str, ...], given: str = "auto", what: str = "column", needed: bool = True) -> str | None:
    """The given column, else the first known one."""
    if given != "auto":
        if given not in columns:
            raise ValidationError(f"no {what} {given!r}")
        return given
    found = next((n for n in names if n in columns), None)
    if found is None and needed:
        raise ValidationError(f"no {what} among {names}; columns: {columns[:12]}")
    return found


def is_long(columns: list[str], profile: Profile, table_format: str = "auto") -> bool:
    if table_format not in ("auto", "long", "matrix"):
        raise ValidationError(f"table_format is auto, long or matrix, not {table_format!r}")
    if table_format != "auto":
        return table_format == "long"
    return any(s in columns for s in profile.samples) and any(q in columns for q in profile.quantities)


def sample_name(column: Column) -> Column:
    return F.regexp_replace(column.cast("string"), r"(?i)\.raw$", "")


def number(column: Column) -> Column:
    return clean(column.try_cast("double"))


def fdr_pass(metric: Column, threshold: float) -> Column:
    return metric.isNull() | (metric <= threshold)


def rejected_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(sample_id, feature_id) of which no row passes; rows has a column `fdr`."""
    ok = F.bool_or(fdr_pass(F.col("fdr"), threshold))
    return rows.groupBy("sample_id", "feature_id").agg(ok.alias("ok")).where(~F.col("ok")).select("sample_id", "feature_id")


def coded(cells: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Mask of imported cells: VALID with a value, FILTERED where an FDR took all rows, else UNCERTAIN."""
    cells = cells.withColumn("mask", F.when(F.col("value").isNotNull(), int(MaskCode.VALID)).otherwise(int(MaskCode.UNCERTAIN)))
    if rejected is None:
        return cells
    hit = rejected.withColumn("__cut", F.lit(int(MaskCode.FILTERED)))
    cells = cells.join(hit, ["sample_id", "feature_id"], "left")
    return cells.withColumn("mask", F.when(F.col("value").isNull(), F.coalesce("__cut", "mask")).otherwise(F.col("mask"))).drop("__cut")


def load_long(table: DataFrame, profile: Profile, *, quantity: str = "auto", sample: str = "auto", feature: str = "auto", fdr_threshold: float | None = 0.01) -> tuple[DataFrame, DataFrame]:
    """(cells, var) of a long table: the largest quantity of repeated pairs, over all pairs of samples and features left."""
    cols = table.columns
    f, q = pick(cols, profile.features, feature, "feature column"), pick(cols, profile.quantities, quantity, "quantity column")
    s, metric = pick(cols, profile.samples, sample, "sample column"), pick(cols, profile.fdr, needed=False)
    meta = [c for c in profile.metadata if c in cols and c != f]
    name = lambda c: F.col(f"`{c}`")
    rows = table.select(
        sample_name(name(s)).alias("sample_id"), name(f).cast("string").alias("feature_id"), number(name(q)).alias("value"),
        (number(name(metric)) if metric else F.lit(None).cast("double")).alias("fdr"), *(name(c).cast("string").alias(c) for c in meta),
    ).where("sample_id is not null and feature_id is not null")
    rejected = rejected_pairs(rows, fdr_threshold) if metric and fdr_threshold is not None else None
    kept = rows.where(fdr_pass(F.col("fdr"), fdr_threshold)) if rejected is not None else rows
    best = kept.groupBy("sample_id", "feature_id").agg(F.max("value").alias("value"))
    # One row's metadata for each feature: that of its first sample.
    whole = F.min_by(F.struct(*map(name, meta)), F.struct("sample_id", *map(name, meta))) if meta else None
    first = kept.groupBy("feature_id").agg(whole.alias("m")).select("feature_id", *(F.col("m")[c].alias(c) for c in meta)) if meta else kept.select("feature_id").distinct()
    samples = kept.select("sample_id").distinct()
    grid = samples.crossJoin(first.select("feature_id")).join(best, ["sample_id", "feature_id"], "left")
    return coded(grid, rejected), first


def quantity_suffixes(token: str) -> tuple[str, ...]:
    token = token.strip().lstrip("._")
    return (f".{token}", f"_{token.split('.')[-1]}") if token else ()


def wide_samples(table: DataFrame, software: str, profile: Profile, quantity: str = "auto") -> dict[str, str]:
    """Sample columns of a wide table and their sample names; label channels are refused."""
    cols = [c for c in table.columns if c not in profile.metadata and c not in profile.features]
    strip = lambda c: re.sub(r"(?i)\.raw$", "", BRACKET.sub("", c))
    groups: list[dict[str, str]] = []
    if software == "spectronaut":
        for token in [quantity] if quantity != "auto" else profile.quantities:
            groups.append({c: strip(c[: -len(e)]) for c in cols for e in quantity_suffixes(token)[::-1] if c.endswith(e)})
        groups.append({c: strip(c[: -len(e)]) for c in cols for e in WIDE_SUFFIXES if c.endswith(e)} if quantity == "auto" else {})
    else:
        groups.append({c: re.sub(r"(?i)\.raw$", "", m[1]) for c in cols if (m := PRECURSOR.match(c))})
    groups.append({c: strip(c) for c in cols} if quantity == "auto" else {})
    wanted = [c for g in groups for c in g]
    if not wanted:
        raise ValidationError("no sample columns")
    some = table.agg(*(F.count(number(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(dict.fromkeys(wanted)))).first()
    numeric = {c for i, c in enumerate(dict.fromkeys(wanted)) if some[i]}
    chosen = next((h for g in groups if (h := {c: n for c, n in g.items() if c in numeric})), {})
    if not chosen:
        raise ValidationError("no sample column holds numbers")
    if len(set(chosen.values())) < len(chosen):
        raise ValidationError("sample names repeat")
    labels = [m[1].upper() for n in chosen.values() if (m := CHANNEL.search(n.strip()))]
    if len(set(labels)) >= 10 and len(labels) >= 0.8 * len(chosen):
        raise ValidationError("samples are channels of an isobaric label, not runs")
    return chosen


def load_wide(table: DataFrame, software: str, profile: Profile, *, quantity: str = "auto", feature: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(cells, var) of a wide table; a repeated feature id gets a suffix, a null one a name of its own."""
    f = pick(table.columns, profile.features, feature, "feature column")
    samples = wide_samples(table, software, profile, quantity)
    rest = [c for c in table.columns if c not in samples]
    id_ = F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("__MISSING_FEATURE__"))
    nth = F.row_number().over(Window.partitionBy("__id").orderBy("__row")) - 1
    named = table.withColumns({"__id": id_, "__row": F.monotonically_increasing_id()}).withColumn("__n", nth)
    named = named.withColumn("feature_id", F.when(F.col("__n") > 0, F.concat_ws("_", "__id", F.col("__n").cast("string"))).otherwise(F.col("__id")))
    wide = named.select("feature_id", *(number(F.col(f"`{c}`")).alias(n.replace("`", "")) for c, n in samples.items()))
    long = wide.unpivot("feature_id", [F.col(f"`{n.replace('`', '')}`") for n in samples.values()], "sample_id", "value")
    return coded(long.select("sample_id", "feature_id", "value")), named.select("feature_id", *(F.col(f"`{c}`") for c in rest))


def load_quant_table(spark: SparkSession, path: str, *, software: str = "auto", level: str = "protein", assay_name: str | None = None, table_format: str = "auto", quantity_column: str = "auto", sample_column: str = "auto", feature_column: str = "auto", fdr_threshold: float | None = 0.01, layer_name: str = "raw", delimiter: str | None = None) -> Dataset:
    """A Dataset with one assay and one layer from a vendor's table."""
    table = read_table(spark, path, delimiter)
    found, profile = profile_of(table.columns, software, level)
    if is_long(table.columns, profile, table_format):
        cells, var = load_long(table, profile, quantity=quantity_column, sample=sample_column, feature=feature_column, fdr_threshold=fdr_threshold)
    else:
        cells, var = load_wide(table, found, profile, quantity=quantity_column, feature=feature_column)
    name = assay_name or f"{level}s"
    ds = Dataset(cells.select("sample_id").distinct(), {name: Assay(var, {layer_name: cells.select("sample_id", "feature_id", "value", "mask")})})
    column = quantity_column if quantity_column != "auto" else pick(table.columns, profile.quantities, needed=False)
    normalized = bool(re.search("normali[sz]ed", column or "", re.IGNORECASE))
    if normalized:
        warnings.warn(f"{column} holds values that the vendor's software has normalized", UserWarning, stacklevel=2)
    return ds.log("load_quant_table", {"assay": name, "new_layer": layer_name, "software": found, "level": level, "quantity": column, "vendor_normalized": normalized})


def load_diann(spark: SparkSession, path: str, **options) -> Dataset:
    return load_quant_table(spark, path, software="diann", **options)


def load_spectronaut(spark: SparkSession, path: str, **options) -> Dataset:
    return load_quant_table(spark, path, software="spectronaut", **options)


def load_peptide_pivot(spark: SparkSession, path: str, **options) -> Dataset:
    return load_quant_table(spark, path, level="peptide", **options)
