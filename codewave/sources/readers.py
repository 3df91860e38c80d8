"""Survey files into canonical frames."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewave.operators.assemble import FILE_NO, ROW_NO, seq_in_file_order, seq_in_group
from codewave.session import stage_table


def _pick(columns: Sequence[str], name: str, alias: str | None) -> str | None:
    """The source column for a canonical name: exact, else by alias, never ambiguous."""
    if name in columns:
        return name
    if alias is None:
        return None
    found = [c for c in columns if re.fullmatch(alias, c)]
    if len(found) > 1:
        raise ValueError(f"{name}: several columns match {alias!r}: {found}")
    return found[0] if found else None


def _layouts(spark: SparkSession, paths: Sequence[str], file_format: str) -> list[DataFrame]:
    """One multi-path scan per distinct layout instead of one scan per file."""
    by_layout: dict[str, list[str]] = {}
    for path in paths:
        schema = spark.read.format(file_format).load(path).schema
        by_layout.setdefault(schema.json(), []).append(path)
    return [
        spark.read.schema(T.StructType.fromJson(json.loads(layout)))
        .format(file_format)
        .load(group)
        for layout, group in by_layout.items()
    ]


def read_in_order(
    spark: SparkSession, paths: Sequence[str], file_format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Rows of files with their place: ``_file_no`` from 0, and ``_row_no`` from 0 in the file.

    Files follow the order of ``paths``, those of one folder their names. A Parquet reader tells
    the place of a row itself. Of other formats the reader tells the split, whose rows it numbers
    without gaps; the rows are written once so that these numbers stay, and the sizes of earlier
    splits are added up. No row is exchanged in either case.
    """
    stacked = None
    for i, path in enumerate(paths):
        reader = spark.read.schema(schema) if schema else spark.read
        frame = reader.format(file_format).load(path)
        place = {"_path_no": F.lit(i), "_file": F.col("_metadata.file_path")}
        if file_format == "parquet":
            place[ROW_NO] = F.col("_metadata.row_index")
        else:
            place |= {"_split": F.col("_metadata.file_block_start"), ROW_NO: F.monotonically_increasing_id()}
        part = frame.withColumns(place)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    file = ["_path_no", "_file"]
    if file_format != "parquet":
        stacked = stage_table(stacked, "ordered")
        splits = stacked.groupBy(*file, "_split").agg(F.min(ROW_NO).alias("_first"), F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*file).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        stacked = stacked.join(stage_table(splits.drop("_n"), "splits"), [*file, "_split"])
        stacked = stacked.withColumn(ROW_NO, F.col("_before") + F.col(ROW_NO) - F.col("_first"))
        stacked = stacked.drop("_split", "_first", "_before")
    # One line per file.
    files = stage_table(stacked.select(*file).distinct(), "files")
    numbered = files.withColumn(FILE_NO, F.row_number().over(Window.orderBy(*file)) - 1)
    return stacked.join(stage_table(numbered, "file_numbers"), file).drop(*file)


def load_person_files(
    spark: SparkSession,
    paths: Sequence[str],
    keep: Sequence[str],
    household: str,
    out: str = "nro_rph",
    file_format: str = "parquet",
) -> DataFrame:
    """Raw person files stacked, with the number of each person in the household in file order."""
    rows = read_in_order(spark, paths, file_format).select(*dict.fromkeys([*keep, household]), FILE_NO, ROW_NO)
    return seq_in_file_order(rows, household, out)


@dataclass(frozen=True)
class Loaded:
    """Rows that fit the schema, and the values that did not, with the place of their row.

    ``rejected`` has (file, row_no, column, value): a row with several bad values has several
    lines, and is in ``rows`` with none of them.
    """

    rows: DataFrame
    rejected: DataFrame


def load_union_checked(
    sources: Sequence[str | DataFrame],
    schema: T.StructType,
    aliases: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    spark: SparkSession | None = None,
    file_format: str = "parquet",
) -> Loaded:
    """As ``load_union``, but a value that can't have the type of its column goes to a second
    output with its file and place instead of stopping the job. Frames have no file.

    A number of another width or with a fraction is a bad value if the type would change it.
    """
    aliases, defaults = aliases or {}, defaults or {}
    frames = [(s, None) for s in sources if isinstance(s, DataFrame)]
    paths = [s for s in sources if not isinstance(s, DataFrame)]
    for frame in _layouts(spark or SparkSession.active(), paths, file_format) if paths else []:
        place = F.col("_metadata.row_index") if file_format == "parquet" else F.lit(None).cast("bigint")
        frames.append((frame, (F.col("_metadata.file_path"), place)))
    stacked = None
    for frame, place in frames:
        file, row = place or (F.lit(None).cast("string"), F.lit(None).cast("bigint"))
        cols, faults = [], []
        for field in schema:
            source = _pick(frame.columns, field.name, aliases.get(field.name))
            value = F.lit(defaults.get(field.name)) if source is None else F.col(f"`{source}`")
            fitted = value.try_cast(field.dataType)
            cols.append(fitted.alias(field.name))
            faults.append(_fault(field, value, fitted))
        bad = F.filter(F.array(*faults), lambda f: f.isNotNull())
        part = frame.select(*cols, file.alias("_file"), row.alias("_row"), bad.alias("_bad"))
        stacked = part if stacked is None else stacked.unionByName(part)
    rows = stacked.filter(F.size("_bad") == 0).select(*schema.names)
    rejected = stacked.filter(F.size("_bad") > 0).select(
        F.col("_file").alias("file"), F.col("_row").alias("row_no"), F.inline("_bad")
    )
    return Loaded(rows, rejected)


def _fault(field: T.StructField, value: Column, fitted: Column) -> Column:
    """(column, value) where a value is lost or changed by its new type, else null."""
    lost = value.isNotNull() & fitted.isNull()
    if isinstance(field.dataType, T.IntegralType):
        number = value.cast("string").try_cast("double")
        lost = lost | (number.isNotNull() & (number != F.floor(number)))
    told = F.struct(F.lit(field.name).alias("column"), value.cast("string").alias("value"))
    return F.when(F.coalesce(lost, F.lit(False)), told)


def load_union(
    sources: Sequence[str | DataFrame],
    schema: T.StructType,
    aliases: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    spark: SparkSession | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """Stack wave files in the columns and types of ``schema``.

    A column is taken by its exact name or by its alias pattern; a file without it gets
    the default, or null.
    """
    aliases, defaults = aliases or {}, defaults or {}
    frames = [s for s in sources if isinstance(s, DataFrame)]
    paths = [s for s in sources if not isinstance(s, DataFrame)]
    if paths:
        frames += _layouts(spark or SparkSession.active(), paths, file_format)
    stacked = None
    for frame in frames:
        cols = []
        for field in schema:
            source = _pick(frame.columns, field.name, aliases.get(field.name))
            value = F.lit(defaults.get(field.name)) if source is None else F.col(f"`{source}`")
            cols.append(value.cast(field.dataType).alias(field.name))
        part = frame.select(*cols)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def load_person_waves(
    waves: Sequence[DataFrame], keep: Sequence[str], household: str, order: str, out: str = "nro_rph"
) -> DataFrame:
    """Stack raw person files, keep some columns and number persons in their household."""
    stacked = None
    for wave in waves:
        part = wave.select(*dict.fromkeys([*keep, household, order]))
        stacked = part if stacked is None else stacked.unionByName(part)
    return seq_in_group(stacked, household, order, out)


def load_tagged_arms(
    arms: Mapping[str, Sequence[DataFrame]], tag: str = "tipo"
) -> dict[str, DataFrame]:
    """Stack the files of each trial arm under its tag."""
    out = {}
    for arm, frames in arms.items():
        stacked = None
        for frame in frames:
            stacked = frame if stacked is None else stacked.unionByName(frame, allowMissingColumns=True)
        out[arm] = stacked.withColumn(tag, F.lit(arm))
    return out


def load_catalogue(
    df: DataFrame, code: str, deeper: Sequence[str], label: str, out: str = "aeciuo_2"
) -> DataFrame:
    """Codes and labels of one level: rows with that code and none of a deeper level."""
    at_level = F.col(code).isNotNull()
    for name in deeper:
        at_level = at_level & F.col(name).isNull()
    return df.filter(at_level).select(F.col(code).cast("string").alias(out), F.col(label).alias("glosa"))


def _clean(name: str) -> str:
    name = name.replace("%", "_percent_").replace("#", "_number_").replace("'", "").replace('"', "")
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)
    snake = re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()
    return f"x{snake}" if not snake or snake[0].isdigit() else snake


def clean_column_names(df: DataFrame) -> DataFrame:
    """Headers in lower-case ASCII with underscores; repeated ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = _clean(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def rename_by_pattern(df: DataFrame, pattern: str, new: str) -> DataFrame:
    """Rename the one column that matches; more than one is an error."""
    found = [c for c in df.columns if re.search(pattern, c)]
    if len(found) > 1:
        raise ValueError(f"several columns match {pattern!r}: {found}")
    return df.withColumnsRenamed({found[0]: new}) if found else df


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Remove columns without any value; one aggregate decides for all columns."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if filled[i] > 0])


def select_reorder(
    df: DataFrame,
    cols: Sequence[str],
    before: str | None = None,
    after: str | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Move ``cols`` next to another column (to the front by default), dropping some."""
    rest = [c for c in df.columns if c not in cols and c not in drop]
    at = rest.index(before) if before else rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], *cols, *rest[at:])


def read_semicolon_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Semicolon-separated file with decimal commas."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.csv(path, sep=";", header=True, schema=as_text, encoding="UTF-8")
    cols = []
    for field in schema:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.replace(col, F.lit(","), F.lit("."))
        cols.append(col.cast(field.dataType).alias(field.name))
    return raw.select(*cols)


def read_latin1_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";") -> DataFrame:
    """Raw files in the older encoding."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, encoding="ISO-8859-1")
