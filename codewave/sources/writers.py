"""Result tables out of Spark."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_semicolon_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Semicolon-separated file with decimal commas and a header."""
    cols = []
    for field in df.schema:
        col = F.col(f"`{field.name}`").cast("string")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.replace(col, F.lit("."), F.lit(","))
        cols.append(col.alias(field.name))
    df.select(*cols).write.mode(mode).csv(path, sep=";", header=True, encoding="UTF-8")


def write_table(
    df: DataFrame, path: str, partition: Sequence[str] = ("submuestra",), mode: str = "error"
) -> None:
    """Parquet by wave; a wave too large for one file is split by adaptive rebalancing."""
    spread = df.hint("rebalance", *[F.col(c) for c in partition]) if partition else df
    spread.write.mode(mode).partitionBy(*partition).parquet(path)


class _Store:
    """Files under a folder that every reader and writer can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifest(self, version: str) -> str:
        return f"_published/{version}.json"

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def versions(self) -> list[str]:
        if not self.has("_published"):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("_published"))]
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))

    def put(self, name: str, text: str) -> None:
        """Write a small file at once: under another name, then renamed."""
        draft = self._path(f"{name}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        self.fs.rename(draft, self._path(name))

    def get(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]


def publish_tables(tables: Mapping[str, DataFrame], root: str, version: str) -> bool:
    """Deliver several tables as one version: readers see all of them or none.

    Each table is written to a folder of the version; a manifest, put in place last, makes the
    version known. A version that is already known is left alone (False is returned), and what
    an interrupted attempt wrote is replaced. Versions are ordered by name.
    """
    store = _Store(next(iter(tables.values())).sparkSession, root)
    if store.has(store.manifest(version)):
        return False
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{store.root}/{version}/{name}")
    schemas = {name: json.loads(table.schema.json()) for name, table in tables.items()}
    store.put(store.manifest(version), json.dumps(schemas))
    return True


def published_versions(spark: SparkSession, root: str) -> list[str]:
    return _Store(spark, root).versions()


def read_published(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a published version, the last one by default."""
    store = _Store(spark, root)
    known = store.versions()
    version = version or (known[-1] if known else None)
    if version not in known:
        raise ValueError(f"no published version under {root}" if version is None else f"not published: {version}")
    schema = T.StructType.fromJson(json.loads(store.get(store.manifest(version)))[name])
    return spark.read.schema(schema).parquet(f"{store.root}/{version}/{name}")
