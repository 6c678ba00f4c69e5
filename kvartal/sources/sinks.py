"""Artifacts of a run: parquet tables and JSON documents."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.sources.tables import path_exists


def plain(value):
    """A JSON-safe copy: NaN and infinite numbers become null, rows dicts, keys strings."""
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_tables(out_dir: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, parts) -> None:
    """Pieces of text one after another into a file of any file system that Spark knows."""
    target, fs = _file_system(spark, path)
    out = fs.create(target, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _file_system(spark, path)
    source = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def write_documents(spark: SparkSession, out_dir: str, documents: dict[str, object]) -> None:
    for name, value in documents.items():
        write_text(spark, f"{out_dir}/{name}.json", [json.dumps(plain(value), ensure_ascii=False, indent=1)])


def write_collection(features: DataFrame, path: str, order: str = "h3", feature: str = "feature") -> None:
    """A GeoJSON FeatureCollection of the features of a table, in order; they pass through the driver one partition at a time."""

    def parts():
        yield '{"type": "FeatureCollection", "features": ['
        for i, row in enumerate(features.orderBy(order).select(feature).toLocalIterator()):
            yield (",\n" if i else "\n") + row[0]
        yield "\n]}"

    write_text(features.sparkSession, path, parts())


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(feature): the features of a GeoJSON FeatureCollection, one JSON a row."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>").alias("c"))
    return whole.select(F.explode("c.features").alias("feature"))


def load_artifacts(spark: SparkSession, out_dir: str, names: list[str]) -> dict[str, object]:
    """Tables and documents of a run that exist; those missing are left out."""
    out: dict[str, object] = {}
    for name in names:
        if path_exists(spark, f"{out_dir}/{name}.parquet"):
            out[name] = spark.read.parquet(f"{out_dir}/{name}.parquet")
        for end in (".json", ".geojson"):
            if path_exists(spark, f"{out_dir}/{name}{end}"):
                out[name] = json.loads(read_text(spark, f"{out_dir}/{name}{end}"))
    return out
