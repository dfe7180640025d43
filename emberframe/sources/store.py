"""Table stores on Parquet and JSON: schemas with defaults, keyed partitions, shards, manifests, resuming."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.session import materialize

#: Declared tables of the domain.
SCHEMAS = {
    "images": "image_id int, file_name string, start_time timestamp, num_fire_pixels int",
    "pixels": "det_id bigint, cls int, x double, y double, width double, height double, date timestamp, image_id int, fire_id int, ignition boolean",
    "cells": "x int, y int, t int, component bigint, ignition boolean",
    "runs": "tag string, model string, loss string, target string, metrics map<string,double>, by_region map<string,double>",
}

_ZERO = {T.StringType: "", T.BooleanType: False, T.TimestampType: None, T.DateType: None, T.MapType: None, T.ArrayType: None}


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """df with exactly the declared columns: cast, missing ones filled with the type's zero, others dropped."""
    s = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    have = {c.lower(): c for c in df.columns}

    def column(f: T.StructField) -> Column:
        if f.name.lower() in have:
            return F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name)
        return F.lit(_ZERO.get(type(f.dataType), 0)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in s.fields])


@dataclass
class Store:
    """Tables under one folder, one Parquet dataset each, some partitioned by a key."""

    spark: SparkSession
    path: str

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, name: str, df: DataFrame, by: list[str] | None = None, mode: str = "overwrite") -> None:
        """Writes a table; with `by`, rows of one key go to one folder, spread by the key so files stay few."""
        w = (df.repartition(*by) if by else df).write.mode(mode)
        (w.partitionBy(*by) if by else w).parquet(self._at(name))

    def exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def load(self, name: str, schema: str | None = None, **key) -> DataFrame | None:
        """A table or the rows of one key (pruned to its folder); None if the table isn't there."""
        if not self.exists(name):
            return None
        df = self.spark.read.option("mergeSchema", "true").parquet(self._at(name))
        for k, v in key.items():
            df = df.filter(F.col(k) == F.lit(v))
        return conform(df, schema) if schema else df

    def merge(self, name: str, *items: DataFrame) -> None:
        """Appends tables of the same columns in any order; missing columns are null."""
        out = items[0]
        for x in items[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        self.save(name, out, mode="append")

    def write_missing(self, name: str, df: DataFrame, key: list[str]) -> DataFrame:
        """Appends the rows whose key isn't stored yet and returns them: a job that is run again adds nothing."""
        old = self.load(name)
        new = df.dropDuplicates(key)
        new = new if old is None else new.join(old.select(*key).distinct(), key, "left_anti")
        from emberframe.session import materialize

        new = materialize(new)
        self.save(name, new, mode="append")
        return new

    def replace_keys(self, name: str, df: DataFrame, by: list[str]) -> None:
        """Overwrites only the partitions that df has rows for."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._at(name))


def to_json_rows(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """One JSON object per row in `json`, with formatted dates."""
    return df.select(F.to_json(F.struct("*"), {"dateFormat": date_format, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or an array of objects under a declared schema; unknown keys are dropped, missing ones null."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def iso_dates(df: DataFrame) -> DataFrame:
    """df with text columns that hold ISO dates only turned into DATE, ISO times only into TIMESTAMP.

    All text columns are tested in one pass over all rows; a column with no value at all stays text.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    date, time = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
    tests = [
        t
        for c in texts
        for t in (
            F.coalesce(F.bool_and(F.coalesce(F.col(c).rlike(date), F.col(c).isNull())) & (F.count(c) > 0), F.lit(False)).alias(f"d_{c}"),
            F.coalesce(F.bool_and(F.coalesce(F.col(c).rlike(time), F.col(c).isNull())) & (F.count(c) > 0), F.lit(False)).alias(f"t_{c}"),
        )
    ]
    r = df.agg(*tests).first()
    return df.withColumns({c: F.to_date(c) if r[f"d_{c}"] else F.to_timestamp(c) for c in texts if r[f"d_{c}"] or r[f"t_{c}"]})


def write_json_document(df: DataFrame, path: str) -> None:
    """A small result as one JSON file through the commit protocol, so a reader never sees half of it."""
    df.coalesce(1).write.mode("overwrite").json(path)


def distilled(df: DataFrame, files: int, order: list[str]) -> DataFrame:
    """df with file (0 .. files - 1, contiguous in order) and index, counted from 0 in each file."""
    from emberframe.operators.ordering import chunked

    c = chunked(df, order, files).withColumnRenamed("chunk", "file")
    return c.withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)


def collect_runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result documents of run folders (…/<tag>/result.json) with tag, and target and region told from it.

    Of a folder written by partition, <column>=<tag>, the tag is what stands behind the sign.
    """
    r = spark.read.schema(schema).option("multiLine", "true").json(pattern).withColumn("path", F.input_file_name())
    tag = F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "^[^=]*=", "")
    return r.withColumn("tag", tag).withColumns(
        {"target": F.regexp_extract("tag", "_(nf|nm)$", 1), "region": F.regexp_replace(F.regexp_replace("tag", "^[^_]+_", ""), "_(nf|nm)$", "")}
    ).drop("path")


def write_matrix(df: DataFrame, row: str, column: str, value: str, path: str, columns: list) -> None:
    """A long table as a CSV matrix with the given columns."""
    df.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def manifest(images: DataFrame, by: str) -> DataFrame:
    """One row per group: number of images, and their names as a JSON list; bounded by the caller's top-n selection."""
    return images.groupBy(by).agg(F.count(F.lit(1)).alias("n_images"), F.to_json(F.array_sort(F.collect_list("file_name"))).alias("files"))


def parsed_granules(granules: DataFrame, parse, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of binary granules(path, content), parsed one by one on the executors; parse(path, bytes) yields row tuples.

    A granule that parse cannot read gives no rows, not even those before the fault, and one row (path, reason) in rejects. Both come
    from one pass, whose result is kept in the shared folder. Null contents are rejected.
    """
    fields = T.StructType.fromDDL(schema)
    names = [f.name for f in fields]
    both = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField("__path", T.StringType()), T.StructField("__reason", T.StringType())])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(*r, p, None) for r in parse(p, content)]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file, its name and reason are kept
                    rows.append((*[None] * len(names), p, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*names, "__path", "__reason"])

    out = materialize(granules.select("path", "content").mapInPandas(run, both))
    return out.filter("__reason is null").select(*names), out.filter("__reason is not null").select(F.col("__path").alias("path"), F.col("__reason").alias("reason"))


def granule_rows(spark: SparkSession, path: str, parse, schema: str) -> tuple[DataFrame, DataFrame]:
    """parsed_granules of the binary files under path."""
    return parsed_granules(spark.read.format("binaryFile").load(path), parse, schema)


#: Detection granule: a header (magic, number of detections, scale, offset, valid_max), then arrays of ids (int64), longitudes,
#: latitudes (float64) and raw intensities (uint16), all little-endian.
GRANULE_HEADER = "<4sIffH2x"
GRANULE_MAGIC = b"EDG1"
GRANULE_SCHEMA = "det_id long, lon double, lat double, intensity double"


def pack_granule(ids, lons, lats, raw, scale: float, offset: float, valid_max: int) -> bytes:
    import struct

    import numpy as np

    head = struct.pack(GRANULE_HEADER, GRANULE_MAGIC, len(ids), scale, offset, valid_max)
    return head + b"".join(np.asarray(a, dtype=t).tobytes() for a, t in ((ids, "<i8"), (lons, "<f8"), (lats, "<f8"), (raw, "<u2")))


def read_granule(path: str, content: bytes):
    """Detections of a granule with calibrated intensity, (raw - offset) / scale; values above valid_max are fill and become null."""
    import struct

    import numpy as np

    size = struct.calcsize(GRANULE_HEADER)
    if content is None or len(content) < size:
        raise ValueError("no header")
    magic, n, scale, offset, valid_max = struct.unpack_from(GRANULE_HEADER, content)
    if magic != GRANULE_MAGIC:
        raise ValueError("not a detection granule")
    if len(content) != size + 26 * n:
        raise ValueError(f"{len(content) - size} bytes for {n} detections")
    if scale == 0:
        raise ValueError("scale is 0")
    at = size
    columns = []
    for kind, width in (("<i8", 8), ("<f8", 8), ("<f8", 8), ("<u2", 2)):
        columns.append(np.frombuffer(content, kind, n, at))
        at += width * n
    ids, lons, lats, raw = columns
    value = (raw.astype("float64") - offset) / scale
    for i in range(n):
        yield int(ids[i]), float(lons[i]), float(lats[i]), None if raw[i] > valid_max else float(value[i])


class Sources:
    """Named lazy factories of DataFrames."""

    def __init__(self) -> None:
        self._make: dict = {}
        self._held: dict = {}

    def register(self, name: str, make) -> None:
        self._make[name] = make
        self._held.pop(name, None)

    def get(self, name: str) -> DataFrame:
        if name not in self._make:
            raise KeyError(f"no source {name}; there are {sorted(self._make)}")
        if name not in self._held:
            self._held[name] = self._make[name]()
        return self._held[name]


def config_from(defaults: dict, file_text: str | None = None, flags: dict | None = None) -> dict:
    """Defaults, overridden by a JSON file, overridden by flags; unknown keys are refused."""
    out = dict(defaults)
    for given in (json.loads(file_text) if file_text else {}, flags or {}):
        if unknown := set(given) - set(defaults):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out |= given
    return out
