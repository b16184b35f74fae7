"""File sources: plist annotations, image headers, spacing side files, CSV; and sinks. One file is one row."""

from __future__ import annotations

import json
import plistlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.scoring import join_values


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def read_plists(spark: SparkSession, path: str) -> DataFrame:
    """(pid, payload, error) of property-list XML files; payload is JSON text for the nested operators.

    pid is the file's name without ending. A file that does not parse has a null payload and its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, content in zip(pdf["pid"], pdf["content"]):
                try:
                    rows.append((pid, json.dumps(_plain(plistlib.loads(bytes(content)))), None))
                except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the batch
                    rows.append((pid, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["pid", "payload", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("pid"), "content").mapInPandas(run, "pid string, payload string, error string")


# fixed values: header elements by group and element number
HEADER_TAGS = {
    (0x0008, 0x0060): "modality", (0x0008, 0x0070): "manufacturer", (0x0008, 0x1090): "model", (0x0018, 0x0050): "thickness", (0x0018, 0x1210): "kernel",
    (0x0020, 0x000E): "series_uid", (0x0020, 0x0011): "series_number", (0x0020, 0x0013): "instance", (0x0020, 0x0032): "position", (0x0028, 0x0030): "spacing",
}
_LONG = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR", b"SV", b"UV"}
PIXELS = (0x7FE0, 0x0010)


def header_fields(data: bytes) -> dict[str, str]:
    """Text of the known elements of a little-endian image header, read up to the pixels."""
    at = 132 if data[128:132] == b"DICM" else 0
    out: dict[str, str] = {}
    explicit = True
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if (group, element) == PIXELS:
            break
        vr = data[at + 4 : at + 6]
        if group != 0x0002 and not (vr.isalpha() and vr.isupper()):
            explicit = False
        if explicit or group == 0x0002:
            size, start = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in _LONG else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
        else:
            size, start = struct.unpack_from("<I", data, at + 4)[0], at + 8
        if size == 0xFFFFFFFF:  # a sequence of open length ends with its delimiter
            end = data.find(b"\xfe\xff\xdd\xe0\x00\x00\x00\x00", start)
            at = end + 8 if end >= 0 else len(data)
            continue
        name = HEADER_TAGS.get((group, element))
        if name:
            out[name] = data[start : start + size].decode("latin-1").strip("\x00 ")
        at = start + size
    return out


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per image file: pid (its folder), path and header fields; z from the position, else the instance number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, header_fields(bytes(c))) for p, c in zip(pdf["path"], pdf["head"])], columns=["path", "h"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dcm").load(path)
    # the head is enough for the fields, so pixels never leave the JVM
    h = files.select("path", F.substring("content", 1, 262_144).alias("head")).mapInPandas(run, "path string, h map<string,string>")
    num = lambda c: F.expr(f"try_cast({c} as double)")
    h = h.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("pid"), *[F.col("h")[n].alias(n) for n in HEADER_TAGS.values()])
    h = h.withColumns({"series_uid": F.coalesce("series_uid", F.lit("")), "series_number": num("series_number").cast("long"), "instance": num("instance").cast("long"), "thickness": num("thickness")})
    return h.withColumns({"z": F.coalesce(num(r"get(split(position, '\\\\'), 2)"), F.col("instance").cast("double")), "kernel": join_values(F.split("kernel", r"\\"))})


def pick_series(headers: DataFrame) -> DataFrame:
    """The files of one series per patient: computed tomography if there is any, then most slices, lowest number, uid.

    The series number is that of the series' first file by path.
    """
    s = headers.groupBy("pid", "series_uid").agg(F.count("*").alias("n"), F.max((F.col("modality") == "CT").cast("int")).alias("ct"), F.min_by("series_number", "path").alias("number"))
    w = Window.partitionBy("pid").orderBy(F.desc_nulls_last("ct"), F.desc("n"), F.asc_nulls_last("number"), "series_uid")
    best = s.withColumn("i", F.row_number().over(w)).where("i = 1").select("pid", "series_uid")
    return headers.join(best, ["pid", "series_uid"], "left_semi")


def first_header(headers: DataFrame) -> DataFrame:
    """The header of each patient's first file by path."""
    cols = [c for c in headers.columns if c != "pid"]
    return headers.groupBy("pid").agg(F.min_by(F.struct(*cols), "path").alias("h")).select("pid", "h.*")


def read_spacing(spark: SparkSession, path: str) -> DataFrame:
    """(path, spacing) of JSON side files; anything but three positive numbers is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "spacing array<double>")["spacing"].alias("spacing"))
    ok = F.coalesce((F.size("spacing") == 3) & F.forall("spacing", lambda x: x > 0), F.lit(False))
    return raw.select("path", F.when(ok, F.col("spacing")).otherwise(F.raise_error(F.concat(F.lit("bad spacing in "), "path")).cast("array<double>")).alias("spacing"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header under a given schema, so ids stay text; only the asked columns are parsed."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, replaced as a whole; ``by`` gives folders that later reads prune."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, replaced as a whole; ``read_csv`` with the same schema gives the rows back."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nested columns and null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_spacing(df: DataFrame, path: str) -> None:
    """Side files of spacing (pid, spacing), one folder per pid; anything but three positive numbers is an error."""
    ok = F.coalesce((F.size("spacing") == 3) & F.forall("spacing", lambda x: x > 0), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("bad spacing of "), F.coalesce("pid", F.lit("?")))).cast("array<double>")
    df.select("pid", F.to_json(F.struct(F.when(ok, F.col("spacing")).otherwise(bad).alias("spacing"))).alias("value")).write.mode("overwrite").partitionBy("pid").text(path)


def missing_keys(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return expected.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def run_header(spark: SparkSession, tables: dict[str, DataFrame], parameters: dict[str, str]) -> DataFrame:
    """One row: parameters, and an order-free hash and row count of each input table."""
    out = spark.range(1).select(F.create_map(*[x for k, v in sorted(parameters.items()) for x in (F.lit(k), F.lit(v))]).alias("parameters")) if parameters else spark.range(1).select(F.lit(None).cast("map<string,string>").alias("parameters"))
    for name, t in tables.items():
        h = t.agg(F.count("*").alias(f"{name}_rows"), F.sha2(F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).cast("string"), 256).alias(f"{name}_hash"))
        out = out.join(h, F.lit(True))
    return out
