"""Readers of source folders and packages, by Spark's own file source: one row for each file or entry.

A package is a zip behind a header of HEADER bytes. Every size is checked before
and while an entry is unpacked, so a task holds one entry of bounded size.
"""

from __future__ import annotations

import io
import zipfile
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 40
#: Most bytes of a source entry, and of a manifest or symbol entry.
SOURCE_CAP, META_CAP = 16 << 20, 512 << 20
_META = ("navxmanifest.xml", "symbolreference.json")
_ENTRIES = "package string, entry string, kind string, text string, content_hash string, problem string"

MANIFEST = "struct<id:string,name:string,publisher:string,version:string,application:string,platform:string,dependencies:array<struct<id:string,appId:string,name:string,publisher:string,version:string>>>"


def read_sources(spark: SparkSession, root: str, suffix: str = ".al") -> DataFrame:
    """(path, text, content_hash) of every source file below ``root``, package folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    text = F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "")
    return files.where(~F.col("path").contains("/.alpackages/")).select("path", text.alias("text"), F.sha2("content", 256).alias("content_hash"))


def _unpack(batches):
    for b in batches:
        for path, blob, key in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            rows = list(_entries(blob.as_buffer()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array([key] * len(rows), pa.string()), pa.array(cols[3], pa.string())],
                ["package", "entry", "kind", "text", "content_hash", "problem"],
            )


def _entries(blob):
    """(entry, kind, text, problem) of what a package holds; what can't be read says why and gives no text."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(memoryview(blob)[HEADER:]))
    except (zipfile.BadZipFile, ValueError) as e:
        yield None, "package", None, f"no package: {e}"
        return
    for info in archive.infolist():
        low = info.filename.lower()
        kind = "source" if low.endswith(".al") else "meta" if low.rsplit("/", 1)[-1] in _META else None
        if not kind:
            continue
        cap = SOURCE_CAP if kind == "source" else META_CAP
        text = problem = None
        if info.file_size > cap:
            problem = f"over {cap} bytes"
        else:
            try:
                with archive.open(info) as f:
                    raw = f.read(cap + 1)
                if len(raw) > cap:
                    problem = f"over {cap} bytes"
                else:
                    text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
                problem = str(e)
        yield unquote(info.filename), kind, text, problem


def package_folders(spark: SparkSession, root: str, depth: int = 4) -> list[str]:
    """The package folders at most ``depth`` levels below ``root``; Spark's file source passes over hidden folders that are not named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for k in range(depth + 1) for s in fs.globStatus(path(f"{root.rstrip('/')}/{'*/' * k}.alpackages")) or []]
    return sorted(found)


def read_packages(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(package, entry, kind, text, content_hash, problem) of every source, manifest and symbol entry of the packages in ``folders``."""
    if not folders:
        return spark.createDataFrame([], _ENTRIES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.app").load(folders)
    return files.select("path", "content", F.sha2("content", 256).alias("content_hash")).mapInArrow(_unpack, _ENTRIES)


def manifests(entries: DataFrame) -> DataFrame:
    """(package, id, name, publisher, version, dependencies) from the manifest of each package."""
    app = lambda a: F.xpath_string("xml", F.lit(f"/Package/App/@{a}"))
    dep = lambda a: F.xpath("xml", F.lit(f"/Package/Dependencies/Dependency/@{a}"))
    xml = entries.where("lower(entry) like '%navxmanifest.xml' and text is not null").select("package", F.regexp_replace("text", r'\sxmlns="[^"]*"', "").alias("xml"))
    return xml.select("package", *(app(a).alias(a.lower()) for a in ("Id", "Name", "Publisher", "Version")), F.arrays_zip(dep("Id").alias("id"), dep("Name").alias("name"), dep("MinVersion").alias("min_version")).alias("dependencies"))


def app_manifest(files: DataFrame) -> DataFrame:
    """(path, app) of ``files(path, text)`` that are project manifests in JSON."""
    return files.where("path like '%/app.json' or path = 'app.json'").select("path", F.from_json("text", MANIFEST).alias("app"))


def first_provider(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """All rows of each key's provider of least priority number."""
    least = rows.groupBy(key).agg(F.min(priority).alias("_least"))
    return rows.join(least, key).where(F.col(priority) == F.col("_least")).drop("_least")
