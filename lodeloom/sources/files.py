"""Reading text tables: CSV, Excel, JSON lines, JSON arrays, configuration."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodeloom.operators.sampling import uniform_sample

BOM = "﻿"


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool | None = None, sample: int | None = None, key: str = "idx", seed: int = 42
) -> DataFrame:
    """A CSV or Excel file with a header; every column is a string, a missing value is empty.

    No spelling of null is taken for one. ``columns`` are read alone, in the
    order of their first mention; one that is missing raises. A quoted value may
    hold line ends (``multiline``), for which a file must be one task; where it
    is not said, only files that do hold such values are read so. ``sample``
    keeps so many rows, by a seeded hash of ``key``.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        df = _read_excel(spark, path)
    else:
        multiline = _has_line_ends(spark, path) if multiline is None else multiline
        df = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.removeprefix(BOM) for c in df.columns)).na.fill("")
    if columns is not None:
        missing = [c for c in dict.fromkeys(columns) if c not in df.columns]
        if missing:
            raise ValueError(f"{path} lacks columns {missing}; it has {df.columns}")
        df = df.select(*dict.fromkeys(columns))
    return df if sample is None else uniform_sample(df, key, sample, seed)


def _has_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes: then a quoted value goes over its end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``row, vector`` of a matrix in NumPy's format; a missing file or another shape raises.

    The file is one row of Spark's binary source and is unpacked on an executor.
    """
    found = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                matrix = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if matrix.ndim != 2:
                    raise ValueError(f"a matrix is wanted, not {matrix.ndim} dimensions")
                for lo in range(0, len(matrix), 4096):
                    part = matrix[lo : lo + 4096].astype(np.float32)
                    at = pa.array((np.arange(len(part) + 1) * matrix.shape[1]).astype(np.int32))
                    vectors = pa.ListArray.from_arrays(at, pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), vectors], names=["row", "vector"])

    return found.mapInArrow(unpack, "row long, vector array<float>")


def _read_excel(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ModuleNotFoundError as e:
        raise RuntimeError(f"reading {path} needs openpyxl; save it as CSV instead") from e
    import pandas as pd

    frame = pd.read_excel(path, dtype=str, keep_default_na=False)
    schema = StructType([StructField(str(c), StringType()) for c in frame.columns])
    return spark.createDataFrame(frame.itertuples(index=False, name=None), schema)


def _parsed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType([*kind.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped.

    A corrupt line raises when it is read if ``strict``, else it is left out
    (``corrupt_lines`` has it).
    """
    rows = _parsed(spark, path, schema)
    if strict:
        bad = F.raise_error(F.concat(F.lit("corrupt line: "), F.substring("_corrupt", 1, 200))).cast("boolean")
        rows = rows.filter(F.when(F.col("_corrupt").isNull(), F.lit(True)).otherwise(bad))
    else:
        rows = rows.filter("_corrupt is null")
    return rows.drop("_corrupt")


def corrupt_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``line``: those that ``read_jsonl`` cannot read."""
    return _parsed(spark, path, schema).filter("_corrupt is not null").select(F.col("_corrupt").alias("line"))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Files below a folder, by name, on whatever file system it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found, walk = [], root.getFileSystem(conf).listFiles(root, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if name.lower().endswith(suffix):
            found.append(name)
    return sorted(found)


def choose_source(spark: SparkSession, folder: str, languages: tuple[str, ...] = ("en", "de")) -> str:
    """The CSV file below ``folder`` with most rows in the languages (by their first two letters); ties: the first name.

    A file needs a subject column and one called language in any case.
    """
    best = ("", -1)
    for path in list_files(spark, folder, ".csv"):
        df = read_table(spark, path)
        named = [c for c in df.columns if c.lower() == "language"]
        if not named or "subject" not in df.columns:
            continue
        n = df.filter(F.lower(F.substring(F.col(f"`{named[0]}`"), 1, 2)).isin(*languages)).count()
        if n > best[1]:
            best = (path, n)
    if not best[0]:
        raise FileNotFoundError(f"no CSV file with language and subject below {folder}")
    return best[0]


def first_path(*candidates: str | None) -> str:
    """The first path that is given."""
    for c in candidates:
        if c:
            return c
    raise ValueError("no input path is given")


def find_named(spark: SparkSession, folder: str, name: str) -> str | None:
    """The first file called ``name``, or the first file in a folder so called, below ``folder``; none if there is none."""
    for path in list_files(spark, folder, ""):
        parts = path.split("/")
        if parts[-1] == name:
            return path
        if name in parts[:-1]:
            return "/".join(parts[: parts.index(name) + 1])
    return None


def resolve_input(config: dict, given: str | None = None, aspects: str | None = None) -> str:
    """The tickets to work on: the fixed sample of the configuration, else the given file, the given aspects, and those two of the configuration; none is an error."""
    named = (config.get("sample_csv"), given, aspects, config.get("input_tickets_csv"), config.get("aspects_csv"))
    return first_path(*((str(x).strip() if x else None) for x in named))


def merged(base: dict, over: dict | None) -> dict:
    """What both mappings say, ``over`` where they differ: only mappings that both have are looked into."""
    both = {k for k in base if isinstance(base[k], dict) and isinstance((over or {}).get(k), dict)}
    return {**base, **(over or {}), **{k: merged(base[k], over[k]) for k in both}}


def read_yaml(path: str, overrides: str | None = None, section: str | None = None) -> dict:
    """A mapping in YAML, with that of ``overrides`` (or one section of it) merged over it.

    A file that holds no mapping raises; a section that is missing or empty changes nothing.
    """
    base = _yaml(path)
    if not (overrides and overrides.strip()):
        return base
    over = _yaml(overrides.strip())
    if section is not None:
        over = over.get(section) or {}
        if not isinstance(over, dict):
            raise ValueError(f"{overrides}: {section} holds no mapping")
    return merged(base, over)


def _yaml(path: str) -> dict:
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError(f"reading {path} needs PyYAML; write it as JSON instead") from e
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def read_config(path: str) -> dict:
    """A configuration in JSON, or in lines ``key: value`` with true, false and numbers read as such; # begins a remark at the start of a line or after white space."""
    text = Path(path).read_text(encoding="utf-8")
    if text.lstrip().startswith(("{", "[")):
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError(f"{path} holds no mapping")
        return found
    out = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip() and not line.lstrip().startswith("#"):
            out[key.strip()] = _scalar(re.split(r"\s#", value, maxsplit=1)[0].strip())
    return out


def _scalar(text: str) -> bool | int | float | str:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")
