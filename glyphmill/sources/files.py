"""Readers and writers: JSON lines, whole texts, CSV, XML text, and bundles of result sheets."""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_S = StringType()
#: Columns of a raw corpus file.
DOCS = StructType([StructField(c, _S) for c in ("doc_id", "corpus", "author", "texttype", "text")])
#: Columns of a problem list.
METADATA = StructType([StructField(c, _S) for c in ("problem", "corpus", "known_author", "unknown_author")])
#: Names of the sheets that a finished result has.
SHEETS = ("docs", "known", "unknown", "metadata", "no_context", "LLR")


#: Stands for null in CSV files.
NULL_MARK = "\\N"


def read_jsonl(spark: SparkSession, path: str, schema: StructType, bad: str | None = None) -> DataFrame:
    """One JSON object a line, or a list of one object; the schema is given, never inferred.

    Lines that are neither come out with all columns null, and with their text in column ``bad`` if that is named.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    one = F.from_json("value", schema)
    row = F.when(F.ltrim("value").startswith("["), F.get(F.from_json("value", ArrayType(schema)), F.lit(0))).otherwise(one)
    out = lines.select(row.alias("r"), F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("_bad"))
    return out.select("r.*", *([F.col("_bad").alias(bad)] if bad else []))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of JSON-lines files; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: whole files as they stand, XML included."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with header as ``write_csv`` makes them; an unquoted empty value is null."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', nullValue=NULL_MARK, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1, lineSep="\n")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV files with header; line breaks and quotes inside values are kept, nulls are written as a mark of their own."""
    df.write.mode(mode).csv(path, header=True, escape='"', quoteAll=True, nullValue=NULL_MARK, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")


def required(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; raises where one is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no columns {missing}")
    return df.select(*columns)


def read_tagged(spark: SparkSession, folders: dict[str, str], schema: StructType, tag: str = "source") -> DataFrame:
    """JSON-lines folders under one roof, each row with its folder's name; missing folders are skipped."""
    frames = []
    jvm = spark.sparkContext._jvm
    for name, path in sorted(folders.items()):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
            frames.append(read_jsonl(spark, path, schema).withColumn(tag, F.lit(name)))
    if not frames:
        return spark.createDataFrame([], StructType([*schema, StructField(tag, _S)]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def impostor_rows(impostors: DataFrame, docs: DataFrame) -> DataFrame:
    """Impostor rows of the given documents; documents without any are skipped, none at all is an error."""
    wanted = docs.select("doc_id").distinct()
    found = impostors.join(wanted, "doc_id", "left_semi")
    if found.limit(1).count() == 0:
        raise ValueError("no impostors for any document")
    return found


def sheet_name(name: str) -> str:
    """A sheet's name without regard to case, blanks and underscores."""
    plain = re.sub(r"[\s_]+", "", name).lower()
    return next((s for s in SHEETS if re.sub(r"[\s_]+", "", s).lower() == plain), plain)


def write_bundle(sheets: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """A result as one folder of Parquet a sheet, in place of a workbook; the sheets given replace their namesakes only."""
    for name, df in sheets.items():
        df.write.mode(mode).parquet(f"{path}/{sheet_name(name)}")


def write_result(path: str, known: DataFrame, unknown: DataFrame, no_context: DataFrame, docs: DataFrame, metadata: DataFrame, llr: DataFrame | None = None, mode: str = "overwrite") -> None:
    """A finished result as a bundle of its six sheets; without ``llr`` that sheet is the list of phrases and occurrences to be filled in."""
    if llr is None:
        keys = [c for c in ("phrase_num", "phrase_occurence", "original_phrase") if c in known.columns and c in unknown.columns]
        llr = known.select(*keys).unionByName(unknown.select(*keys)).distinct()
    write_bundle({"docs": docs, "known": known, "unknown": unknown, "no_context": no_context, "metadata": metadata, "LLR": llr}, path, mode)


def read_bundle(spark: SparkSession, path: str, names: list[str] | None = None, required: bool = True) -> dict[str, DataFrame | None]:
    """Sheets of a bundle by name (all if none are named). A missing one raises, or is None if not required."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {sheet_name(s.getPath().getName()): str(s.getPath().getName()) for s in fs.listStatus(fs_path) if s.isDirectory()}
    out: dict[str, DataFrame | None] = {}
    for name in names or sorted(there):
        key = sheet_name(name)
        if key not in there:
            if required:
                raise ValueError(f"no sheet {name!r} in {path}")
            out[name] = None
        else:
            out[name] = spark.read.parquet(f"{path}/{there[key]}")
    return out


def error_path(folder: str, now: datetime.datetime | None = None) -> str:
    """A new file name for an error report: time and a random part."""
    return f"{folder}/{(now or datetime.datetime.now(datetime.UTC)).strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex}.txt"


def save_error(spark: SparkSession, message: str, folder: str) -> str:
    path = error_path(folder)
    spark.createDataFrame([(message,)], "value string").coalesce(1).write.text(path)
    return path
