"""Tables in and files out: explicit schemas, column checks, path configuration, CSV, JSON and Markdown sinks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Required columns and file names of each table.
REQUIRED = {
    "documents": ("doc_id", "text"),
    "train": ("qid", "question", "gold_doc_id"),
    "test": ("qid", "question"),
    "sample_submission": ("qid", "doc_id"),
}
FILES = {"documents": "documents.csv", "train": "train.csv", "test": "test.csv", "sample_submission": "sample_submission.csv"}
IDS = ("doc_id", "qid", "gold_doc_id")
INTEGERS = ("gold_evidence_char_start", "gold_evidence_char_end", "strict_cv_fold", "relaxed_cv_fold", "rank", "fold")


#: Folders that an experiment writes to, inside the outputs.
OUTPUTS = ("predictions", "metrics", "submissions")


#: Column of `scan` with the rows that don't fit the schema, what null is in CSV (so that "" stays an empty text), and Spark's modes for rows that don't fit.
BAD = "_bad_record"
NULL = "\\N"
MODES = {"fail": "FAILFAST", "keep": "PERMISSIVE", "drop": "DROPMALFORMED"}
#: The record that an experiment leaves.
RECORD = (
    "experiment string, retriever map<string, string>, num_documents long, num_queries long, num_dev_queries long, num_holdout_queries long, top_k long, retrieve_k long, metric_ks array<long>, "
    "fold_metrics array<map<string, double>>, all_metrics map<string, struct<strict_cv_mean: double, strict_cv_std: double, strict_holdout: double>>"
)


@dataclass(frozen=True)
class Paths:
    raw_data_dir: str
    processed_data_dir: str
    outputs_dir: str


def load_paths(path: str, root: str | None = None) -> Paths:
    """Paths of a YAML file; ~ is the home folder, and relative ones start at root (the working folder by default). KeyError names the keys that are missing."""
    import yaml

    base = Path(root or ".").resolve()
    spec = yaml.safe_load((base / Path(path).expanduser()).read_text(encoding="utf-8")) or {}
    missing = [k for k in Paths.__dataclass_fields__ if k not in spec]
    if missing:
        raise KeyError(f"missing keys: {missing}")
    place = lambda value: value if "://" in value else str(base / Path(value).expanduser())
    return Paths(*(place(str(spec[k])) for k in Paths.__dataclass_fields__))


def ensure_output_dirs(paths: Paths) -> None:
    for folder in (paths.processed_data_dir, *(f"{paths.outputs_dir}/{x}" for x in OUTPUTS)):
        Path(folder).mkdir(parents=True, exist_ok=True)


def require_columns(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """df, or ValueError with the sorted missing columns; looks at the schema only."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return df


def require_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, or ValueError if its key is null or occurs twice."""
    if df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{name} has null or repeated values of {key}")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header: ids and text as strings as they stand, null text as '', known counts as integers."""
    try:
        df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    for c in df.columns:
        if c in INTEGERS:
            df = df.withColumn(c, F.col(c).cast("int"))
        elif c not in IDS:
            df = df.withColumn(c, F.coalesce(c, F.lit("")))
    return df


def scan(spark: SparkSession, path: str, schema: str, kind: str = "csv", bad: str = "fail", multiline: bool = True) -> DataFrame:
    """A CSV table with a header, or JSON lines, by a declared schema: the files are not read to guess types.

    A row that doesn't fit (a value of another type; in CSV another number of values) is an error, or with bad="keep"
    stands in the column _bad_record beside nulls, or with bad="drop" is left out; this does not depend on the columns
    that a query reads. A CSV header must name the columns in the order of the schema. CSV whose texts have line breaks
    needs multiline, and each file is then one task; JSON lines can always be split.
    """
    if bad not in MODES:
        raise ValueError(f"bad must be one of {sorted(MODES)}")
    if kind not in ("csv", "json"):
        raise ValueError("kind must be csv or json")
    reader = spark.read.schema(f"{schema}, {BAD} string" if bad == "keep" else schema).option("mode", MODES[bad])
    if bad == "keep":
        reader = reader.option("columnNameOfCorruptRecord", BAD)
    if kind == "json":
        return reader.json(path)
    return reader.options(header=True, enforceSchema=False, multiLine=multiline, escape='"', nullValue=NULL, columnPruning=False).csv(path)


def write_scannable(df: DataFrame, path: str, kind: str = "csv") -> None:
    """df as files that `scan` reads back as they were: blanks at the ends, quotes, line breaks, empty and null texts. Only a text that is \\N and nothing else becomes null in CSV."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").options(header=True, escape='"', nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, metric, strict_cv_mean, strict_cv_std, strict_holdout) of the records at path, a file, folder or pattern."""
    found = spark.read.schema(RECORD).options(multiLine=True, mode="FAILFAST").json(path)
    return found.select("experiment", F.explode("all_metrics").alias("metric", "_v")).select("experiment", "metric", "_v.*")


def load(spark: SparkSession, paths: Paths, name: str) -> DataFrame:
    """One of the four tables, checked; documents must have unique ids."""
    df = require_columns(read_csv(spark, f"{paths.raw_data_dir}/{FILES[name]}"), REQUIRED[name], name)
    return require_unique(df, "doc_id", name) if name == "documents" else df


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_csv(spark, path), ("qid", "strict_holdout_role", "strict_cv_fold"), "validation splits")


def inventory(spark: SparkSession, paths: Paths) -> list[dict]:
    """Whether each table exists, its rows and its columns."""
    out = []
    for name in FILES:
        try:
            df = read_csv(spark, f"{paths.raw_data_dir}/{FILES[name]}")
            out.append({"name": name, "exists": True, "rows": df.count(), "columns": df.columns})
        except FileNotFoundError:
            out.append({"name": name, "exists": False, "rows": None, "columns": None})
    return out


def from_documents(documents: DataFrame) -> DataFrame:
    """doc_id as a string and text without nulls, of any documents table."""
    return documents.select(F.col("doc_id").cast(T.StringType()).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by its key where its scan has fewer splits than the cluster has cores, so that costly expressions use all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ("qid", "rank"), single: bool = True) -> None:
    """A CSV folder with a header, ordered over its files by ranges of the keys; in one file only for small results."""
    keys = [c for c in order if c in df.columns]
    if single:
        df = df.repartition(1).sortWithinPartitions(*keys) if keys else df.coalesce(1)
    elif keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parts(df: DataFrame, path: str, by: tuple[str, ...], order: tuple[str, ...]) -> None:
    """A Parquet folder partitioned by `by`, in one pass: ranges of (by, order) go to tasks, so a part is cut into files by its order and a large one into many."""
    df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json(value, path: str) -> None:
    """A small summary as indented UTF-8 JSON."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def shown(x, percent: bool = False) -> str:
    """A value as reports show it: numbers to four places or as percentages, mappings as key: value, nothing as -."""
    if x is None:
        return "-"
    if isinstance(x, dict):
        return ", ".join(f"{k}: {shown(v, percent)}" for k, v in x.items())
    if isinstance(x, float):
        return f"{100 * x:.1f} %" if percent else f"{x:.4f}"
    return str(x)


def markdown_table(df: DataFrame, percent: tuple[str, ...] = ()) -> str:
    """A small, aggregated DataFrame as a Markdown table; the columns in percent are shares."""
    rows = df.collect()
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line([shown(x, c in percent) for c, x in zip(df.columns, r, strict=True)]) for r in rows]])


def write_report(title: str, sections: dict[str, DataFrame | str], path: str, percent: tuple[str, ...] = ()) -> None:
    """A Markdown report of named tables and paragraphs."""
    show = lambda x: x if isinstance(x, str) else markdown_table(x, percent)
    body = "\n\n".join(f"## {name}\n\n{show(x)}" for name, x in sections.items())
    Path(path).write_text(f"# {title}\n\n{body}\n", encoding="utf-8")
