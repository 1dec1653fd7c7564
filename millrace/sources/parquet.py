"""Parquet files and globs as DataFrames."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import SourceProblem

MAX_FILES = 1000  # fixed value: limit of the dialect
FILE_COLUMN = "_file"


def is_pattern(path: str) -> bool:
    return bool(re.search(r"[*?\[\]{}]", path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder; a pattern reads all files that match, with the column ``_file`` of each row's file.

    Files of a pattern may differ in columns; missing ones are null.
    """
    try:
        if not is_pattern(path):
            return spark.read.parquet(path)
        df = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceProblem(f"no files match pattern: {path}" if is_pattern(path) else f"no such file: {path}") from e
        raise SourceProblem(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    except Exception as e:
        raise SourceProblem(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    count = len(df.inputFiles())
    if count > MAX_FILES:
        raise SourceProblem(f"pattern matched too many files: {count}, at most {MAX_FILES}: {path}")
    return df.withColumn(FILE_COLUMN, F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
