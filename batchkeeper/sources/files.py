"""Raw batches: headered CSV and JSON lines, always read by name and as text.

Spark's typed CSV reader maps columns by position, so a renamed column passes
unseen and an unparsable value looks like a NULL. Everything here therefore
arrives as strings under the names the file itself gives; typing is a separate,
checked step (``functions.casting``).

A line with more or fewer fields than its file's header, and a line that is no JSON object, would lose
what it holds in a row of NULLs. Such lines stay whole in the column ``_malformed``, which is NULL for all others.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchkeeper.contract import DatasetContract
from batchkeeper.functions.casting import MALFORMED
from batchkeeper.sources.storage import matching

TASK_RUN_SCHEMA = (
    "dag_id string, task_id string, execution_date date, try_number int, state string, "
    "started_at timestamp, ended_at timestamp, log_text string"
)


def _date_pattern(contract: DatasetContract) -> str:
    """Regex that takes the batch date out of a landed path. A batch may be one file or a folder of parts."""
    before, after = contract.path_pattern.split("{date}")
    return re.escape(before) + r"(\d{4}-\d{2}-\d{2})" + re.escape(after)


def _with_malformed(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*columns, MALFORMED)])


def _names(header: tuple[str, ...]) -> list[str]:
    """A file's column names; empty ones are numbered, and so are those that occur again or are taken here."""
    out: list[str] = []
    for i, name in enumerate(header):
        out.append(f"_c{i}" if not name else f"{name}_{i}" if name in (*out, MALFORMED) else name)
    return out


def _csv_parts(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """CSV files, in groups of equal header: a read of several files applies one header to all of them."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in observed_headers(spark, paths).items():
        groups.setdefault(header, []).append(path)
    # without pruning each line is taken apart in full, so that its number of fields is known
    reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False)
    return [reader.schema(_with_malformed(_names(h))).csv(sorted(own)) for h, own in sorted(groups.items())]


def _united(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], _with_malformed([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return _united(spark, _csv_parts(spark, [path]))


def _json(spark: SparkSession, contract: DatasetContract, paths) -> DataFrame:
    reader = spark.read.schema(_with_malformed(contract.columns)).option("columnNameOfCorruptRecord", MALFORMED)
    return reader.json(paths)


def read_dimension(spark: SparkSession, contract: DatasetContract, root: str) -> DataFrame:
    """A whole dimension file, as text."""
    return _csv(spark, contract.path(root))


def read_batch(spark: SparkSession, contract: DatasetContract, root: str, date: str) -> DataFrame:
    """One daily file, as text."""
    path = contract.path(root, date)
    if path.endswith((".jsonl", ".json")):
        return read_events(spark, contract, path)
    return _csv(spark, path)


def read_events(spark: SparkSession, contract: DatasetContract, path: str) -> DataFrame:
    """JSON lines with the declared fields as text. Undeclared fields: see :func:`json_fields`."""
    return _json(spark, contract, path)


def json_fields(spark: SparkSession, path: str) -> DataFrame:
    """(field, n_rows): every key that occurs in a JSON-lines batch, pre-counted per task."""
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    return spark.read.text(path).select(F.explode(keys).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def batch_files(
    spark: SparkSession,
    contract: DatasetContract,
    root: str,
    date_from: str,
    date_to: str,
) -> dict[str, str]:
    """Landed files of a date range, ``{date: path}``; days without a file are absent."""
    found = {}
    for path in matching(spark, contract.path(root, "*")):
        day = re.search(_date_pattern(contract), path)
        if day and date_from <= day.group(1) <= date_to:
            found[day.group(1)] = path
    return found


def observed_columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, column_name, ordinal): the header evidence of CSV files, or of folders of them, in one job.

    A file's header is the first line of its first block; ``file`` is its full path.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.monotonically_increasing_id().alias("line"),
    )
    headers = lines.filter("begin = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    # commas inside quotes part no columns
    names = F.split("header", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    cells = headers.select("file", F.posexplode(names).alias("ordinal", "name"))
    return cells.select("file", F.regexp_replace("name", '^"|"$', "").alias("column_name"), "ordinal")


def observed_headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """Header of each CSV file; one row per file reaches the driver."""
    per_file = observed_columns(spark, paths).groupBy("file").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("names")
    )
    return {row["file"]: tuple(row["names"]) for row in per_file.collect()}


def read_batches(
    spark: SparkSession,
    contract: DatasetContract,
    root: str,
    date_from: str,
    date_to: str,
) -> DataFrame:
    """All landed files of a date range, with ``batch_date`` taken from the path.

    Columns are united by name. No file in the range: no rows.
    """
    files = batch_files(spark, contract, root, date_from, date_to)
    day = F.regexp_extract(F.col("_metadata.file_path"), _date_pattern(contract), 1)
    paths = list(files.values())
    if not paths:
        return spark.createDataFrame([], _with_malformed(contract.columns)).withColumn("batch_date", F.lit(None).cast("date"))
    is_json = contract.path_pattern.endswith((".jsonl", ".json"))
    parts = [_json(spark, contract, paths)] if is_json else _csv_parts(spark, paths)
    return _united(spark, [p.select("*", F.to_date(day).alias("batch_date")) for p in parts])


def landings(
    spark: SparkSession, contract: DatasetContract, root: str, date_from: str, date_to: str
) -> DataFrame:
    """(dataset, batch_date, landed_at) for every day of the range; ``landed_at`` is NULL for absent batches.

    Only file metadata is read: the content column is pruned. A batch of several parts
    has landed when its last part has.
    """
    days = F.sequence(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    calendar = spark.range(1).select(F.lit(contract.name).alias("dataset"), F.explode(days).alias("batch_date"))
    paths = list(batch_files(spark, contract, root, date_from, date_to).values())
    if not paths:
        return calendar.withColumn("landed_at", F.lit(None).cast("timestamp"))
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    day = F.to_date(F.regexp_extract("path", _date_pattern(contract), 1))
    landed = seen.groupBy(day.alias("batch_date")).agg(F.max("modificationTime").alias("landed_at"))
    return calendar.join(landed, "batch_date", "left").select("dataset", "batch_date", "landed_at")


def read_task_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run history exported by the scheduler as JSON lines."""
    return spark.read.schema(TASK_RUN_SCHEMA).json(path)
