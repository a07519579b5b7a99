"""Session settings and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Shuffle partition counts and memory stay
# with the cluster; adaptive execution merges or splits the shuffles it gets.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join also where the next aggregate would have reused its partitions
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


INPUT_PER_PARTITION = 256 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_sizes: dict[str, dict[str, int]] = {}


def configure(spark: SparkSession, *inputs: str) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built.

    ``inputs`` are the files or folders that what follows will read: see :func:`size_by`.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    _sizes[spark.sparkContext.applicationId] = {}
    spark.conf.unset(INITIAL_PARTITIONS)
    for path in inputs:
        size_by(spark, path)
    return spark


def size_by(spark: SparkSession, path: str) -> None:
    """Let shuffles start with one partition per 256 MB of all inputs named since :func:`configure`.

    At least what the session asks for, and as many as the inputs need; adaptive execution
    then merges those that turn out small. It cannot do the opposite, and 200 partitions of
    a 100 TB input fit nowhere.
    """
    sizes = _sizes.setdefault(spark.sparkContext.applicationId, {})
    if path not in sizes:
        sizes[path] = folder_size(spark, path)
        wanted = sum(sizes.values()) // INPUT_PER_PARTITION
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
        spark.conf.set(INITIAL_PARTITIONS, str(partitions))


def folder_size(spark: SparkSession, path: str) -> int:
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = handle.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getContentSummary(handle).getLength() if fs.exists(handle) else 0


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: what the cluster names, else (local mode only) a temp dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="batchkeeper-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small fixed table as SQL VALUES: the planner knows its rows, and no job or Python worker reads it."""
    fields = [f.strip().split(None, 1) for f in schema.split(",")]

    def cell(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"{value!r}D"
        if isinstance(value, int):
            return str(value)
        escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"

    rows = [tuple(r) for r in rows]
    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows or [(None,) * len(fields)])
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    columns = ", ".join(f"CAST(c{i} AS {kind}) AS `{name}`" for i, (name, kind) in enumerate(fields))
    table = spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({names})")
    return table if rows else table.limit(0)


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch root, grouped by application so that an operator can expire it as a whole."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table, so a lost executor costs no recomputation."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
