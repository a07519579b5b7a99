"""The corpus pipeline: quality rules, near copies, secrets, mixing and packing, one after the other.

Every stage works on all its predecessor kept. Stages are written as Parquet to the shared scratch folder and
read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.llm import mixing
from batchkeeper.llm.packing import pack
from batchkeeper.llm.quality import passing
from batchkeeper.llm.secrets import scan_secrets
from batchkeeper.llm.superminhash import near_duplicates
from batchkeeper.llm.text import prepare
from batchkeeper.session import materialize

TOKENIZER = "byte_bpe_50k.json"


def _as_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Each document as one value, beside the named columns: no name of an operator's can meet one of its own."""
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep."""
    return passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id come after all others.

    Each row takes part by its own text: rows that share an id, or have none, go only as copies of one that stays.
    Of rows without any word, which are nobody's copies, one of each id and text stays, and all without an id.
    """
    # written once, as the numbers of a second run may differ; whole rows are held here only
    numbered = _as_rows(docs).withColumn("place", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    found = materialize(near_duplicates(numbered.select("place", "row.text"), "place"), "near_duplicates")
    found = found.select(F.col("doc_id").alias("place"), "n_shingles", "component_id")
    # who stays is told by narrow columns
    mark = F.xxhash64("row.text").alias("mark")
    marks = numbered.select("place", F.col("row.doc_id").alias("id"), mark, F.sha2("row.text", 256).alias("digest"), "row.source", "row.lang", "row.n_chars")
    order = F.struct(F.isnull("id").alias("last"), "id", "mark", "source", "lang", "n_chars", "place")
    members = materialize(found.join(marks, "place").withColumn("order", order), "members")
    copies = members.where("n_shingles > 0").select(F.struct(F.lit("group"), F.col("component_id").cast("string"), F.lit("")).alias("group"), "order")
    blank = members.where("n_shingles = 0 and id is not null")
    blank = blank.select(F.struct(F.lit("blank"), F.col("id").cast("string"), F.coalesce("digest", F.lit("null"))).alias("group"), "order")
    every = copies.unionByName(blank)
    leads = every.groupBy("group").agg(F.min("order").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = every.join(leads, "group").where("order.place <> lead.place").select(F.col("order.place").alias("place"))
    return numbered.join(materialize(gone, "gone"), "place", "left_anti").select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; their secrets are replaced by a mark, and ``n_chars`` follows."""
    found = scan_secrets(_as_rows(docs, "text"))
    hit = F.size("secret_spans") > 0
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    own = {c: F.col("row")[c] for c in docs.columns}
    return found.select(*[F.when(hit, new[c]).otherwise(v).alias(c) if c in new else v.alias(c) for c, v in own.items()])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it: zero to three rows."""
    planned = mixing.mix(mixing.measured(_as_rows(docs, "doc_id", "text", "source")))
    copies = F.explode(F.array_repeat(F.lit(True), F.col("repetitions").cast("int")))
    return planned.select("row", copies.alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

# Trees, signatures and token ids are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
