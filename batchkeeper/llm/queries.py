"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.llm import ball_tree, mixing
from batchkeeper.llm.cotraining import classify
from batchkeeper.llm.html_text import extract_text
from batchkeeper.llm.language import identify
from batchkeeper.llm.lattice import near_vectors
from batchkeeper.llm.packing import pack
from batchkeeper.llm.pii import find_personal
from batchkeeper.llm.quality import quality_rules
from batchkeeper.llm.secrets import scan_secrets
from batchkeeper.llm.substring import remove_repeats
from batchkeeper.llm.superminhash import near_duplicates
from batchkeeper.llm.text import prepare
from batchkeeper.llm.variants import spelling_variants
from batchkeeper.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES["op1_lattice"] = op1_lattice


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES["op2_packing"] = op2_packing


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


QUERIES["op3_mixture"] = op3_mixture


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op4_cotraining"] = op4_cotraining


def op5_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


QUERIES["op5_tag_ratio"] = op5_tag_ratio


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


QUERIES["op6_debruijn"] = op6_debruijn


def op7_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op7_boosted_rules"] = op7_boosted_rules


def op8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"),
    )


QUERIES["op8_entropy"] = op8_entropy


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op9_superminhash"] = op9_superminhash


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.measured(_table(spark, sf_dir, "documents"))
    sized = materialize(sized.select("doc_id", "source", "mix_size", "mix_key"), "sizes")
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


QUERIES["op10_mixing"] = op10_mixing
ORACLE["op10_mixing"] = mixing.SQL


def op11_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "context")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


QUERIES["op11_bootstrap"] = op11_bootstrap


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES["op12_variants"] = op12_variants


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op13_ball_tree"] = op13_ball_tree
ORACLE["op13_ball_tree"] = ball_tree.SQL
