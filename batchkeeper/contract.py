"""The data contract: what every dataset must look like, held as data.

The file layout read by :meth:`Contract.from_dict` is the declarative one a data
team keeps next to its jobs (``datasets:`` with schema, keys, bounds, tolerances
and SLA, plus a remediation policy). Rules are also exposed as small DataFrames,
so that checks join them instead of looping over them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from batchkeeper.session import literal_table

# Contract type name -> Spark SQL type name.
TYPES = {
    "string": "string",
    "date": "date",
    "timestamp": "timestamp",
    "integer": "int",
    "long": "bigint",
    "float": "double",
    "boolean": "boolean",
}


@dataclass(frozen=True)
class ForeignKey:
    column: str
    ref_dataset: str
    ref_column: str


@dataclass(frozen=True)
class RowBounds:
    lower: float
    upper: float
    scope: str  # "table" or "batch"


@dataclass(frozen=True)
class DatasetContract:
    name: str
    schema: dict[str, str]
    source: str = "csv"
    path_pattern: str | None = None
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    row_bounds: RowBounds | None = None
    null_tolerance: dict[str, float] = field(default_factory=dict)
    max_delay_hours: float | None = None
    accepted_values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    table: str | None = None

    @property
    def columns(self) -> list[str]:
        return list(self.schema)

    @property
    def ts_column(self) -> str | None:
        """Event-time column: the first timestamp of the schema."""
        return next((c for c, t in self.schema.items() if t == "timestamp"), None)

    @property
    def is_fact(self) -> bool:
        return bool(self.path_pattern and "{date}" in self.path_pattern)

    def spark_type(self, column: str) -> str:
        declared = self.schema[column]
        if declared not in TYPES:
            raise ValueError(f"{self.name}.{column}: unknown contract type {declared!r}")
        return TYPES[declared]

    def raw_schema(self) -> T.StructType:
        """All columns as text: how files are staged before anything is trusted."""
        return T.StructType([T.StructField(c, T.StringType()) for c in self.schema])

    def path(self, root: str, date: str | None = None) -> str:
        if self.path_pattern is None:
            raise ValueError(f"{self.name}: no path pattern")
        if self.is_fact and date is None:
            raise ValueError(f"{self.name}: a batch date is needed")
        return f"{root.rstrip('/')}/{self.path_pattern.replace('{date}', str(date))}"

    @staticmethod
    def from_dict(name: str, raw: dict[str, Any], table: str | None = None) -> DatasetContract:
        keys = raw.get("primary_key") or ()
        references = []
        for column, target in (raw.get("foreign_keys") or {}).items():
            dataset, ref_column = target.split(".", 1)
            references.append(ForeignKey(column, dataset, ref_column))
        bounds = None
        for entry, scope in (("expected_row_count", "table"), ("expected_row_count_per_batch", "batch")):
            if raw.get(entry):
                bounds = RowBounds(raw[entry]["min"], raw[entry]["max"], scope)
        sla = raw.get("freshness_sla") or {}
        return DatasetContract(
            name=name,
            schema=dict(raw["schema"]),
            source=raw.get("source", "csv"),
            path_pattern=raw.get("path_pattern"),
            primary_key=(keys,) if isinstance(keys, str) else tuple(keys),
            foreign_keys=tuple(references),
            row_bounds=bounds,
            null_tolerance=dict(raw.get("null_tolerance") or {}),
            max_delay_hours=sla.get("max_delay_hours"),
            accepted_values={c: tuple(v) for c, v in (raw.get("accepted_values") or {}).items()},
            table=table,
        )


@dataclass(frozen=True)
class Contract:
    datasets: dict[str, DatasetContract]
    policy: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DatasetContract:
        return self.datasets[name]

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> Contract:
        tables = {}
        for section in raw.values():
            if isinstance(section, dict) and isinstance(section.get("tables"), dict):
                tables = section["tables"]
        policy = (raw.get("agent") or {}).get("remediation_policy") or raw.get("remediation_policy") or {}
        datasets = {
            name: DatasetContract.from_dict(name, entry, tables.get(name))
            for name, entry in raw["datasets"].items()
        }
        return Contract(datasets, dict(policy))

    @staticmethod
    def from_file(path: str) -> Contract:
        with open(path, encoding="utf-8") as handle:
            if path.endswith(".json"):
                return Contract.from_dict(json.load(handle))
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("PyYAML is needed for YAML contracts; JSON works without it") from error
            return Contract.from_dict(yaml.safe_load(handle))

    # Rules as DataFrames. Each holds one row per declared rule.

    def bounds_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (d.name, d.row_bounds.scope, float(d.row_bounds.lower), float(d.row_bounds.upper))
            for d in self.datasets.values()
            if d.row_bounds
        ]
        return literal_table(spark, rows, "dataset string, scope string, lower double, upper double")

    def tolerance_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(d.name, c, float(rate)) for d in self.datasets.values() for c, rate in d.null_tolerance.items()]
        return literal_table(spark, rows, "dataset string, column_name string, tolerance double")

    def foreign_key_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (d.name, k.column, k.ref_dataset, k.ref_column)
            for d in self.datasets.values()
            for k in d.foreign_keys
        ]
        return literal_table(
            spark, rows, "dataset string, column_name string, ref_dataset string, ref_column string"
        )

    def freshness_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (d.name, d.ts_column, float(d.max_delay_hours))
            for d in self.datasets.values()
            if d.max_delay_hours is not None
        ]
        return literal_table(spark, rows, "dataset string, ts_column string, max_delay_hours double")

    def policy_frame(self, spark: SparkSession) -> DataFrame:
        return policy_frame(spark, self.policy)


def policy_frame(spark: SparkSession, policy: dict[str, str]) -> DataFrame:
    return literal_table(spark, list(policy.items()), "failure_category string, policy string")
