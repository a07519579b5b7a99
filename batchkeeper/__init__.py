"""batchkeeper: data-contract checks, incidents and safe repair as Spark jobs."""

from batchkeeper.contract import Contract, DatasetContract, ForeignKey, RowBounds
from batchkeeper.session import configure

__all__ = ["Contract", "DatasetContract", "ForeignKey", "RowBounds", "configure"]
