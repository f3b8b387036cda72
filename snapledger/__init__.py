"""Dated snapshots of many source databases, on Spark."""

from snapledger.plans.builder import build_query
from snapledger.plans.load import LoadOptions, batch_import, open_snapshots
from snapledger.sources.dataset import Dataset, UnknownTable, open_dataset

__all__ = ["Dataset", "LoadOptions", "UnknownTable", "batch_import", "build_query", "open_dataset",
           "open_snapshots"]
