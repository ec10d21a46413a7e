"""Ledgerlane: retail reports and order-processing jobs as PySpark DataFrames."""

from ledgerlane.sources.tables import Tables

__all__ = ["Tables"]
