"""Fraud analytics on transaction tables, expressed as Spark jobs."""

from .config import DEFAULT_POLICY, DEFAULT_WINDOWS, ScalePolicy, TxnConfig

__all__ = ["DEFAULT_POLICY", "DEFAULT_WINDOWS", "ScalePolicy", "TxnConfig"]
