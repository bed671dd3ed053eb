"""Fleet-scale code-audit analytics on Spark DataFrames."""

from .session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
