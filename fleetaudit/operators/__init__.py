"""Operators over findings, audits and catalogues. Every function maps DataFrames to a DataFrame."""

AUDIT = ["org_id", "repo_id", "audit_id"]
REPO = ["org_id", "repo_id"]
