"""File sets and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines

# Folders never scanned.
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", ".venv", "venv", "env", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", "dist", "build", ".next", ".nuxt",
    "coverage", "htmlcov", "vendor", "third_party", ".terraform", ".gradle", "target", ".idea", ".vscode",
]
# End of fixed values


def scannable(path) -> "F.Column":
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SKIP_DIRS]))


def decode(content) -> "F.Column":
    """Text of a file's bytes without its byte-order mark; null for binary files."""
    binary = F.instr(F.hex(F.substring(content, 1, 8192)), "00")
    # a zero byte sits at an odd position of the hex text
    has_nul = (binary > 0) & F.hex(F.substring(content, 1, 8192)).rlike("^(?:[0-9A-F]{2})*?00")
    text = F.regexp_replace(F.decode(content, "UTF-8"), "^\\x{FEFF}", "")
    return F.when(~has_nul, text)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Scan ``root/<org>/<repo>/<audit>/…``: one row per text file of any size Spark's binary source reads (2 GB)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    local = F.regexp_replace("path", "^[a-z0-9]+:(?://[^/]*)?", "")
    parts = F.split(F.substr(local, F.lit(len(prefix) + 2)), "/")
    rel = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    rows = raw.select(
        parts[0].alias("org_id"), parts[1].alias("repo_id"), parts[2].alias("audit_id"), rel.alias("path"),
        F.col("length").alias("size"), decode(F.col("content")).alias("text"))
    return rows.filter((F.col("path") != "") & scannable(F.col("path")) & F.col("text").isNotNull())


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1. Row-local: no shuffle."""
    keep = [c for c in files.columns if c not in ("text", "size")]
    return files.select(*keep, F.posexplode(split_lines("text")).alias("_pos", "text")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "text")
