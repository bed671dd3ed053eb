"""Loads every pack and prepares the tables packs read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import dependencies as D
from ..operators import graph as _graph  # noqa: F401 - registers the architecture pack
from ..operators import languages as L
from ..session import cut_lineage
from ..sources.files import explode_lines
from . import code as _code  # noqa: F401
from . import devops as _devops  # noqa: F401
from . import observability as _observability  # noqa: F401
from . import testing as _testing  # noqa: F401
from . import web as _web  # noqa: F401
from .engine import Pack, register

register(Pack("dependencies", "Dependency hygiene", ("dependencies",), lambda t: D.hygiene(t["files"])))


def prepare(files: DataFrame, lines: DataFrame | None = None,
            need: tuple[str, ...] = ("frameworks", "profile")) -> dict[str, DataFrame]:
    """Tables shared by the packs. ``files`` has (audit keys, path, text); the small derived tables are written once."""
    tables = {"files": files, "lines": explode_lines(files) if lines is None else lines}
    if "frameworks" in need:
        tables["frameworks"] = cut_lineage(L.frameworks(files))
    if "profile" in need:
        tables["profile"] = cut_lineage(L.app_profile(files))
    return tables
