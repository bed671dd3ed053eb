"""Dependency declarations and exact pins out of manifest and lock files.

Every parser works inside the file's own row (split, extract, explode): a manifest is bounded by the file size limit,
so no window or shuffle is needed until pins are deduplicated. Input: (audit keys, path, text).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, python_package, split_lines, yaml_section
from ..functions.versions import version_tuple
from ..operators import AUDIT

# Manifest formats.
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(\[[^\]]*\])?\s*(.*)$"
REQUIREMENT_PIN = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*===?\s*([\w.+!-]+)"
PEP508 = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)\)?"
PIN_VERSION = r"^[\w.+!-]+$"
NPM_ALIAS = r"^npm:((?:@[^/@\s]+/)?[^@\s]+)"
NON_REGISTRY = (r"(?i)^(?:file|link|workspace|portal|patch|git(?:\+[a-z]+)?|https?|github|gitlab|bitbucket):"
                r"|^[\w.-]+/[\w.-]+(?:#\S*)?$")
JS_LOCKS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "bun.lockb", "bun.lock"]
PY_LOCKS = ["poetry.lock", "Pipfile.lock", "uv.lock", "pdm.lock"]
# End of fixed values


def named(files: DataFrame, *names: str) -> DataFrame:
    return files.filter(basename("path").isin(*names))


def requirement_files(files: DataFrame) -> DataFrame:
    name = basename("path")
    return files.filter(name.startswith("requirements") & name.endswith(".txt"))


def requirement_lines(files: DataFrame) -> DataFrame:
    """Numbered requirement lines with the comment removed."""
    return requirement_files(files).select(
        *AUDIT, "path", F.posexplode(split_lines("text")).alias("_pos", "raw")).select(
        *AUDIT, "path", (F.col("_pos") + 1).alias("line_no"), "raw",
        F.trim(F.substring_index("raw", "#", 1)).alias("line"))


def requirement_entries(files: DataFrame) -> DataFrame:
    """(line_no, name, spec) of every index requirement."""
    rows = requirement_lines(files).filter(
        (F.col("line") != "") & ~F.col("line").startswith("-") & ~F.col("line").rlike(r"git\+|https?://")
        & F.col("line").rlike(REQUIREMENT))
    spec = F.trim(F.substring_index(F.regexp_extract("line", REQUIREMENT, 3), ";", 1))
    return rows.select(*AUDIT, "path", "line_no", F.regexp_extract("line", REQUIREMENT, 1).alias("name"),
                       spec.alias("spec"))


PACKAGE_JSON = ("dependencies map<string,string>, devDependencies map<string,string>, "
                "peerDependencies map<string,string>, optionalDependencies map<string,string>")


def _entries(section: str, col: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.transform(F.map_entries(F.coalesce(col, empty)), lambda e: F.struct(
        F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("spec")))


def package_json_entries(files: DataFrame, sections: tuple[str, ...] = (
        "dependencies", "devDependencies", "peerDependencies")) -> DataFrame:
    """(section, name, spec) of every package.json declaration."""
    parsed = named(files, "package.json").withColumn("_j", F.from_json("text", PACKAGE_JSON))
    rows = F.flatten(F.array(*[_entries(s, F.col(f"_j.{s}")) for s in sections]))
    return parsed.select(*AUDIT, "path", F.explode(rows).alias("_e")).select(*AUDIT, "path", "_e.*")


def npm_registry_names(entries: DataFrame) -> DataFrame:
    """Registry names behind declarations: aliases resolved, local, git and URL specs dropped."""
    spec = F.trim(F.coalesce("spec", F.lit("")))
    alias = F.regexp_extract(spec, NPM_ALIAS, 1)
    return entries.withColumn("registry_name", F.lower(F.when(alias != "", alias).when(
        ~spec.rlike(NON_REGISTRY), F.col("name")))).filter(F.col("registry_name").isNotNull())


LOCK_JSON = ("packages map<string,struct<version:string,name:string,link:boolean,dependencies:map<string,string>,"
             "devDependencies:map<string,string>,optionalDependencies:map<string,string>>>")
PIPFILE_JSON = "default map<string,struct<version:string>>, develop map<string,struct<version:string>>"


def package_lock_versions(files: DataFrame) -> DataFrame:
    parsed = named(files, "package-lock.json").select(
        *AUDIT, "path", F.explode(F.from_json("text", LOCK_JSON)["packages"]).alias("at", "meta"))
    return parsed.filter(
        F.col("at").contains("node_modules/") & (F.coalesce("meta.version", F.lit("")) != "")
        & ~F.coalesce("meta.link", F.lit(False))).select(
        *AUDIT, "path", F.coalesce("meta.name", F.regexp_extract("at", r"^.*node_modules/(.*)$", 1)).alias("name"),
        F.col("meta.version").alias("version"))


def yarn_lock_entries(files: DataFrame) -> DataFrame:
    """(name, version, specs) per block: an unindented header followed by indented lines."""
    text = F.regexp_replace("text", r"(?m)^#.*$", "")
    blocks = named(files, "yarn.lock").select(*AUDIT, "path", F.explode(F.split(text, r"\n(?=\S)")).alias("block"))
    header = F.regexp_replace(F.regexp_replace(F.trim(F.substring_index("block", "\n", 1)), r":+\s*$", ""), '"', "")
    specs = F.filter(F.transform(F.split(header, ","), lambda s: F.trim(s)), lambda s: s != "")
    rows = blocks.withColumn("specs", specs).withColumn("_names", F.array_distinct(F.transform(
        F.filter("specs", lambda s: F.substr(s, F.lit(2)).contains("@")),
        lambda s: F.regexp_extract(s, r"^(.*)@[^@]*$", 1))))
    versions = F.regexp_extract_all("block", F.lit(r"\n[ \t]+version:?\s+\"?([^\"\s]+)"), F.lit(1))
    return rows.withColumns({"name": F.get("_names", F.lit(0)), "_v": versions}).filter(
        (F.size("_names") == 1) & (F.col("name") != "") & ~F.col("name").contains(":") & (F.size("_v") > 0)).select(
        *AUDIT, "path", "name", F.element_at("_v", -1).alias("version"), "specs")


def toml_lock_packages(files: DataFrame) -> DataFrame:
    """``[[package]]`` blocks of poetry.lock and uv.lock; keys count only before the block's first sub-table."""
    blocks = named(files, "poetry.lock", "uv.lock").select(
        *AUDIT, "path", F.explode(F.slice(F.split("text", r"(?m)^\[\[package\]\]\s*$"), F.lit(2), F.lit(2147483647)))
        .alias("block")).withColumn("block", F.regexp_replace("block", r"(?s)\n\s*\[.*$", ""))

    def value(key: str) -> Column:
        return F.regexp_extract("block", rf"(?m)^{key}\s*=\s*[\"']([^\"']*)[\"']", 1)

    return blocks.select(*AUDIT, "path", value("name").alias("name"), value("version").alias("version")).filter(
        (F.col("name") != "") & (F.col("version") != ""))


def pnpm_versions(files: DataFrame) -> DataFrame:
    """Package keys of pnpm-lock.yaml: ``name@version`` or the older ``/name/version_peer``."""
    keys = F.regexp_extract_all(yaml_section(F.col("text"), "packages"), F.lit(r"(?m)^  ([^\s][^\n]*?):(?:[ \t].*)?$"), F.lit(1))
    rows = named(files, "pnpm-lock.yaml").select(*AUDIT, "path", F.explode(keys).alias("key"))
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("key", r"^['\"]+|['\"]+$", ""), r"^/+", ""), r"\(.*$", "")
    rows = rows.withColumn("key", key)
    modern = F.substr("key", F.lit(2)).contains("@")
    name = F.when(modern, F.regexp_extract("key", r"^(.*)@[^@]*$", 1)).otherwise(
        F.regexp_extract("key", r"^(.*)/[^/]*$", 1))
    version = F.when(modern, F.regexp_extract("key", r"@([^@]*)$", 1)).otherwise(
        F.substring_index(F.regexp_extract("key", r"([^/]*)$", 1), "_", 1))
    rows = rows.withColumns({"name": name, "version": version})
    return rows.filter((F.col("name") != "") & version_tuple(F.substring_index("version", "-", 1)).isNotNull()).select(
        *AUDIT, "path", "name", "version")


def pnpm_specifiers(files: DataFrame) -> DataFrame:
    """Declared specifiers of the root project as pnpm-lock.yaml records them (all lockfile versions)."""
    text = F.col("text")
    root = F.when(text.rlike(r"(?m)^importers:"), yaml_section(yaml_section(text, "importers"), r"['\"]?\.['\"]?", "  ")) \
        .otherwise(text)
    flat = F.regexp_extract_all(root, F.lit(r"(?m)^\s+(\S[^\n]*?):[ \t]*\n\s+specifier:[ \t]*[^\n]*"), F.lit(0))
    old = F.regexp_extract_all(yaml_section(root, "specifiers"), F.lit(r"(?m)^\s+\S[^\n]*?:[ \t]+[^\n]+"), F.lit(0))
    rows = named(files, "pnpm-lock.yaml").select(*AUDIT, "path", F.explode(F.concat(flat, old)).alias("entry"))

    def clean(col: Column) -> Column:
        return F.regexp_replace(F.trim(col), r"^['\"]+|['\"]+$", "")

    spec = F.regexp_extract("entry", r":[ \t]*(?:\n\s+specifier:[ \t]*)?([^\n]*)$", 1)
    return rows.select(*AUDIT, "path", clean(F.regexp_extract("entry", r"^\s*(\S[^\n]*?):(?:[ \t\n]|$)", 1)).alias("name"),
                       clean(spec).alias("spec"))


def pipfile_versions(files: DataFrame) -> DataFrame:
    parsed = named(files, "Pipfile.lock").withColumn("_j", F.from_json("text", PIPFILE_JSON))
    both = F.flatten(F.array(*[F.map_entries(F.coalesce(F.col(f"_j.{s}"), F.create_map().cast(
        "map<string,struct<version:string>>"))) for s in ("default", "develop")]))
    return parsed.select(*AUDIT, "path", F.explode(both).alias("e")).filter(
        F.col("e.value.version").startswith("==")).select(
        *AUDIT, "path", F.col("e.key").alias("name"), F.regexp_replace("e.value.version", "^=+", "").alias("version"))


def js_lock_versions(files: DataFrame) -> DataFrame:
    """Resolved npm versions of every JavaScript lockfile."""
    return package_lock_versions(files).unionByName(
        yarn_lock_entries(files).drop("specs")).unionByName(pnpm_versions(files)).distinct()


def collect_pins(files: DataFrame) -> DataFrame:
    """Exact pins, one per (ecosystem, name ignoring case, version); the first manifest in path order is named."""
    req = requirement_lines(files).select(
        *AUDIT, "path", F.col("line_no").alias("_at"), F.regexp_extract("raw", REQUIREMENT_PIN, 1).alias("name"),
        F.regexp_extract("raw", REQUIREMENT_PIN, 2).alias("version"), F.lit("PyPI").alias("ecosystem"))
    py = toml_lock_packages(files).unionByName(pipfile_versions(files)).withColumns({
        "_at": F.lit(0), "ecosystem": F.lit("PyPI")})
    js = js_lock_versions(files).withColumns({"_at": F.lit(0), "ecosystem": F.lit("npm")})
    rows = req.unionByName(py).unionByName(js).filter(
        (F.col("name") != "") & F.col("version").rlike(PIN_VERSION))
    return rows.groupBy(*AUDIT, "ecosystem", F.lower("name").alias("_key"), "version").agg(
        F.min(F.struct("path", "_at", "name")).alias("_f")).select(
        *AUDIT, "ecosystem", F.col("_f.name").alias("name"), "version", F.col("_f.path").alias("source"))


PYPROJECT_SCHEMA = ("org_id string, repo_id string, audit_id string, path string, dep_group string, name string, "
                    "spec string, valid boolean")


def _pyproject_rows(text: str) -> list[tuple[str, str, str]]:
    """(group, requirement or name, version or None) of one manifest."""
    import tomllib

    data = tomllib.loads(text or "")
    project, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
    listed = {"dependencies": project.get("dependencies")}
    listed |= {f"optional:{k}": v for k, v in (project.get("optional-dependencies") or {}).items()}
    listed |= {f"group:{k}": v for k, v in (data.get("dependency-groups") or {}).items()}
    rows = [(g, s, None) for g, specs in listed.items() if isinstance(specs, list) for s in specs if isinstance(s, str)]
    tables = {"poetry": poetry.get("dependencies"), "poetry:dev": poetry.get("dev-dependencies")}
    tables |= {f"poetry:{k}": (v or {}).get("dependencies") for k, v in (poetry.get("group") or {}).items()}
    for group, table in tables.items():
        for name, spec in (table.items() if isinstance(table, dict) else ()):
            if name.lower() != "python":
                version = spec.get("version", "") if isinstance(spec, dict) else spec
                rows.append((group, name, version if isinstance(version, str) else ""))
    return rows


def pyproject_entries(files: DataFrame) -> DataFrame:
    """(dep_group, name, spec) of every pyproject.toml; one row with ``valid`` false for a broken file.

    TOML has no JVM reader in Spark, so each batch of manifest rows is parsed with the standard library and the
    requirement syntax is left to Spark.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                head = (row.org_id, row.repo_id, row.audit_id, row.path)
                try:
                    out += [(*head, g, n, s, True) for g, n, s in _pyproject_rows(row.text)]
                except ValueError:
                    out.append((*head, None, None, None, False))
            yield pd.DataFrame(out, columns=[*AUDIT, "path", "dep_group", "name", "spec", "valid"])

    rows = named(files, "pyproject.toml").select(*AUDIT, "path", "text").mapInPandas(parse, PYPROJECT_SCHEMA)
    listed = F.col("spec").isNull() & F.col("valid")
    return rows.filter(~listed | F.col("name").rlike(PEP508)).withColumns({
        "name": F.when(listed, F.regexp_extract("name", PEP508, 1)).otherwise(F.col("name")),
        "spec": F.trim(F.when(listed, F.regexp_extract("name", PEP508, 2)).otherwise(F.col("spec")))})


def python_declared(files: DataFrame) -> DataFrame:
    """Normalised names a repository declares for Python."""
    req = requirement_lines(files).filter(~F.col("line").rlike("^[#-]")).select(
        *AUDIT, "path", F.regexp_extract("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1).alias("name"))
    toml = pyproject_entries(files).filter(
        F.col("valid") & (F.col("dep_group").isin("dependencies", "poetry") | F.col("dep_group").startswith("optional:"))
    ).select(*AUDIT, "path", "name")
    return req.unionByName(toml).filter(F.col("name") != "").select(
        *AUDIT, "path", F.lower("name").alias("name"), python_package("name").alias("dist"))
