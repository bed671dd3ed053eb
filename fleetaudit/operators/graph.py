"""Import graphs: edges, cycles, layers and boundaries. Everything is keyed by audit, so one job covers a fleet.

Both sides of every join here grow with the fleet, so all are merge joins: edges and paths compress so well that Spark would
take their tables for small ones and send them through the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.core import lookup
from ..functions.text import basename, dirname, is_test_path, path_tokens, shared_prefix_length, stem
from ..rules.engine import Pack, Rule, emit, emit_each, line_of, register, union
from ..session import cut_lineage
from . import AUDIT
from .findings import top_k

WHOLE = 200_000  # edges of a graph that one task may hold

# Patterns, layer names and limits.
JS_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
JS_FILE = r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$"
JS_RELATIVE = (r"""(?:import\s[^'"]*?from\s*|import\s*\(\s*|require\s*\(\s*|export\s[^'"]*?from\s*)"""
               r"""["'](\.{1,2}/[^"']+)["']""")
PY_FROM = r"^\s*from\s+(\.*)([\w.]*)\s+import\s+\(?\s*([^#(]*)"
PY_PLAIN = r"^\s*import\s+([^#]+)"
SERVICE_NAMES = ["service", "services", "domain", "usecase", "usecases", "interactor", "interactors", "business", "logic"]
DATA_NAMES = ["repository", "repositories", "repo", "repos", "dal", "dao", "daos", "persistence", "persist", "db",
              "database", "models", "model", "entities", "entity"]
MODEL_NAMES = ["models", "model", "entities", "entity"]
AMBIGUOUS_DATA_NAMES = ["repository", "repositories", "repo", "repos"]
REPOSITORY_PATTERN = r"\b(?:class|const|let|var)\s+\w*(?:Repository|Repo|Dao|DAO)\b"
SHARED_NAMES = ["common", "shared", "utils", "util", "lib", "libs", "core", "helpers", "support", "base",
                "components", "types", "config", "settings"]
EXEMPT_DIRS = ["migrations", "alembic", "scripts", "bin", "seeds", "seed", "management", "fixtures"]
CONFIG_NAMES = ["config", "configuration", "settings", "env", "conf", "environment"]
UNIT_MANIFESTS = ["package.json", "requirements.txt", "pyproject.toml", "setup.py", "go.mod", "Dockerfile"]
LAYER_RANK = {"data": 0, "service": 1, "controller": 2}
PY_ROUTE = (r"(?m)^\s*@\w+(?:\.(?!(?:route|get|post|put|patch|delete|api_route|websocket)\()\w+)*+"
            r"\.(?:route|get|post|put|patch|delete|api_route|websocket)\(")
DJANGO_VIEW = (r"(?m)^\s*(?:async\s+)?def\s+\w+\(\s*request\b|^class\s+\w+\([^)]*(?:View|ViewSet|APIView)\b")
JS_ROUTE = r"\b(?:app|router|server|api|\w+Router)\.(?:get|post|put|patch|delete|all)\(\s*[\"'`]/"
NEST_CONTROLLER = r"@Controller\("
NEXT_HANDLER = (r"(?m)^export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE)\b|"
                r"^export\s+default\s+(?:async\s+)?function\s+handler\b")
SQL_IN_HANDLER = r"(?is)\b(?:execute|raw|query)\s*\(\s*[fFrRbB]?[\"'`](?:\s*select|\s*insert|\s*update|\s*delete)"
PY_DATA_ACCESS = (
    r"\bdb\.session\.\w+|\bsession\.(?:query|execute|add|add_all|delete|commit|scalars?|get)\(|"
    r"\b[A-Z]\w*\.query\.(?:filter|filter_by|get|get_or_404|all|first|order_by|join)\b|"
    r"\.objects\.(?:filter|get|all|create|exclude|update|delete|raw|aggregate|annotate|get_or_create|"
    r"update_or_create|select_related|prefetch_related|values|bulk_create)\(|"
    r"\bcursor\.execute|\b(?:conn|connection|engine)\.execute\(|"
    r"\b\w+\.(?:find_one|insert_one|insert_many|update_one|update_many|delete_one|delete_many)\(")
JS_DATA_ACCESS = (
    r"\bprisma\.\w+\.(?:find\w*|create\w*|update\w*|delete\w*|upsert|count|aggregate|groupBy)\(|"
    r"\bprisma\.\$(?:queryRaw|executeRaw)|\b(?:pool|db|client|connection|knex|sql|pg)\.(?:query|execute)\(|"
    r"\bknex\(\s*[\"'`]\w+|\bgetRepository\(|\.createQueryBuilder\(|\bsupabase\.from\(|"
    r"\b(?!(?:Object|Array|Promise|Reflect|Math|JSON|Date|Map|Set|WeakMap|Symbol|Number|String|Boolean|Buffer|URL|"
    r"Error|React|Intl)\b)[A-Z]\w*\.(?:find|findOne|findById|findAll|findByPk|findOneAndUpdate|findByIdAndUpdate|"
    r"updateOne|updateMany|deleteOne|deleteMany|countDocuments|bulkCreate)\(")
PY_MODEL = (r"(?m)^class\s+\w+\(\s*(?:db\.Model|models\.Model|Base\s*[,)]|DeclarativeBase|"
            r"SQLModel\b[^)]*table\s*=\s*True|(?:me\.|mongoengine\.)?Document\s*[,)])")
JS_MODEL = r"\bmongoose\.model\(|\bnew\s+(?:mongoose\.)?Schema\(|\bsequelize\.define\(|@Entity\("
ENV_READ = r"os\.environ|os\.getenv|process\.env|import\.meta\.env"
JS_EXPORT = (r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\b")
FAN_OUT, CONFIG_SPRAWL, CONFIG_BYPASS, EXPORTS, PACKAGE_FILES, ROOT_FILES = 25, 12, 5, 40, 40, 15
NO_SERVICE_HANDLERS, SCATTERED_FILES, SCATTERED_DIRS, SHOWN = 4, 6, 3, 12
# End of fixed values

NAME = "architecture"


def _r(seq: int, name: str, title: str, severity: str, confidence: str = "high", kind: str = "confirmed") -> Rule:
    return Rule(f"architecture.{name}", title, "architecture", severity, confidence, kind, seq=seq)


CYCLE = _r(1, "import-cycle", "Circular dependency", "low")
PACKAGE_CYCLE = _r(2, "package-cycle", "Packages depend on each other", "low")
HIGH_FAN_OUT = _r(3, "high-fan-out", "Module depends on many internal modules", "low")
DIRECTION = _r(4, "dependency-direction", "Module imports a higher layer", "low", "medium")
CROSS_SERVICE = _r(5, "cross-service-import", "Cross-service import", "medium", "medium")
BOUNDARY = _r(6, "boundary-violation", "Feature reaches into another", "low", "medium")
SQL_HANDLER = _r(7, "sql-in-handlers", "Raw SQL inside request handler module", "low", "medium", "potential")
DATA_HANDLER = _r(8, "data-access-in-handlers", "Request handler module queries the database directly", "low",
                  "medium", "potential")
MIXED = _r(9, "mixed-concerns", "Route handlers and database models in the same module", "low")
NO_SERVICE = _r(10, "no-service-layer", "No service layer", "medium", "medium", "potential")
SCATTERED = _r(11, "scattered-data-access", "Data access is scattered", "low", "medium", "potential")
OVERSIZED = _r(12, "oversized-module", "Module exports many definitions", "low")
FLAT = _r(13, "flat-structure", "Source files at the repository root", "low")
BIG_PACKAGE = _r(14, "oversized-package", "Directory holds many source files", "low")
SPRAWL = _r(15, "config-sprawl", "Configuration read across the codebase", "low")
BYPASS = _r(16, "config-bypass", "Configuration read around the settings module", "low")


# --- edges -----------------------------------------------------------------------------------------
def _ancestors(path: Column) -> Column:
    """Every enclosing directory of a path, shortest first, without the root."""
    parts = F.split(dirname(path), "/")
    return F.when(dirname(path) == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def python_modules(files: DataFrame) -> DataFrame:
    """(audit, module, dest): dotted names under which a file can be imported.

    A file's name starts at its top-most enclosing package; the full path form counts too.
    """
    py = files.filter(F.col("path").endswith(".py") & ~is_test_path("path")).select(*AUDIT, "path")
    packages = py.filter(basename("path") == "__init__.py").select(*AUDIT, dirname("path").alias("dir")).distinct()
    dirs = py.select(*AUDIT, "path", F.posexplode(_ancestors(F.col("path"))).alias("_i", "dir"))
    gaps = dirs.join(packages.hint("merge"), [*AUDIT, "dir"], "left_anti").groupBy(*AUDIT, "path").agg(
        F.max("_i").alias("_gap"))
    parts = F.split(F.regexp_replace("path", r"\.py$", ""), "/")
    rows = py.join(gaps.hint("merge"), [*AUDIT, "path"], "left").withColumn("_p", parts)
    start = F.coalesce(F.col("_gap") + 1, F.lit(0))

    def dotted(p: Column) -> Column:
        return F.array_join(F.when(F.element_at(p, -1) == "__init__", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p), ".")

    names = F.array_distinct(F.array(dotted(F.slice("_p", start + 1, F.size("_p"))), dotted(F.col("_p"))))
    return rows.select(*AUDIT, F.explode(names).alias("module"), F.col("path").alias("dest")).filter("module <> ''")


def nearest(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """Resolve (audit, path, module, …) to a file: of several candidates the one sharing most leading folders."""
    keys = refs.columns
    joined = refs.join(modules.hint("merge"), [*AUDIT, "module"])
    near = shared_prefix_length(F.concat("path", F.lit("/x")), F.concat("dest", F.lit("/x")))
    return joined.groupBy(*keys).agg(F.min_by("dest", F.struct(-near, F.col("dest"))).alias("dest"))


def python_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from import statements at line starts; imports inside strings are seen as well."""
    modules = python_modules(files)
    py = lines.filter(F.col("path").endswith(".py") & ~is_test_path("path"))
    plain = py.filter(F.col("text").rlike(PY_PLAIN)).select(*AUDIT, "path", F.explode(F.split(
        F.regexp_extract("text", PY_PLAIN, 1), ",")).alias("module")).select(
        *AUDIT, "path", F.regexp_extract("module", r"^\s*([\w.]+)", 1).alias("module")).distinct()
    dots, target = F.regexp_extract("text", PY_FROM, 1), F.regexp_extract("text", PY_FROM, 2)
    folder = F.split(F.regexp_replace("path", r"\.py$", ""), "/")
    keep = F.size(folder) - 1 - (F.length(dots) - 1)
    base = F.when(dots == "", target).otherwise(F.array_join(F.array_compact(F.array(
        F.nullif(F.array_join(F.slice(folder, F.lit(1), F.greatest(keep, F.lit(0))), "."), F.lit("")),
        F.nullif(target, F.lit("")))), "."))
    froms = py.filter(F.col("text").rlike(PY_FROM)).select(
        *AUDIT, "path", base.alias("base"), F.explode(F.split(F.regexp_extract("text", PY_FROM, 3), ",")).alias("_n"))
    froms = froms.select(*AUDIT, "path", "base", F.regexp_extract("_n", r"^\s*(\w+|\*)", 1).alias("name")).filter(
        (F.col("base") != "") | (F.col("name") != "")).distinct()
    subs = froms.filter(F.col("name").rlike(r"^\w+$")).withColumn("module", F.concat_ws(".", F.nullif(
        F.col("base"), F.lit("")), "name"))
    found = nearest(subs, modules)
    rest = froms.join(found.select(*AUDIT, "path", "base", "name").hint("merge"), [*AUDIT, "path", "base", "name"], "left_anti")
    bases = nearest(rest.select(*AUDIT, "path", F.col("base").alias("module")).distinct(), modules)
    cols = [*AUDIT, "path", "dest"]
    return nearest(plain, modules).select(*cols).unionByName(found.select(*cols)).unionByName(bases.select(*cols))


def _resolve_path(folder: Column, spec: Column) -> Column:
    """Join and normalise a relative path."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(spec, "/")), lambda p: ~p.isin("", "."))
    return F.array_join(F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))), "/")


def js_edges(files: DataFrame) -> DataFrame:
    """Edges from relative imports; extensions and index files are tried in order."""
    js = files.filter(F.col("path").rlike(JS_FILE) & ~is_test_path("path"))
    refs = js.select(*AUDIT, "path", F.explode(F.array_distinct(F.regexp_extract_all(
        "text", F.lit(JS_RELATIVE), F.lit(1)))).alias("spec"))
    target = _resolve_path(dirname("path"), F.col("spec"))
    tries = F.concat(F.array(target), F.array(*[F.concat(target, F.lit(e)) for e in JS_EXTS]),
                     F.array(*[F.concat(target, F.lit(f"/index{e}")) for e in JS_EXTS]))
    rows = refs.select(*AUDIT, "path", "spec", F.posexplode(tries).alias("_i", "dest")).filter("dest <> path")
    have = js.select(*AUDIT, F.col("path").alias("dest")).distinct()
    return rows.join(have.hint("merge"), [*AUDIT, "dest"]).groupBy(*AUDIT, "path", "spec").agg(
        F.min_by("dest", "_i").alias("dest")).select(*AUDIT, "path", "dest")


def import_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (audit, src, dst) edges between files of one audit."""
    both = python_edges(lines, files).unionByName(js_edges(files)).filter("dest <> path")
    return both.select(*AUDIT, F.col("path").alias("src"), F.col("dest").alias("dst")).distinct()


# --- strongly connected components -----------------------------------------------------------------
def _strong(src: list[str], dst: list[str]) -> tuple[list[str], list[str], list[int]]:
    """Node, component and size of every component of one graph with more than one node (Tarjan, without recursion)."""
    out: dict[str, list[str]] = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    open_: set[str] = set()
    nodes, names, sizes = [], [], []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        held.append(start)
        open_.add(start)
        way = [(start, iter(out[start]))]
        while way:
            at, rest = way[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    held.append(to)
                    open_.add(to)
                    way.append((to, iter(out.get(to, ()))))
                    break
                if to in open_:
                    low[at] = min(low[at], index[to])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[at])
                if low[at] == index[at]:
                    found = [held.pop()]
                    while found[-1] != at:
                        found.append(held.pop())
                    open_.difference_update(found)
                    if len(found) > 1:
                        nodes += found
                        names += [min(found, key=str.encode)] * len(found)
                        sizes += [len(found)] * len(found)
    return nodes, names, sizes


def _solve(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Solver of frames that lie by ``keys``: graph after graph, the one a frame ends in waits for the next frame."""
    def solved(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        src, dst = frame["src"].tolist(), frame["dst"].tolist()
        at: list[int] = []
        nodes, names, sizes = [], [], []
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            n, c, s = _strong(src[a:b], dst[a:b])
            at += [a] * len(n)
            nodes += n
            names += c
            sizes += s
        columns = {k: frame[k].to_numpy(dtype=object)[at] for k in keys} | {"node": np.array(nodes, dtype=object), "component": np.array(names, dtype=object)}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()} | {"size": np.array(sizes, dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            moved = np.zeros(len(batch), dtype=bool)
            for k in keys:
                values = batch[k].to_numpy(dtype=object)
                moved[1:] |= values[1:] != values[:-1]
            moved[0] = bool(waiting) and any(waiting[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys)
            starts = np.flatnonzero(moved)
            if not len(starts):
                waiting.append(batch)
                continue
            waiting.append(batch.iloc[:starts[0]])
            frame = pd.concat(waiting, ignore_index=True)
            if len(frame):
                yield solved(frame, np.array([0]))
            if len(starts) > 1:
                yield solved(batch.iloc[starts[0]:starts[-1]].reset_index(drop=True), starts[:-1] - starts[0])
            waiting = [batch.iloc[starts[-1]:]]
        if waiting:
            yield solved(pd.concat(waiting, ignore_index=True), np.array([0]))

    return run


def strongly_connected(edges: DataFrame, keys: list[str] = AUDIT, hops: int = 4) -> DataFrame:
    """(keys, node, component, size) of every component with more than one node; a component is named by its least node.

    Graphs of at most ``WHOLE`` edges lie by key and are solved by tasks in one pass, one graph in memory at a time. Larger
    ones, and only those, are coloured by joins over their edges, so no task holds one.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    left = cut_lineage(edges.select(*keys, "src", "dst").filter(known & (F.col("src") != F.col("dst"))).distinct())
    large = cut_lineage(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select(*keys))
    every = large.isEmpty()
    small = left if every else left.join(large.hint("merge"), keys, "left_anti")
    schema = edges.select(*keys, F.col("src").alias("node"), F.col("src").alias("component")).withColumn("size", F.lit(0).cast("long")).schema
    solved = cut_lineage(small.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_solve(keys), StructType(
        [StructField(f.name, f.dataType) for f in schema.fields])))
    return solved if every else solved.unionByName(_coloured(left.join(large.hint("merge"), keys, "left_semi"), keys, hops))


def _coloured(edges: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """Components of more than one node by forward–backward colouring over all graphs at once: each node takes the least label
    that reaches it, then the nodes of a colour that reach its root form one component and leave the graph. Every round is a
    join and a mergeable aggregate on edges, so neither a large component nor a hot repository is ever gathered, and state is
    written to the checkpoint folder after ``hops`` rounds.
    """
    left = cut_lineage(edges)
    found: list[DataFrame] = []
    while True:
        left = _trim(left, keys)
        if left.isEmpty():
            break
        nodes = left.select(*keys, F.col("src").alias("node")).unionByName(
            left.select(*keys, F.col("dst").alias("node"))).distinct()
        colours = _spread(nodes.withColumn("label", F.col("node")), left, keys, hops)
        inside = cut_lineage(
            left.join(colours.select(*keys, F.col("node").alias("src"), F.col("label").alias("_a")).hint("merge"), [*keys, "src"])
            .join(colours.select(*keys, F.col("node").alias("dst"), F.col("label").alias("_b")).hint("merge"), [*keys, "dst"])
            .filter("_a = _b").select(*keys, "src", "dst"))
        roots = colours.withColumn("label", F.when(F.col("node") == F.col("label"), F.col("label")))
        back = inside.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = _spread(roots, back, keys, hops).filter(F.col("label").isNotNull())
        found.append(reached.withColumnRenamed("label", "component"))
        gone = reached.select(*keys, "node")
        left = cut_lineage(
            inside.join(gone.withColumnRenamed("node", "src").hint("merge"), [*keys, "src"], "left_anti")
            .join(gone.withColumnRenamed("node", "dst").hint("merge"), [*keys, "dst"], "left_anti"))
    if not found:
        return edges.select(*keys, F.col("src").alias("node"), F.col("src").alias("component"),
                            F.lit(0).cast("long").alias("size")).limit(0)
    members = union(found)
    big = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(big.hint("merge"), [*keys, "component"])


def _trim(edges: DataFrame, keys: list[str], rounds: int = 2) -> DataFrame:
    """Drop edges that start at a node nothing enters or end at a node nothing leaves: they lie on no cycle."""
    for _ in range(rounds):
        entered = edges.select(*keys, F.col("dst").alias("src")).distinct()
        left = edges.select(*keys, F.col("src").alias("dst")).distinct()
        edges = edges.join(entered.hint("merge"), [*keys, "src"], "left_semi").join(left.hint("merge"), [*keys, "dst"], "left_semi")
    return cut_lineage(edges)


def _spread(state: DataFrame, edges: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """Push the least label along the edges until nothing changes; null labels are not yet reached. A graph that the last hop
    left as it was is done: only the others go on, with their edges."""
    state, done = cut_lineage(state), []
    unknown = F.lit(None).cast(state.schema["label"].dataType)
    while True:
        nxt = state
        for _ in range(hops):
            pushed = nxt.filter(F.col("label").isNotNull()).select(*keys, F.col("node").alias("src"), "label").join(
                edges.hint("merge"), [*keys, "src"]).select(*keys, F.col("dst").alias("node"), "label", unknown.alias("_was"))
            nxt = nxt.select(*keys, "node", "label", F.col("label").alias("_was")).unionByName(pushed).groupBy(
                *keys, "node").agg(F.min("label").alias("label"), F.max("_was").alias("_was"))
        nxt = cut_lineage(nxt)
        moved = cut_lineage(nxt.filter(~F.col("label").eqNullSafe(F.col("_was"))).select(*keys).distinct())
        nxt = nxt.drop("_was")
        if moved.isEmpty():
            return union([*done, nxt])
        done.append(cut_lineage(nxt.join(moved.hint("merge"), keys, "left_anti")))
        state = cut_lineage(nxt.join(moved.hint("merge"), keys, "left_semi"))
        edges = cut_lineage(edges.join(moved.hint("merge"), keys, "left_semi"))


def _shown(members: DataFrame, keys: list[str], n: int = SHOWN) -> DataFrame:
    """Component size and its first members, never the whole component."""
    first = top_k(members, [*keys, "component"], [F.col("node")], n).groupBy(*keys, "component", "size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("nodes"))
    return first


def import_cycles(components: DataFrame) -> DataFrame:
    rows = _shown(components, AUDIT)
    return emit(rows, NAME, CYCLE, path=F.get("nodes", F.lit(0)),
                title=F.concat(F.lit("Circular dependency between "), F.col("size").cast("string"), F.lit(" modules")),
                severity=F.when(F.col("size") > 2, "medium").otherwise("low"),
                evidence=F.concat(F.lit("cycle: "), F.array_join("nodes", ", ")))


def package_edges(edges: DataFrame) -> DataFrame:
    """Edges between folders, without a folder and its own sub-folders."""
    a, b = dirname("src"), dirname("dst")
    inside = (a == b) | (a == "") | (b == "") | b.startswith(F.concat(a, F.lit("/"))) | a.startswith(F.concat(b, F.lit("/")))
    return edges.filter(~inside).select(*AUDIT, a.alias("src"), b.alias("dst")).distinct()


def package_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(audit, node, component, size) of folder cycles no single module cycle explains."""
    folders = strongly_connected(package_edges(edges))
    modules = components.select(*AUDIT, F.col("component").alias("_m"), dirname("node").alias("node")).distinct()
    sizes = modules.groupBy(*AUDIT, "_m").agg(F.count(F.lit(1)).alias("_n"))
    shared = folders.join(modules.hint("merge"), [*AUDIT, "node"]).groupBy(*AUDIT, "component", "size", "_m").agg(
        F.count(F.lit(1)).alias("_both")).join(sizes.hint("merge"), [*AUDIT, "_m"])
    explained = shared.filter((F.col("_both") == F.col("size")) & (F.col("_n") == F.col("size"))).select(
        *AUDIT, "component").distinct()
    return folders.join(explained.hint("merge"), [*AUDIT, "component"], "left_anti")


def package_cycle_findings(edges: DataFrame, components: DataFrame) -> DataFrame:
    rows = _shown(package_cycles(edges, components), AUDIT, 4)
    return emit(rows, NAME, PACKAGE_CYCLE, path=F.get("nodes", F.lit(0)),
                title=F.concat(F.lit("Packages depend on each other: "), F.array_join("nodes", ", ")))


def fan_out(edges: DataFrame) -> DataFrame:
    rows = edges.groupBy(*AUDIT, "src").agg(F.countDistinct("dst").alias("n")).filter(F.col("n") > FAN_OUT)
    return emit(rows, NAME, HIGH_FAN_OUT, path=F.col("src"), title=F.concat(
        F.lit("Module depends on "), F.col("n").cast("string"), F.lit(" internal modules")))


# --- layers ----------------------------------------------------------------------------------------
def is_controller() -> Column:
    text, path = F.col("text"), F.col("path")
    views = (stem("path") == "views") | F.array_contains(F.split(dirname("path"), "/"), "views")
    python = text.rlike(PY_ROUTE) | (views & text.rlike(DJANGO_VIEW))
    routed = (stem("path") == "route") | F.concat(F.lit("/"), path).contains("/pages/api/")
    script = text.rlike(JS_ROUTE) | text.rlike(NEST_CONTROLLER) | (routed & text.rlike(NEXT_HANDLER))
    return F.when(path.endswith(".py"), python).otherwise(script)


def layers(files: DataFrame) -> DataFrame:
    """(audit, path, layer): controller by its routes, otherwise service or data by the nearest telling name."""
    folders = F.reverse(F.transform(F.split(dirname("path"), "/"), F.lower))
    names = F.concat(path_tokens(stem("path")), folders)
    data = [n for n in DATA_NAMES if n not in AMBIGUOUS_DATA_NAMES]
    pattern = F.col("text").rlike(REPOSITORY_PATTERN)
    kinds = F.filter(F.transform(names, lambda n: F.when(n.isin(*SERVICE_NAMES), "service").when(n.isin(*data), "data")
                                 .when(n.isin(*AMBIGUOUS_DATA_NAMES) & pattern, "data")), lambda k: k.isNotNull())
    source = files.filter(F.col("path").rlike(r"(?i)\.(?:py|ts|tsx|js|jsx|mjs|cjs)$") & ~is_test_path("path"))
    return source.select(*AUDIT, "path", F.when(is_controller(), "controller").otherwise(
        F.coalesce(F.get(kinds, F.lit(0)), F.lit(""))).alias("layer"))


def upward_imports(edges: DataFrame, layer_table: DataFrame) -> DataFrame:
    """Edges from a data or service module to a higher layer."""
    a = layer_table.select(*AUDIT, F.col("path").alias("src"), F.col("layer").alias("src_layer"))
    b = layer_table.select(*AUDIT, F.col("path").alias("dst"), F.col("layer").alias("dst_layer"))
    rank = {k: v for k, v in LAYER_RANK.items()}
    rows = edges.join(a.filter(F.col("src_layer").isin("data", "service")).hint("merge"), [*AUDIT, "src"]).join(
        b.filter("dst_layer <> ''").hint("merge"), [*AUDIT, "dst"])
    return rows.filter(lookup(F.col("dst_layer"), rank, "int") > lookup(F.col("src_layer"), rank, "int"))


def dependency_direction(edges: DataFrame, layer_table: DataFrame) -> DataFrame:
    rows = upward_imports(edges, layer_table).groupBy(*AUDIT, "src", "src_layer").agg(
        F.max(F.col("dst_layer") == "controller").alias("_top"))
    return emit(rows, NAME, DIRECTION, path=F.col("src"),
                title=F.concat(F.initcap("src_layer"), F.lit("-layer module imports a higher layer")),
                severity=F.when(F.col("_top"), "medium").otherwise("low"))


def units_of(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(audit, path, unit): the longest enclosing folder that has a manifest of its own.

    A path has few ancestors, so the prefix match is an equi-join on the exploded ancestors.
    """
    units = files.filter(basename("path").isin(*UNIT_MANIFESTS) & (dirname("path") != "")).select(
        *AUDIT, dirname("path").alias("unit")).distinct()
    up = paths.select(*AUDIT, "path", F.explode(_ancestors(F.col("path"))).alias("unit"))
    return up.join(units.hint("merge"), [*AUDIT, "unit"]).groupBy(*AUDIT, "path").agg(F.max_by("unit", F.length("unit")).alias("unit"))


def cross_service_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """First import of each (module, foreign unit)."""
    ends = edges.select(*AUDIT, F.col("src").alias("path")).unionByName(
        edges.select(*AUDIT, F.col("dst").alias("path"))).distinct()
    unit = units_of(ends, files)
    rows = edges.join(unit.select(*AUDIT, F.col("path").alias("src"), F.col("unit").alias("ua")).hint("merge"), [*AUDIT, "src"]).join(
        unit.select(*AUDIT, F.col("path").alias("dst"), F.col("unit").alias("ub")).hint("merge"), [*AUDIT, "dst"])
    apart = (F.col("ua") != F.col("ub")) & ~F.col("ub").startswith(F.concat("ua", F.lit("/"))) & ~F.col("ua").startswith(
        F.concat("ub", F.lit("/")))
    return rows.filter(apart).groupBy(*AUDIT, "src", "ua", "ub").agg(F.min("dst").alias("dst"))


def boundary_violations(edges: DataFrame, layer_table: DataFrame, foreign: DataFrame) -> DataFrame:
    """A feature importing another feature's route handlers, or its repository although that has a service layer."""
    rows = edges.join(foreign.select(*AUDIT, "src", "dst").hint("merge"), [*AUDIT, "src", "dst"], "left_anti").join(
        layer_table.select(*AUDIT, F.col("path").alias("dst"), "layer").hint("merge"), [*AUDIT, "dst"])
    da, db = F.split(dirname("src"), "/"), F.split(dirname("dst"), "/")
    n = shared_prefix_length(F.concat(dirname("src"), F.lit("/x")), F.concat(dirname("dst"), F.lit("/x")))
    rows = rows.filter((dirname("src") != "") & (dirname("dst") != "")).withColumn("_n", n)
    rows = rows.filter((F.size(da) > F.col("_n")) & (F.size(db) > F.col("_n"))).withColumns({
        "fa": F.get(da, F.col("_n")), "fb": F.get(db, F.col("_n")),
        "feature": F.array_join(F.slice(db, F.lit(1), F.col("_n") + 1), "/")})
    rows = rows.filter(~F.lower("fa").isin(*SHARED_NAMES) & ~F.lower("fb").isin(*SHARED_NAMES))
    served = layer_table.filter("layer = 'service'").select(*AUDIT, F.explode(_ancestors(F.col("path"))).alias("feature")) \
        .distinct().withColumn("_served", F.lit(True))
    stores = [d for d in DATA_NAMES if d not in MODEL_NAMES]
    store = F.arrays_overlap(path_tokens(stem("dst")), F.array(*[F.lit(s) for s in stores]))
    rows = rows.join(served.hint("merge"), [*AUDIT, "feature"], "left").filter(
        (F.col("layer") == "controller") | ((F.col("layer") == "data") & store & F.coalesce("_served", F.lit(False))))
    return rows.groupBy(*AUDIT, "src", "feature").agg(F.min(F.struct("dst", "fa", "fb")).alias("at"))


def boundary_findings(edges: DataFrame, files: DataFrame, layer_table: DataFrame) -> DataFrame:
    foreign = cross_service_imports(edges, files)
    inner = boundary_violations(edges, layer_table, foreign)
    a = emit(foreign, NAME, CROSS_SERVICE, path=F.col("src"), evidence=F.concat("src", F.lit(" → "), "dst"),
             title=F.concat("ua", F.lit(" imports code from the "), "ub", F.lit(" service")))
    b = emit(inner, NAME, BOUNDARY, path=F.col("src"), evidence=F.concat("src", F.lit(" → "), F.col("at.dst")),
             title=F.concat(F.col("at.fa"), F.lit(" reaches into the internals of "), F.col("at.fb")))
    return a.unionByName(b)


# --- structure -------------------------------------------------------------------------------------
def structure(files: DataFrame, layer_table: DataFrame) -> DataFrame:
    """Handlers that query, mixed concerns, missing service layer, scattered access, sizes and configuration reads.

    One scan turns every file into a short fact row; all rules read those facts.
    """
    python = F.col("path").endswith(".py")
    rows = cut_lineage(files.join(layer_table.hint("merge"), [*AUDIT, "path"]).select(
        *AUDIT, "path", "layer", line_of("text", SQL_IN_HANDLER).alias("sql_at"),
        F.when(python, line_of("text", PY_DATA_ACCESS)).otherwise(line_of("text", JS_DATA_ACCESS)).alias("data_at"),
        F.when(python, line_of("text", PY_MODEL)).otherwise(line_of("text", JS_MODEL)).alias("model_at"),
        F.regexp_count("text", F.lit(JS_EXPORT)).alias("exports"), F.regexp_count("text", F.lit(ENV_READ)).alias("reads")))
    n, path = F.col("n").cast("string"), F.col("path")
    handler = F.col("layer") == "controller"
    per_audit = rows.groupBy(*AUDIT).agg(
        F.max(F.col("layer") == "service").alias("_service"),
        F.count(F.when((F.col("layer") == "controller") & (F.col("sql_at").isNotNull() | F.col("data_at").isNotNull()), 1))
        .alias("n"),
        F.min(F.when((F.col("layer") == "controller") & (F.col("sql_at").isNotNull() | F.col("data_at").isNotNull()),
                     F.col("path"))).alias("_first"))
    folders = F.split(F.lower(dirname("path")), "/")
    exempt = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in EXEMPT_DIRS]))
    settings = F.arrays_overlap(F.concat(path_tokens(stem("path")), folders), F.array(*[F.lit(c) for c in CONFIG_NAMES]))
    source = rows.filter(~exempt)
    outside = source.filter(~F.col("layer").isin("data", "service") & ~settings & (
        F.col("sql_at").isNotNull() | F.col("data_at").isNotNull()))
    scattered = outside.groupBy(*AUDIT).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(dirname("path")).alias("dirs"), F.min("path").alias("_first")).filter(
        (F.col("n") >= SCATTERED_FILES) & (F.col("dirs") >= SCATTERED_DIRS))
    dirs = source.groupBy(*AUDIT, dirname("path").alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("_first"))
    readers = source.filter("reads > 0").withColumn("top", F.when(
        F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(""))
    readers = readers.withColumn("central", settings & (F.col("reads") >= 3))
    env = readers.groupBy(*AUDIT).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("central"), 1)).alias("_out"),
        F.min(F.when(~F.col("central"), F.col("path"))).alias("_first"))
    sprawl = env.filter((F.col("n") >= CONFIG_SPRAWL) & (F.col("_out") >= CONFIG_SPRAWL // 2))
    around = readers.groupBy(*AUDIT, "top").agg(
        F.min(F.when(F.col("central"), F.col("path"))).alias("_settings"),
        F.count(F.when(~F.col("central"), 1)).alias("n"),
        F.min(F.when(~F.col("central"), F.col("path"))).alias("_first")).filter(
        F.col("_settings").isNotNull() & (F.col("n") >= CONFIG_BYPASS)).join(sprawl.select(*AUDIT).hint("merge"), AUDIT, "left_anti")
    return union([
        emit_each(rows, NAME, [
            (handler & F.col("sql_at").isNotNull(), SQL_HANDLER, {"path": path, "line": F.col("sql_at")}),
            (handler & F.col("sql_at").isNull() & F.col("data_at").isNotNull(), DATA_HANDLER,
             {"path": path, "line": F.col("data_at")}),
            (handler & F.col("model_at").isNotNull(), MIXED, {"path": path, "line": F.col("model_at")}),
            (~exempt & ~python & (F.col("exports") >= EXPORTS), OVERSIZED, {"path": path, "title": F.concat(
                F.lit("Module defines "), F.col("exports").cast("string"), F.lit(" exports"))})]),
        emit(per_audit.filter((F.col("n") >= NO_SERVICE_HANDLERS) & ~F.col("_service")), NAME, NO_SERVICE,
             path=F.col("_first"), title=F.concat(F.lit("No service layer: "), n, F.lit(" handler modules query the database"))),
        emit(scattered, NAME, SCATTERED, path=F.col("_first"), title=F.concat(
            F.lit("Database accessed directly from "), n, F.lit(" modules in "), F.col("dirs").cast("string"), F.lit(" packages"))),
        emit_each(dirs, NAME, [
            ((F.col("dir") == "") & (F.col("n") >= ROOT_FILES), FLAT, {
                "path": F.col("_first"), "title": F.concat(n, F.lit(" source files at the repository root"))}),
            ((F.col("dir") != "") & (F.col("n") >= PACKAGE_FILES), BIG_PACKAGE, {
                "path": F.col("_first"),
                "title": F.concat(F.lit("Package "), F.col("dir"), F.lit(" holds "), n, F.lit(" source files"))})]),
        emit(sprawl, NAME, SPRAWL, path=F.col("_first"),
             title=F.concat(F.lit("Environment variables read in "), n, F.lit(" files"))),
        emit(around, NAME, BYPASS, path=F.col("_first"),
             title=F.concat(n, F.lit(" modules read the environment around "), F.col("_settings")))])


def architecture(tables: dict[str, DataFrame]) -> DataFrame:
    files, lines = tables["files"], tables["lines"]
    edges = cut_lineage(import_edges(lines, files))
    table = cut_lineage(layers(files))
    components = cut_lineage(strongly_connected(edges))
    return union([import_cycles(components), package_cycle_findings(edges, components), fan_out(edges),
                  dependency_direction(edges, table), boundary_findings(edges, files, table), structure(files, table)])


register(Pack(NAME, "Architecture", ("architecture",), architecture))
