"""Joins of two sides that grow with the fleet never send one through the driver."""

from pyspark.sql import functions as F

from fleetaudit.operators import AUDIT
from fleetaudit.operators import catalogue as CA
from fleetaudit.operators import graph as G

COLUMNS = ("org_id string, repo_id string, model string, tbl string, col string, type string, nullable boolean, pk boolean, "
           "is_unique boolean, fk_tbl string, fk_col string, on_delete string, orm string, file string, line int")
RELATIONS = ("org_id string, repo_id string, model string, name string, target string, back_populates string, kind string, "
             "uselist boolean, secondary boolean, explicit_join boolean, line int, file string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relation_problems_join_without_the_driver(spark):
    columns = spark.createDataFrame([("o", "r", m, t, "id", "Integer", False, True, True, None, None, None, "sqlalchemy", "m.py", 1)
                                     for m, t in (("User", "users"), ("Post", "posts"))], COLUMNS)
    relations = spark.createDataFrame([("o", "r", "User", "posts", "Post", "author", "relationship", False, False, False, 1, "m.py")], RELATIONS)
    indexes = spark.createDataFrame([("o", "r", "posts", ["id"], True)], "org_id string, repo_id string, tbl string, cols array<string>, is_unique boolean")
    found = CA.relation_problems(relations, columns, indexes)
    assert "Broadcast" not in plan(found)
    assert {r["title"] for r in found.select(F.col("title")).collect()} == {
        "User.posts back_populates a missing Post.author", "User.posts has no foreign key path to Post"}


def _ring(name, n):
    return [("o", name, "a", f"n{i:02}", f"n{(i + 1) % n:02}") for i in range(n)]


def test_settled_graphs_are_not_pushed_again_and_edges_stay_off_the_driver(spark, monkeypatch):
    edges = spark.createDataFrame(_ring("long", 10) + _ring("short", 2), "org_id string, repo_id string, audit_id string, src string, dst string")
    state = edges.select(*AUDIT, F.col("src").alias("node"), F.col("src").alias("label"))
    written, kept = [], G.cut_lineage

    def watched(df):
        if "label" in df.columns:
            assert "Broadcast" not in plan(df)
            written.append({r["repo_id"] for r in df.select("repo_id").distinct().collect()})
        return kept(df)

    monkeypatch.setattr(G, "cut_lineage", watched)
    got = {(r["repo_id"], r["node"]): r["label"] for r in G._spread(state, edges, AUDIT, 4).collect()}
    assert set(got.values()) == {"n00"} and len(got) == 12
    assert "short" not in written[-1] and "long" in written[-1]


def test_small_graphs_are_solved_in_one_pass_and_large_ones_as_before(spark, monkeypatch):
    rows = [*_ring("long", 10), *_ring("short", 2), ("o", "line", "a", "n0", "n1"), ("o", "line", "a", "n1", "n2"), ("o", "two", "a", "x", "y"),
            ("o", "two", "a", "y", "x"), ("o", "two", "a", "y", "é"), ("o", "two", "a", "é", "z"), ("o", "two", "a", "z", "é"), ("o", "two", "a", "z", "z"),
            (None, "short", "a", "n0", "n1"), (None, "short", "a", "n1", "n0"), ("o", "short", "a", None, "n0"), ("o", "short", "b", "n1", "n0")]
    edges = spark.createDataFrame(rows + rows[:3], "org_id string, repo_id string, audit_id string, src string, dst string").repartition(3)

    def found(of):
        return sorted((r["org_id"], r["repo_id"], r["audit_id"], r["node"], r["component"], r["size"]) for r in of.collect())

    want = sorted([*(("o", "long", "a", f"n{i:02}", "n00", 10) for i in range(10)), *(("o", "short", "a", f"n{i:02}", "n00", 2) for i in range(2)),
                   *(("o", "two", "a", n, "x", 2) for n in "xy"), *(("o", "two", "a", n, "z", 2) for n in "zé")])
    for most in (5, 0):  # some graphs are larger, all are
        monkeypatch.setattr(G, "WHOLE", most)
        assert found(G.strongly_connected(edges)) == want
    monkeypatch.setattr(G, "WHOLE", 1000)
    monkeypatch.setattr(G, "_spread", None)
    assert found(G.strongly_connected(edges)) == want
    assert G.strongly_connected(edges.limit(0)).count() == 0


def test_a_graph_that_ends_in_a_later_batch_is_solved_whole():
    import pandas as pd

    edges = pd.DataFrame([(k, f"n{i:02}", f"n{(i + 1) % n:02}") for k, n in (("a", 3), ("b", 7), ("c", 2), ("d", 5)) for i in range(n)], columns=["k", "src", "dst"])
    for step in (1, 2, 4, 100):
        got = pd.concat(G._solve(["k"])(edges.iloc[i:i + step] for i in range(0, len(edges), step)))
        assert dict(got.groupby("k")["size"].agg(lambda s: (len(s), s.iloc[0]))) == {"a": (3, 3), "b": (7, 7), "c": (2, 2), "d": (5, 5)}


def test_findings_are_dealt_by_audit_once(spark, tmp_path):
    """Rows that lie by audit meet their files, lines and duplicates without being moved again."""
    from fleetaudit.plans import core
    from fleetaudit.plans.views import Tables

    spark.createDataFrame([(1, 4), (2, 4)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1), (11, 2), (12, 9), (None, 1)], "o_orderkey long, o_custkey long").write.parquet(
        f"{tmp_path}/orders.parquet")
    row = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_discount double, " \
          "l_returnflag string, l_shipdate timestamp"
    rows = [(10, 31, 5, 1), (10, 31, 5, 1), (10, 34, 5, 2), (10, 37, 5, 2), (11, 31, 5, 1), (11, 40, 11, 3), (12, 31, 5, 1), (None, 31, 5, 1)]
    spark.createDataFrame([(*r, 5.0, 0.01, 0.02, "A", None) for r in rows], row).write.parquet(f"{tmp_path}/lineitem.parquet")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "-1")
    try:
        t = Tables(spark, str(tmp_path))
        for frame, count in ((core.identified(t), 6), (core.merged(t), 5)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(o_audit" in plan and "hashpartitioning(org_id" not in plan
            found = frame.collect()
            assert len(found) == count and {r.audit_id for r in found} == {"10", "11"}
        assert sorted(r.reports for r in found) == [1, 1, 1, 1, 2]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_lifecycle_and_fix_tables_hold_no_texts(spark, tmp_path, monkeypatch):
    """What a query writes below the checkpoint folder has the columns it reads and no others."""
    from fleetaudit.operators import history as H
    from fleetaudit.plans import governance as GO
    from fleetaudit.plans.views import Tables

    spark.createDataFrame([(1, 4), (2, 4)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    order = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double, day string"
    orders = spark.createDataFrame([(10, 1, "1-URGENT", "F", 5.0, "2001-01-01"), (11, 1, "1-URGENT", "F", 5.0, "2001-01-02"), (12, 1, "1-URGENT", "F", 5.0, "2001-01-03"),
                                    (13, 2, "1-URGENT", "F", 5.0, "2001-01-01")], order)
    orders.selectExpr("*", "to_timestamp(day) o_orderdate").drop("day").write.parquet(f"{tmp_path}/orders.parquet")
    row = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_discount double, " \
          "l_returnflag string, l_shipdate timestamp"
    rows = [(10, 31, 5, 1), (10, 31, 5, 2), (10, 34, 5, 2), (11, 34, 5, 1), (12, 31, 5, 1), (12, 34, 5, 1), (12, 37, 5, 1), (13, 31, 5, 1)]
    spark.createDataFrame([(*r, 5.0, 0.01, 0.02, "A", None) for r in rows], row).write.parquet(f"{tmp_path}/lineitem.parquet")
    names = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    tables, kept = [], GO.cut_lineage

    def watched(df):
        tables.append(set(df.columns))
        return kept(df)

    monkeypatch.setattr(GO, "cut_lineage", watched)
    monkeypatch.setattr(H, "cut_lineage", watched)
    plans = {name: plan for name, plan, _ in GO.PLANS}
    try:
        t = Tables(spark, str(tmp_path))
        got = sorted((r["audit_id"], r["emit_idx"] // 100003 % 1000003, r["lifecycle"]) for r in plans["lifecycle"](t).collect())
        assert got == [("10", 31, "new"), ("10", 31, "new"), ("10", 34, "new"), ("11", 34, "existing"), ("12", 31, "recurring"),
                       ("12", 34, "existing"), ("12", 37, "new"), ("13", 31, "new")]
        counts = {r["audit_id"]: (r["new"], r["existing"], r["recurring"], r["resolved"]) for r in plans["lifecycle_counts"](t).collect()}
        assert counts == {"10": (3, 0, 0, 0), "11": (0, 1, 0, 1), "12": (1, 1, 1, 0), "13": (1, 0, 0, 0)}
        verdicts = {r["audit_id"]: (r["resolved"], r["still_present"], r["introduced"]) for r in plans["fix_verdict"](t).collect()}
        assert verdicts == {"11": (2, 1, 0), "12": (0, 1, 2)}
        assert tables and not set().union(*tables) & {"title", "description", "evidence", "remediation", "references", "score10", "risk_level"}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_reachability_judges_pins_before_advisories_multiply_them(spark, monkeypatch):
    from fleetaudit.operators import dependencies as D
    from fleetaudit.plans import repositories as RE

    pins = spark.createDataFrame([("o", "r", "a", "PyPI", n, "1.0", "req.txt") for n in ("PyYAML", "flask", "Left", "_odd")] + [
        (None, "r", "a", "PyPI", "flask", "1.0", "req.txt"), ("o", "s", "a", "PyPI", "flask", "2.0", "req.txt")],
        "org_id string, repo_id string, audit_id string, ecosystem string, name string, version string, source string")
    known = spark.createDataFrame([("PyPI", n, "1.0", f"G{i}", None if i == 2 else f"C{i}", "s", "high", ["2.0"]) for n in ("PyYAML", "flask", "Left", "_odd") for i in range(3)],
                                  "ecosystem string, name string, version string, advisory_id string, display_id string, summary string, severity string, fixed array<string>")
    imports = spark.createDataFrame([("o", "r", "a", "pyyaml", "b.py", 2), ("o", "r", "a", "pyyaml", "a.py", 1)], "org_id string, repo_id string, audit_id string, package string, path string, line_no int")
    direct = spark.createDataFrame([("o", "r", "a", "flask")], "org_id string, repo_id string, audit_id string, package string")

    def rows(df):
        return sorted((tuple(str(r[c]) for c in sorted(df.columns))) for r in df.collect())

    late = D.reachability(D.vulnerabilities(pins, known), imports, direct)
    early = D.reachability(D.vulnerabilities(D.pin_reachability(pins, imports, direct), known))
    assert rows(early) == rows(late) and sorted(early.columns) == sorted(late.columns) and early.count() == 15
    by_name = {r["title"].split(" ")[0]: (r["reachability"], r["confidence"]) for r in early.where("title IS NOT NULL AND org_id IS NOT NULL").collect()}
    assert by_name == {"PyYAML": ("imported", "high"), "flask": ("not-imported", "medium"), "Left": ("transitive", "medium"), "_odd": ("", "high")}

    class Made:
        repo_files = None

    monkeypatch.setattr(RE.MF, "collect_pins", lambda files: pins)
    monkeypatch.setattr(RE.MF, "python_declared", lambda files: direct.withColumnRenamed("package", "dist"))
    monkeypatch.setattr(RE.D, "external_imports", lambda files: imports)
    monkeypatch.setattr(RE, "lines", lambda t: None)
    monkeypatch.setattr(RE, "advisories", lambda t: known)
    asked = RE._reachability(Made()).select("repo_id", "rule_id", "reachability", "confidence")
    plan = asked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "Inner" in next(line for line in plan if "Join" in line)  # the join that multiplies is the last


def test_a_version_many_pin_is_joined_by_many_tasks(spark):
    from fleetaudit.operators import dependencies as D

    pins = spark.range(64).selectExpr("'o' org_id", "string(id) repo_id", "'a' audit_id", "'PyPI' ecosystem", "'flask' name", "'1.0' version", "'req.txt' source")
    known = spark.range(3).selectExpr("'PyPI' ecosystem", "'flask' name", "'1.0' version", "string(id) advisory_id", "string(id) display_id", "'s' summary",
                                      "'high' severity", "array('2.0') fixed")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = D.vulnerabilities(pins, known)
        assert "Broadcast" not in plan(found)
        rows = found.select("repo_id", "emit_idx", F.spark_partition_id().alias("at")).collect()
        assert len({r["at"] for r in rows}) > 1
        assert sorted((int(r["repo_id"]), r["emit_idx"]) for r in rows) == [(i, k) for i in range(64) for k in (1, 2, 3)]
    finally:
        spark.conf.set(name, before)
