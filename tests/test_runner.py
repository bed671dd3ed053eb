"""Packs that break, give up or never end, next to packs that work."""

import time

from pyspark.sql import functions as F

from fleetaudit.operators import languages as L
from fleetaudit.rules import runner as RN
from fleetaudit.rules.engine import Pack, Rule, scan
from fleetaudit.sources.files import explode_lines

RULE = Rule("todo-marker", "Marker", "quality", "low", "low", "finding", "TODO")


def pack(name, change=lambda lines: lines, **args):
    return Pack(name, name, ("quality",), lambda t: scan(change(t["lines"]), [RULE], name), **args)


def sleeping(seconds):
    def change(lines):
        def wait(batches):
            for batch in batches:
                time.sleep(seconds)
                yield batch

        return lines.mapInPandas(wait, lines.schema)

    return change


def test_packs_fail_and_end_alone(spark, repo, tmp_path):
    files = repo({"a.py": "x = 1  # TODO\ny = 2", "b.py": "# TODO\n# TODO"})
    tables = {"files": files, "lines": explode_lines(files)}

    def plan_error(_):
        raise KeyError("x")

    def refuse(_):
        raise RN.AnalyzerError("cannot log in, password = hunter2hunter2 " + "x" * 400)

    def endless(t):
        while True:  # job after job
            t["lines"].count()

    selected = [
        pack("good"), pack("task", lambda x: x.withColumn("text", F.when(F.col("line_no") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("text")))),
        Pack("plan", "p", ("quality",), plan_error), Pack("refused", "r", ("quality",), refuse), pack("column", lambda x: x.select("nothing")),
        pack("slow", sleeping(600), seconds=4), Pack("endless", "e", ("quality",), endless, seconds=4), pack("late", sleeping(0.2)),
        pack("java", languages=("Java",))]
    start = time.monotonic()
    found, outcomes = RN.run_packs(tables, selected, str(tmp_path / "packs"), parallel=9)
    assert time.monotonic() - start < 200
    got = {o.name: (o.status, o.reason) for o in outcomes}
    assert [o.name for o in outcomes] == [p.name for p in selected]
    assert {n: s for n, (s, _) in got.items()} == {
        "good": "ok", "task": "failed", "plan": "failed", "refused": "failed", "column": "failed", "slow": "timeout",
        "endless": "timeout", "late": "ok", "java": "ok"}
    assert got["plan"][1] == "internal analyzer error (KeyError)" and got["slow"][1] == "took more than 4 seconds"
    assert {(r["analyzer"], r["n"]) for r in found.groupBy("analyzer").agg(F.count("*").alias("n")).collect()} == {("good", 3), ("late", 3), ("java", 3)}
    rows = {r["name"]: r for r in RN.outcome_rows(files.select("org_id", "repo_id", "audit_id").distinct(), L.language_stats(files), selected, outcomes).collect()}
    assert len(rows) == len(selected)
    assert rows["java"]["status"] == "skipped" and rows["java"]["reason"] == "no Java files detected"
    assert "hunter2" not in rows["refused"]["reason"] and len(rows["refused"]["reason"]) == 300
    assert rows["slow"]["status"] == "timeout" and rows["good"]["reason"] == ""
    # nothing of a broken pack is left running, and the session goes on
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert spark.range(5).count() == 5


def test_without_a_pack_that_works(repo, tmp_path):
    files = repo({"a.py": "# TODO"})
    found, outcomes = RN.run_packs({"lines": explode_lines(files)}, [pack("column", lambda x: x.select("nothing"))], str(tmp_path))
    assert found is None and outcomes[0].status == "failed" and outcomes[0].folder == ""
    assert RN.run_packs({"lines": explode_lines(files)}, [], str(tmp_path)) == (None, [])
