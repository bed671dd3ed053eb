"""Files, sinks, responses and streams."""

import json
import tempfile

from pyspark.sql import functions as F

from fleetaudit.operators import ai as AI
from fleetaudit.plans import registry
from fleetaudit.plans.views import Tables
from fleetaudit.sources import files as FS
from fleetaudit.sources import manifests as MF
from fleetaudit.sources import sinks as SK
from fleetaudit.streaming import jobs as J


def folder():
    return tempfile.mkdtemp(prefix="run-")


def write(root, path, data):
    import os

    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as fh:
        fh.write(data)


def test_file_scan(spark):
    root = folder()
    write(root, "o/r/a/src/x.py", b"\xef\xbb\xbfa = 1\r\nb = 2\n")
    write(root, "o/r/a/node_modules/m/i.js", b"x")
    write(root, "o/r/a/bin.dat", b"ab\x00cd")
    write(root, "o/r/a/big.txt", b"x" * 3_000_000)
    files = FS.read_files(spark, root)
    assert {(r.org_id, r.repo_id, r.audit_id, r.path) for r in files.collect()} == {("o", "r", "a", "src/x.py"), ("o", "r", "a", "big.txt")}
    assert [(r.line_no, r.text) for r in FS.explode_lines(files.filter("path = 'src/x.py'")).collect()] == [(1, "a = 1"), (2, "b = 2")]


def test_lockfiles(repo):
    files = repo({
        "yarn.lock": '# v1\na@^1.0.0, a@^1.2.0:\n  version "1.2.3"\n\n"@s/b@^2":\n  version "2.0.0"\n',
        "poetry.lock": '[[package]]\nname = "x"\nversion = "1.0"\n\n[package.dependencies]\nversion = "9"\n',
        "pnpm-lock.yaml": "importers:\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n        version: 1.0.0\npackages:\n  '@s/b@2.0.0(x@1)':\n    r: 1\n  /c/3.0.0_y:\n    r: 2\n",
        "Pipfile.lock": json.dumps({"default": {"z": {"version": "==3.1"}}, "develop": {}})})
    pins = {(r.ecosystem, r.name, r.version) for r in MF.collect_pins(files).collect()}
    assert pins == {("npm", "a", "1.2.3"), ("npm", "@s/b", "2.0.0"), ("PyPI", "x", "1.0"), ("npm", "c", "3.0.0"), ("PyPI", "z", "3.1")}
    assert [(r.name, r.spec) for r in MF.pnpm_specifiers(files).collect()] == [("a", "^1")]


def test_csv_and_manifest(spark):
    rows = spark.createDataFrame([("o", "r", "a", "=1+1", "high", "x:y", "p.py", 3, "accepted_risk", "t", None)],
                                 "org_id string, repo_id string, audit_id string, title string, severity string, rule_id string, "
                                 "file_path string, line_start int, triage_status string, triage_owner string, triage_expires_on date")
    out = folder() + "/csv"
    SK.write_csv(SK.risk_register_csv(rows), out)
    assert "'=1+1" in spark.read.csv(out, header=True).first().title
    assert all(len(r.sha256) == 64 for r in SK.manifest(spark, out).collect())


def test_explanation_guard(spark):
    keys = "org_id string, repo_id string, audit_id string, batch int"
    body = json.dumps({"explanations": [
        {"id": "F1", "explanation": "use token = abcdef", "false_positive_likelihood": "maybe"},
        {"id": "F1", "explanation": "second"}, {"id": "F9", "explanation": "unknown"}, {"id": "F2", "explanation": "  "}]})
    responses = spark.createDataFrame([("o", "r", "a", 0, body), ("o", "r", "b", 0, "not json")], keys + ", response string")
    allowed = spark.createDataFrame([("o", "r", "a", 0, "F1"), ("o", "r", "a", 0, "F2")], keys + ", id string")
    rows = AI.explanations(responses, allowed).collect()
    assert [(r.id, r.explanation, r.false_positive_likelihood) for r in rows] == [("F1", "use token = [REDACTED]", "")]


def test_stream_equals_batch(spark):
    rows = spark.range(200).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37).alias("ts"), F.lit("s").alias("scope"),
        (F.col("id") % 3).cast("string").alias("ident"))
    src = folder() + "/in"
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    got = J.run_available(J.rate_windows(stream, 20, 1200), folder())
    bound = rows.agg(F.max("ts")).first()[0].timestamp() - 600
    want = rows.groupBy(F.window("ts", "1200 seconds").alias("w"), "ident").count().filter(
        F.col("w.end").cast("long") <= bound).select(F.col("w.start"), "ident", "count")
    assert sorted(map(tuple, got.select("window_start", "ident", "hits").collect())) == sorted(map(tuple, want.collect()))


def test_registry_is_consistent(spark):
    names = registry.queries()
    assert set(registry.oracle_sql()) <= set(names) and len(names) > 120
    assert Tables(spark, "/root/testdata/sf0.001").organizations.count() == 25
