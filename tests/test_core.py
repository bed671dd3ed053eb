"""Scores, identity, policy, history, versions, redaction and graphs against hand-made expectations and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from fleetaudit.functions import text as X
from fleetaudit.functions import versions as VR
from fleetaudit.operators import AUDIT
from fleetaudit.operators import change_risk as CR
from fleetaudit.operators import dependencies as D
from fleetaudit.operators import findings as FI
from fleetaudit.operators import graph as G
from fleetaudit.operators import history as H
from fleetaudit.operators import policy as PO
from fleetaudit.operators import scoring as SC
from fleetaudit.operators import verify as VE
from fleetaudit.vocab import RULE_NAMESPACE as NS

SCHEMA = ("org_id string, repo_id string, audit_id string, analyzer string, emit_idx long, rule_id string, title string, "
          "category string, severity string, confidence string, kind string, description string, remediation string, "
          "file_path string, line_start int, line_end int, evidence string, references array<string>, sources array<string>, "
          "source_line string")


def mk(i, rule="bandit:B608", sev="high", conf="high", kind="confirmed", cat="security", path="a.py", line=3, title="T",
       analyzer="bandit", evidence="", refs=(), desc="", code="x = 1"):
    return ("o", "r", "a", analyzer, i, rule, title, cat, sev, conf, kind, desc or f"d{i}", "fix", path, line, line, evidence,
            list(refs), [analyzer], code)


@pytest.fixture(scope="session")
def findings(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def score(spark, rows, cats=("security",)):
    f = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    audits = spark.createDataFrame([("o", "r", "a")], "org_id string, repo_id string, audit_id string")
    outcomes = audits.withColumns({"name": F.lit("x"), "status": F.lit("ok"),
                                   "categories": F.array(*[F.lit(c) for c in cats])})
    cat = {r.category: r for r in SC.category_scores(f, outcomes, audits).collect()}
    return cat, SC.scorecard(f, outcomes, audits).first()


def test_scores(spark):
    cats, card = score(spark, [])
    assert cats["security"].score == 100 and not cats["api"].assessed and card.risk == "Low"
    cats, card = score(spark, [mk(1, sev="critical")])
    assert float(cats["security"].score) == 35 and card.risk == "Critical"
    assert cats["security"].ceiling_reason == "capped at 35 by confirmed critical finding: T"
    cats, _ = score(spark, [mk(i, sev="medium", line=i) for i in range(1, 30)])
    assert float(cats["security"].score) == 82  # one rule never costs more than three times its weight
    cats, _ = score(spark, [mk(1, sev="critical", conf="low", kind="potential")])
    assert float(cats["security"].score) == 88  # low confidence sets no ceiling
    cats, card = score(spark, [mk(1, sev="critical", cat="testing", rule="x:y")], ("security", "testing"))
    assert card.risk == "High"  # at most one level better than a non-critical category


def fold(rows):
    """The merge written as a fold over rows in emission order."""
    rank, conf = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}, {"low": 0, "medium": 1, "high": 2}
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    cur = dict(rule=rows[0][5], sev=rows[0][8], conf=rows[0][9], kind=rows[0][10], desc=rows[0][11], ev=rows[0][16],
               src=list(rows[0][18]), ref=list(rows[0][17]))
    taint = NS + "taint."
    for r in rows[1:]:
        if rank[r[8]] > rank[cur["sev"]]:
            cur["sev"] = r[8]
        if conf[r[9]] > conf[cur["conf"]]:
            cur["conf"], cur["kind"] = r[9], r[10]
        if r[5].startswith(taint) and not cur["rule"].startswith(taint):
            cur["desc"], cur["ev"], cur["kind"], cur["conf"] = r[11], r[16], r[10], r[9]
        cur["src"] += [s for s in r[18] if s not in cur["src"]]
        cur["ref"] += [s for s in r[17] if s not in cur["ref"]]
        if not cur["ev"] and r[16]:
            cur["ev"] = r[16]
    return cur


@pytest.mark.parametrize("seed", range(6))
def test_merge_equals_fold(findings, seed):
    rng = random.Random(seed)
    rules = ["bandit:B608", "ruff:S608", NS + "taint.sql-injection", NS + "database.sql-string-formatting"]
    rows = [mk(i, rule=rng.choice(rules), sev=rng.choice(["low", "medium", "high"]), conf=rng.choice(["low", "medium", "high"]),
               kind=rng.choice(["confirmed", "potential"]), analyzer=rng.choice(["bandit", "ruff", "taint"]),
               evidence=rng.choice(["", f"e{i}"]), refs=rng.sample(["p", "q", "s"], 2)) for i in range(8)]
    want = fold(rows)
    shuffled = rng.sample(rows, len(rows))
    got = FI.merge_duplicates(findings(shuffled).repartition(4)).collect()
    assert len(got) == 1
    g = got[0]
    assert (g.rule_id, g.severity, g.confidence, g.kind, g.description, g.evidence, g.sources, g.references) == (
        want["rule"], want["sev"], want["conf"], want["kind"], want["desc"], want["ev"], want["src"], want["ref"])


def test_fingerprints_agree_and_survive_shifts(findings):
    base = [mk(1, line=3), mk(2, line=9), mk(3, rule="ruff:S608", analyzer="ruff", line=3)]
    moved = [(*r[:14], r[14] + 5, r[15] + 5, *r[16:]) for r in base]
    one = {(r.rule_id, r.fingerprint) for r in FI.fingerprint(findings(base)).collect()}
    two = {(r.rule_id, r.fingerprint) for r in FI.fingerprint(findings(moved)).collect()}
    assert one == two and len({fp for _, fp in one}) == 2
    merged = {r.fingerprint for r in FI.merge_duplicates(findings(base)).collect()}
    assert merged == {fp for _, fp in one}


@pytest.mark.parametrize("glob,path,want", [
    ("src/**", "src/a/b.py", True), ("src/*.py", "src/a/b.py", True), ("**/x.py", "x.py", True), ("a?.py", "ab.py", True),
    ("docs/**", "src/docs.py", False), (".github/**", "github/x", True), ("v[0-9]/**", "v1/a", True), ("a.py", "axpy", False)])
def test_globs(spark, glob, path, want):
    row = spark.range(1).select(F.rlike(F.lit(path), X.glob_regex(F.lit(glob))).alias("m")).first()
    assert row.m is want


def test_redaction_and_paths(spark):
    rows = spark.createDataFrame([
        ("password = hunter22",), ("token = os.environ['X']",), ("postgres://u:pw@h/db",), ("x AKIA" + "A" * 16,), ("plain",),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nrest",)], "t string")
    got = [r.m for r in rows.select(X.redact("t").alias("m")).collect()]
    assert got == ["password = [REDACTED]", "token = os.environ['X']", "postgres://[REDACTED]h/db", "x [REDACTED]", "plain",
                   "[REDACTED]\nrest"]
    paths = spark.createDataFrame([("tests/a.py",), ("src/test_a.py",), ("src/a.spec.ts",), ("src/contest.py",)], "p string")
    assert [r.t for r in paths.select(X.is_test_path("p").alias("t")).collect()] == [True, True, True, False]


@pytest.mark.parametrize("version,spec,want", [
    ("1.2", ">=1.0,<2", True), ("2.0", "<2", False), ("1.4.5", "~=1.4", True), ("2.0", "~=1.4", False), ("1.0rc1", ">=1", None),
    ("1.10", "==1.1*", None), ("1.1.9", "==1.1.*", True), ("v1.0", "==1.0.0", True), ("1.0", "^1", None), ("3", "", True)])
def test_satisfies(spark, version, spec, want):
    assert spark.range(1).select(VR.satisfies(F.lit(version), F.lit(spec)).alias("s")).first().s is want


def test_cvss(spark):
    rows = spark.createDataFrame([("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",),
                                  ("CVSS:2.0/AV:N",)], "v string")
    assert [r.s for r in rows.select(VR.cvss3_base_score("v").alias("s")).collect()] == [9.8, 6.1, None]


def test_policy_precedence(spark):
    entry = "array<struct<pattern:string,{}:string>>"
    schema = ("org_id string, repo_id string, layer int, fail_on string, max_findings int, max_change_risk string, "
              "require_analyzers array<string>, disable_rules array<string>, disable_analyzers array<string>, "
              "exclude_paths array<string>, path_gates " + entry.format("fail_on") + ", severity_overrides " + entry.format("severity"))
    rows = [("o", "r", 0, "low", None, None, ["a"], ["x:*"], [], [], [("src/**", "low")], [("bandit:*", "low"), ("bandit:B1*", "medium")]),
            ("o", "r", 1, None, 3, None, ["b", "a"], [], [], [], [("src/a/**", "never")], [("bandit:*", "info")])]
    pol = PO.layered(spark.createDataFrame(rows, schema))
    row = pol.first()
    assert (row.fail_on, row.max_findings, row.max_change_risk, row.require_analyzers) == ("low", 3, "never", ["a", "b"])
    probe = spark.createDataFrame([("o", "r", "src/a/x.py", "bandit:B105"), ("o", "r", "src/b.py", "bandit:C1"), ("o", "r", "lib/c.py", "ruff:X")],
                                  "org_id string, repo_id string, file_path string, rule_id string")
    got = probe.join(PO.compiled(pol), ["org_id", "repo_id"]).select(
        "file_path", PO.threshold_for().alias("t"), PO.severity_override().alias("s")).collect()
    assert {(r.file_path, r.t, r.s) for r in got} == {
        ("src/a/x.py", "never", "medium"), ("src/b.py", "low", "info"), ("lib/c.py", "low", None)}


def test_change_risk(spark):
    files = spark.createDataFrame([("o", "r", "a", "src/auth/login.py", 300, 0, 0), ("o", "r", "a", "billing/pay.py", 1, 0, 1),
                                   ("o", "r", "a", "migrations/1.py", 1, 0, 2)],
                                  "org_id string, repo_id string, audit_id string, path string, additions int, deletions int, seq int")
    intro = spark.createDataFrame([("o", "r", "a", "high", NS + "ai-code.x")],
                                  "org_id string, repo_id string, audit_id string, severity string, rule_id string")
    row = CR.assess(files, intro, files.select(*AUDIT).distinct()).first()
    # 8 size, 35 areas (15 + 15 + 5 of 10), 15 no tests, 10 finding, 5 generated code
    assert (row.score, row.level) == (73, "high")
    assert [f.points for f in row.factors] == [8, 15, 15, 5, 15, 10, 5]


def test_baseline_ties_and_branches(spark):
    rows = [("1", "main", "succeeded", None, "2024-01-01"), ("2", "dev", "succeeded", None, "2024-01-02"),
            ("3", "main", "succeeded", 7, "2024-01-03"), ("4", "main", "failed", None, "2024-01-03"),
            ("5", "main", "succeeded", None, "2024-01-05"), ("6", "main", "succeeded", None, "2024-01-05"),
            ("7", "new", "running", None, "2024-01-06")]
    audits = spark.createDataFrame(rows, "audit_id string, branch string, status string, pr_number int, d string").select(
        F.lit("o").alias("org_id"), F.lit("r").alias("repo_id"), "audit_id", "branch", "status", "pr_number",
        F.col("d").cast("timestamp").alias("created_at"))
    got = {r.audit_id: r.previous_audit_id for r in H.with_baseline(audits).collect()}
    assert got == {"1": None, "2": "1", "3": "1", "4": "1", "5": "6", "6": "5", "7": "6"}


def test_fix_verdict(spark, findings):
    base = findings([mk(1), mk(2, line=9, code="y")]).withColumn("fingerprint", F.concat(F.lit("f"), F.col("emit_idx")))
    after = findings([mk(2, line=9, code="y"), mk(5, rule="x:new", line=4)]).withColumn(
        "fingerprint", F.concat(F.lit("f"), F.col("emit_idx")))
    changed = spark.createDataFrame([("o", "r", "a", "a.py")], "org_id string, repo_id string, audit_id string, path string")
    judged, new = VE.compare(base, base, after, changed, AUDIT)
    assert {r.emit_idx: r.resolved for r in judged.collect()} == {1: True, 2: False}
    assert [r.rule_id for r in new.collect()] == ["x:new"]
    none = spark.createDataFrame([], "org_id string, repo_id string, audit_id string")
    assert VE.verdict(judged, new, none, AUDIT).first().verdict == "regressed"


def osa(a, b):
    """The table of edits, cell by cell."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_transposition_distance_by_words():
    rng = random.Random(4)
    names = ["", "a", "ab", "ba", "abc", "ca", "é😀b", "😀éb", "x" * 64, "x" * 65, "y" + "x" * 63, "ab" * 40, "ba" * 40, "a" + "ba" * 40]
    names += ["".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (5, 12, 70, 140) for _ in range(25)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(1500)] + [(n, n) for n in names] + [("", n) for n in names] + [(n, "") for n in names]
    got = D.transposition_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == [osa(a, b) for a, b in pairs]
    assert len(D.transposition_distances([], [])) == 0


def test_lookalikes_equal_brute_force(spark):
    popular = ["requests", "beautifulsoup", "numpy", "flask"]
    rng = random.Random(3)
    names = {"reqeusts", "request", "numpi", "flaks", "flasks", "beautifulsuop", "beautiflsop", "requests", "ab", "zzzzz"}
    for base in popular:
        for _ in range(12):
            s = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                i = rng.randrange(len(s))
                rng.choice([lambda i=i: s.pop(i), lambda i=i: s.insert(i, "q"), lambda i=i: s.__setitem__(i, "w")])()
            names.add("".join(s))
    df = spark.createDataFrame([("e", n) for n in names], "ecosystem string, name string")
    pop = spark.createDataFrame([("e", p, i) for i, p in enumerate(popular)], "ecosystem string, name string, seq int")
    got = {r.name: r.target for r in D.lookalikes(df, pop).collect()}
    want = {}
    for n in names:
        limit = 2 if len(n) >= 10 else 1
        if n in popular or len(n) < 5:
            continue
        hit = next((p for p in popular if (p[0] == n[0] or p[-1] == n[-1]) and osa(n, p) <= limit), None)
        if hit:
            want[n] = hit
    assert got == want and "reqeusts" in got


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = {("o", str(k), "a", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for k in range(4) for _ in range(11)}
    edges = spark.createDataFrame(sorted(rows), "org_id string, repo_id string, audit_id string, src string, dst string")
    got = {(r.repo_id, r.node, r.component) for r in G.strongly_connected(edges).collect()}
    want = set()
    for k in {r[1] for r in rows}:
        e = {(s, d) for _, kk, _, s, d in rows if kk == k and s != d}
        reach = set(e)
        while True:
            more = {(a, d) for a, b in reach for c, d in e if b == c} - reach
            if not more:
                break
            reach |= more
        nodes = {x for p in e for x in p}
        for n in nodes:
            comp = {m for m in nodes if (n, m) in reach and (m, n) in reach} | {n}
            if len(comp) > 1:
                want.add((k, n, min(comp)))
    assert got == want
