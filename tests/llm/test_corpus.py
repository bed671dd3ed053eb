"""Operators over a whole corpus against brute force, models on held-out rows, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetaudit.llm import line_dedup, neighbours, quality, queries, simhash, toxicity
from fleetaudit.llm.components import components, stars

SF = "/root/testdata/sf0.001"
RANDOM = random.Random(11)


def test_components_of_chains_stars_and_cliques(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(900 + i, 900 + j) for i in range(6) for j in range(i)]
    pairs += [(RANDOM.randrange(2000, 2100), RANDOM.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in stars(edges).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    nodes = spark.createDataFrame([(n, -n) for n in root] + [(10_000, 5)], "node long, least long")
    least = {r["node"]: r["least"] for r in components(edges, nodes).collect()}
    groups = {}
    for n in root:
        groups.setdefault(find(n), []).append(-n)
    assert least == {n: min(groups[find(n)]) for n in root} | {10_000: 5}
    assert stars(edges.where("false")).count() == 0


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def plain_line_classes(rows):
    """(doc, line) -> the line that stays, by all pairs."""
    places = [(k, i, x.strip(" \t\r")) for k, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")]
    distinct = list(dict.fromkeys(p[2] for p in places))
    sets = [shingles(x) for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    at, first = {x: i for i, x in enumerate(distinct)}, {}
    for k, i, x in sorted(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        first.setdefault(find(at[x]), (k, i))
    return {(k, i): first[find(at[x])] for k, i, x in places}


def line_rows():
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "日本語", "naïve", "x"]
    line = lambda: " ".join(RANDOM.choices(words, k=RANDOM.choice([1, 3, 20, 30])))
    hot, rows = " ".join(words * 4), []
    for i in range(60):
        lines = [line() for _ in range(RANDOM.randrange(5))] + [hot if i % 3 else hot[:-1] + "y", "", "  ", "same  \r"]
        RANDOM.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (None, hot), (63, "short"), (64, "short"), (65, "z" * 30_000), (66, "z" * 30_001)]


def test_line_classes_against_all_pairs(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc"], r["kept_line"]) for r in line_dedup.line_classes(docs.repartition(4)).collect()}
    want = plain_line_classes(rows)
    assert got.keys() == want.keys()
    wrong = [k for k in want if got[k] != want[k]]
    assert len(wrong) <= 0.005 * len(want)


def linked_in_one_bucket(spark, monkeypatch, texts):
    """The components ``links`` finds, as sets of indexes, when all of ``texts`` share one bucket and no other."""
    monkeypatch.setattr(line_dedup, "buckets", lambda lines: lines.select("k1", F.lit(0).cast("long").alias("band")).distinct())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = {(r["k1"], r["k2"]): r["doc_id"] for r in line_dedup._lines(docs).collect()}
    root = list(range(len(texts)))
    for r in line_dedup.links(line_dedup._lines(docs)).collect():
        a, b = (root[named[(x["k1"], x["k2"])]] for x in (r["a"], r["b"]))
        root = [min(a, b) if x in (a, b) else x for x in root]
    return sorted(sorted(i for i, x in enumerate(root) if x == at) for at in set(root))


def test_a_mixed_bucket_is_served_to_its_end(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij", k=80)) for _ in range(30)]
    assert linked_in_one_bucket(spark, monkeypatch, texts + [texts[7] + "k"]) == sorted([[7, 30], *([i] for i in range(30) if i != 7)])


def test_matched_members_link_those_their_leader_does_not_match(spark, monkeypatch):
    rng = random.Random(6)
    texts = []
    for _ in range(6):  # families that drift: neighbours alike, ends unlike
        line = rng.choices("abcdefghij", k=120)
        for step in range(12):
            texts.append("".join(line))
            line[8 * step] = "z"
    assert linked_in_one_bucket(spark, monkeypatch, texts) == [list(range(12 * i, 12 * i + 12)) for i in range(6)]


def test_lines_that_differ_in_numbers_share_a_band(spark):
    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9))) for _ in range(30))[:150]
    rows = []
    for i in range(200):
        body = prose()
        a, b = (f"2024-05-17 {rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02} {body}" for _ in range(2))
        if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
            rows += [(2 * i, a), (2 * i + 1, b)]
    lines = line_dedup._lines(spark.createDataFrame(rows, "doc_id long, text string"))
    named = {r["k1"]: r["doc_id"] for r in lines.collect()}
    bands = {}
    for r in line_dedup.buckets(lines).collect():
        bands.setdefault(named[r["k1"]], set()).add(r["band"])
    met = sum(bool(bands[i] & bands[i + 1]) for i, _ in rows[::2])
    assert len(rows) >= 100 and met >= 0.96 * len(rows) / 2


def test_bands_of_one_line_are_left_out_before_anything_is_written(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghij", k=90)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[4] + "k"])), "doc_id long, text string")
    seen, keep = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: seen.setdefault(name, []).append(keep(df, name)) or seen[name][-1])
    line_dedup.links(line_dedup._lines(docs))
    members = [r for r in seen["line_members"][0].collect()]
    assert members and len({r["k1"] for r in members}) == 2
    plan = line_dedup._shared(line_dedup.buckets(line_dedup._lines(docs)))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(band") == 1


def test_shingles_are_cut_once_a_pair(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz" * 2, "abcdefghijklmnopqrstuvwxyz" * 2 + "!", "0123456789abcdefghijklmnopqrs", "short", None]
    sizes = [len(shingles(t)) if t else None for t in texts]
    rows = [(a, a, b, b, texts[a], sizes[a], texts[b], sizes[b]) for a in range(4) for b in range(a)]
    both = spark.createDataFrame(rows, "a1 long, a2 long, b1 long, b2 long, of_a string, n_a int, of_b string, n_b int")
    near = line_dedup._near(both)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("utf-32") == 2
    want = {(a, b): len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b])) for a in range(4) for b in range(a)}
    assert {(r["a1"], r["b1"]): r["likeness"] for r in near.collect()} == {k: v for k, v in want.items() if v >= 0.6}


def test_leaders_are_aggregates_without_a_window(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "written", lambda df, name: df)
    members = spark.range(100).selectExpr("id % 3 cell", "0 role", "id k1", "0d away", "id root")
    leaders = line_dedup._leaders(members, 0)
    plan = leaders._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_min" in plan
    assert sorted(r["cell"] for r in leaders.collect()) == [0, 1, 2]


def test_dedup_lines_keeps_rows_and_columns(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(k, t, "q", 7) for k, t in rows + rows[:2]], "doc_id long, text string, line_no string, removed_lines int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows) + 2 and sum(r["text"] is None for r in out) == 1
    want = plain_line_classes(rows)
    texts = {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if want.get((k, i), (k, i)) == (k, i)) for k, t in rows}
    assert sum(r["text"] != texts[r["doc_id"]] for r in out) <= 1
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def plain_nearest(rows, queries_, k):
    keep = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries_:
        for i, v in keep:
            if i == q:
                scored = [(-(w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())), j) for j, w in keep if j != q and len(w) == len(v)]
                out[q] = [j for _, j in sorted(scored)[:k]]
    return out


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(400)]
    same = rows[0][1]
    rows += [(i, same) for i in range(400, 520)] + [(520, None), (521, [0.0] * 12), (522, [float("nan")] * 12), (523, [None] + same[1:]), (None, same)]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert vectors.count() == 520
    got = {}
    asked = vectors.where("id % 50 = 0")
    for r in neighbours.nearest(vectors, asked, k=5, shard_rows=100, query_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain_nearest(rows, [i for i in range(0, 520, 50)], 5)
    assert neighbours.nearest(vectors.where("false"), asked.where("false")).count() == 0
    few = vectors.where("id in (0, 1, 2)")
    assert neighbours.nearest(few, few.where("id = 0")).count() == 2


def test_repeated_queries_and_candidates(spark):
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, rng.normal(size=6)))) for i in range(200)]
    vectors = neighbours.usable(spark.createDataFrame(rows + [rows[0], rows[0], rows[50]], "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.nearest(vectors, vectors.where("id % 50 = 0"), shard_rows=50, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain_nearest(rows + [rows[0], rows[0], rows[50]], [0, 50, 100, 150], 5)
    twins = neighbours.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    found = neighbours.nearest(twins, twins.where("id = 0"), k=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [2, 1] and found[1]["score"] == 0.0
    found = neighbours.nearest(twins, twins.where("id = 0"), k=5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 2), (2, 1), (3, 1)]
    two = neighbours.usable(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<double>"))
    found = neighbours.nearest(two, two.where("id = 0"), k=1).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 2]


def test_large_and_tiny_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e-200, 0.0]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {r["vec_id"]: r["score"] for r in neighbours.nearest(vectors, vectors.where("id = 0")).collect()}
    assert found == pytest.approx({1: 1.0, 2: 1.0, 3: 0.5 ** 0.5, 4: 1.0, 5: 0.0})


def test_relaxed_pruning_still_finds_most(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 8))
    rows = [(i, list(map(float, centers[i % 20] + 0.3 * rng.normal(size=8)))) for i in range(3000)]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = vectors.where("id % 50 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(vectors, asked).collect()}
    relaxed = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(vectors, asked, factor=1.3).collect()}
    assert len(exact & relaxed) >= 0.9 * len(exact)


def labelled(spark, good, bad, label):
    rows = [(i, good(i) if i % 4 else bad(i)) for i in range(600)]
    docs = spark.createDataFrame(rows + [(600, None), (601, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0) if label == "quality" else int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (5, None)],
                                   f"doc_id long, {label} int")
    return docs, labels


WORDS = ["stone", "river", "garden", "window", "yellow", "morning", "paper", "under", "little", "again"]


def sentence(i):
    rng = random.Random(i)
    return (" ".join(rng.choices(WORDS, k=rng.randint(20, 80))) + ". ") * 2


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, sentence, lambda i: sentence(i) + " you IDIOT " + sentence(i + 1), "toxic")
    rows = toxicity.held_out_scores(docs, labels).collect()
    assert len(rows) == 602
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.held_out_scores(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.held_out_scores(docs, labels.where("false")).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, sentence, lambda i: sentence(i).upper().replace(" ", "!! "), "quality")
    rows = quality.held_out_scores(docs, labels).collect()
    assert len(rows) == 602
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in held) >= 0.98 * len(held)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert {r["doc_id"] for r in rows if r["predicted"]} == kept
    assert quality.held_out_scores(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in quality.held_out_scores(docs, labels.where("false")).collect()} == {0.5}


def test_isotonic_is_the_monotone_least_squares_fit():
    got = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 1, 1, 2, 1]))
    assert np.allclose(got, [0.1, 0.3, 0.3, 0.3, 0.9])


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    n, width = 4000, 0.18
    directions = rng.normal(0, np.sqrt(width), (quality.N_STATS, n))
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), directions, rng.uniform(0, 2 * np.pi, n),
                          np.zeros(n + 1), np.array([0.0]), np.array([0.5]))
    x = rng.normal(0, 0.3, (20, quality.N_STATS))
    z = model.map(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-width * distance / 2)).max() < 0.1


def test_keep_one_of_each_group(spark):
    rows = [(1, "a b c d"), (2, "A b c d"), (2, "A b c d"), (3, None), (4, ""), (None, "x y z"), (5, "x y z"), (6, "q r s t"), (6, "u v w")]
    docs = spark.createDataFrame([(k, t, "f") for k, t in rows], "doc_id long, text string, near_key string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == [-1, 1, 3, 6, 6]
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text_key", F.concat("lang", F.lit("clash")))
    odd = spark.createDataFrame([(None, None, None, None, None, "a"), (10**9, "", "en", "s", 0, None), (10**9, "", "en", "s", 0, None)], docs.schema)
    kept, counts = docs.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, SF)
        if name != "best-fit packing":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), docs.schema)
            counts.append(kept.count())
    assert counts[0] < docs.count() + 3 and counts[1] == counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    pieces = kept.collect()
    assert len({r["doc_id"] for r in pieces}) <= counts[3] and sum(r["piece"] == 0 for r in pieces) == counts[3]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert stage[1](spark, docs, SF).count() == 0


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
