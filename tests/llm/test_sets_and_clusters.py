"""Centroid clusters, n-gram Jaccard classes and the source divergence audit against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetaudit.llm import centroids, divergence, jaccard_join
from fleetaudit.llm.transducer import Transducer

SF = "/root/testdata/sf0.001"
RANDOM = random.Random(23)


# centroid clusters

def plain_clusters(rows, clusters=8, rounds=10, dims=64):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha) of rows (vec_id, vector)."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2 ** 53 else 1024 * int(x) for x in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    at = [list(c) for _, c, _ in sorted(kept, key=lambda r: (name(r[0]), r[2]))[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(at)), key=lambda k: (square(c, at[k]), k)) for _, c, _ in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for k, (_, c, _) in zip(assign(), kept):
            groups[k].append(c)
        for k, own in groups.items():
            at[k] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    far = [square(c, at[k]) for k, (_, c, _) in zip(of, kept)]
    long = lambda x: x if x < 2 ** 63 else None
    inertia = {k: sum(d for d, o in zip(far, of) if o == k) if all(long(d) is not None for d, o in zip(far, of) if o == k) else None for k in of}
    every = None if None in inertia.values() else long(sum(far))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    found = [(i, k, long(d), None if inertia[k] is None else long(inertia[k]), every, sha[k]) for (i, _, _), k, d in zip(kept, of, far)]
    return sorted(found, key=repr)


def clusters_of(spark, rows, **args):
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, key int")
    return sorted((tuple(r) for r in centroids.cluster(frame.repartition(3), **args).collect()), key=repr)


def vectors(n, dims=64, spread=0.2):
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(5, dims))
    return [(i, (middles[i % 5] * (i % 3 > 0) + rng.normal(scale=spread, size=dims)).tolist()) for i in range(n)]


def test_clusters_against_plain_rounds(spark):
    rows = vectors(160)
    assert clusters_of(spark, rows, rounds=4) == plain_clusters(rows, rounds=4)


def test_clusters_of_odd_rows(spark):
    rows = vectors(30) + [(3, vectors(30)[3][1]), (None, [0.5] * 64), (None, [0.5] * 64), (40, None), (41, []), (42, [1.0] * 63), (43, [1.0] * 63 + [None]),
                          (44, [1.0] * 63 + [float("nan")]), (45, [float("inf")] * 64), (46, [0.0] * 64), (47, [-0.0] * 64), (48, [1e-200] * 64), (49, [-1e-200] * 64)]
    assert clusters_of(spark, rows, rounds=4) == plain_clusters(rows, rounds=4)
    assert clusters_of(spark, []) == [] and clusters_of(spark, [(1, None)]) == []
    few = [(1, [0.25] * 64), (2, [0.75] * 64), (2, [0.75] * 64)]
    assert clusters_of(spark, few, rounds=2) == plain_clusters(few, rounds=2)


def test_clusters_beyond_long_integers(spark):
    rows = vectors(12) + [(100, [1e200] * 64), (101, [-1e200] * 64), (102, [1e6] * 64), (103, [3e5] * 63 + [0.3])]
    assert clusters_of(spark, rows, rounds=3) == plain_clusters(rows, rounds=3)


def test_intervals_decide_only_what_exact_distances_say():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 16)) * 0.1 + rng.integers(0, 3, size=(400, 1))
    points = centroids.integers(data, 1024)
    at = [points[i] for i in (0, 7, 50, 51)]
    exact = centroids.nearest(points, at)
    shares = []
    for bits in (2, 4, 8):
        edges = np.quantile(data, np.linspace(0, 1, 2 ** bits + 1), axis=0).T
        cells = centroids.Cells(edges, bits)
        cell = cells.decode(cells.encode(data), 16)
        decided = cells.nearest(cell, at, 1024)
        assert (decided[decided >= 0] == exact[decided >= 0]).all()
        shares.append((decided >= 0).mean())
    assert shares == sorted(shares) and shares[-1] > 0.2


# source divergence

def plain_divergence(rows, least=10, top=10):
    """Set of (lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs = [(t or "", x or "", s or "") for t, x, s in rows]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in docs]
    out = set()
    for lang in {x for _, x, _ in docs}:
        seen = Counter(w for (_, x, _), ws in zip(docs, words) if x == lang for w in set(ws))
        kept = sorted((w for w, n in seen.items() if n >= least), key=str.encode)
        counts = {s: Counter() for _, x, s in docs if x == lang}
        for (_, x, s), ws in zip(docs, words):
            if x == lang:
                counts[s].update(w for w in ws if seen[w] >= least)

        def shares(c):
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        whole = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p[s][w], whole[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > whole[w])
            out |= {(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(terms[:top], 1)}
    return out


def divergence_rows():
    words = ["Alpha", "beta", "GAMMA", "straße", "naïve", "日本語", "a", "ab", "abc", "b", "É", "é", "x" * 3000, "K", "ﬁ", "zz"]
    rows = []
    for i in range(260):
        text = " ".join(RANDOM.choices(words, weights=range(1, len(words) + 1), k=RANDOM.randrange(14)))
        rows.append((text + RANDOM.choice(["", "\n42, a-b_c'd", "\t beta beta"]), RANDOM.choice(["en", "de", None]), RANDOM.choice(["s1", "s2", "s3", "É", None])))
    return rows + [(None, "en", "empty"), ("", "xx", "s1"), ("once", "xx", "s2"), ("beta " * 50_000, "de", "long"), (None, None, None)] + rows[:40]


@pytest.mark.parametrize("args", [{}, {"shard_terms": 3, "wave_bytes": 1, "block": 2, "slice_terms": 2}])
def test_divergence_against_a_plain_version(spark, args):
    rows = divergence_rows()
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")
    got = divergence.divergence(frame.repartition(4), **args).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_divergence(rows)
    assert divergence.divergence(frame.where("false")).count() == 0


def test_transducer_ordinals_and_size():
    words = sorted({bytes(RANDOM.choices(b"abc\xc3\xa9", k=RANDOM.randrange(1, 9))) for _ in range(3000)})
    machine = Transducer.from_bytes(Transducer.build(words).to_bytes())
    asked = words + [w + b"a" for w in words] + [w[:-1] for w in words] + [b"", b"\xff", b"z" * 10_000]
    at = {w: i for i, w in enumerate(words)}
    assert machine.ordinals(asked).tolist() == [at.get(w, -1) for w in asked]
    # minimal: one state per set of continuations
    rest = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            rest[w[:i]].add(w[i:])
    assert len(machine.final) == len({frozenset(r) for r in rest.values()})
    empty = Transducer.from_bytes(Transducer.build([]).to_bytes())
    assert empty.ordinals([b"", b"a"]).tolist() == [-1, -1]


# n-gram Jaccard join

def plain_sets(rows, words=4):
    out = []
    for _, text in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set())
    return out


def plain_similar(rows, percent=85):
    """Sorted (doc_id, n_shingles, component_id) by all pairs."""
    sets = plain_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    name = lambda ks: min((k for k in ks if k is not None), default=None)
    return sorted(((k, len(sets[i]), name(least[find(i)])) for i, (k, _) in enumerate(rows)), key=repr)


def similar(spark, rows, **args):
    frame = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, n long, key long, `set` string")
    return sorted((tuple(r) for r in jaccard_join.similar_documents(frame.repartition(4), **args).collect()), key=repr)


def jaccard_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []

    def edited(text, share):
        return [rng.choice(words) if rng.random() < share else w for w in text]

    def put(text):
        rows.append((len(rows), " ".join(text)))

    for _ in range(25):  # families around the threshold, of every size
        text = rng.choices(words, k=rng.choice([1, 3, 4, 6, 9, 12, 20, 40, 90, 250]))
        for _ in range(rng.randrange(1, 8)):
            put(edited(text, rng.choice([0, 0.005, 0.01, 0.02, 0.04])))
            if rng.random() < 0.4:
                put(text[:-rng.randrange(1, 4)] or text)
            if rng.random() < 0.3:
                text = edited(text, 0.03)
    passage = rng.choices(words, k=70)
    for _ in range(90):  # a passage that unlike documents share, with some near copies among them
        own = rng.choices(words, k=rng.randrange(14, 40))
        put(own + passage)
        if rng.random() < 0.2:
            put(edited(own, 0.04) + passage)
    return rows + [(9000, None), (9001, ""), (9002, " \t\r\n"), (9003, None), (None, "A b C d E"), (9004, "a B c D e"), (9005, "a b c d e"),
                   (9006, "É b c d"), (9007, "é b c d"), (9008, "x " * 30_000), (9009, "y x " * 20_000), (3, rows[3][1]), (3, rows[3][1]), (None, None),
                   (9010, " ".join(rng.choices(words, k=12_000)))]


@pytest.mark.parametrize("seed, costly", [(1, 64), (2, 3)])
def test_similar_documents_against_all_pairs(spark, seed, costly):
    rows = jaccard_rows(seed)
    want = plain_similar(rows)
    assert len({c for _, _, c in want}) < len(rows) - 40
    assert similar(spark, rows, costly=costly) == want


def test_similar_documents_of_no_rows(spark):
    assert similar(spark, []) == []
    assert similar(spark, [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]


def test_bands_hold_all_partners_and_credits_cover_all_differences():
    for percent in (50, 80, 85, 99):
        scheme = jaccard_join.Scheme(percent)
        for s in range(1, 400):
            for r in range(s, s * 100 // percent + 1):
                bands = {band: need for _, band, need in scheme.roles(r)}
                assert scheme.band(s) in bands
                # the fewest common elements that still link
                both = -(-percent * (r + s) // (100 + percent))
                if both <= s:
                    assert r + s - 2 * both <= bands[scheme.band(s)] - 1 < scheme.segments(scheme.band(s))


def test_sketches_never_tell_more_differences_than_there_are():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 40), (200, 210), (1000, 100), (5000, 5000)):
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: m // 2], rng.integers(0, 2 ** 63, m).astype(np.uint64))))
        assert jaccard_join.sketch_difference(jaccard_join.odd_sketch(a), jaccard_join.odd_sketch(b)) <= len(np.setxor1d(a, b))
    assert jaccard_join.sketch_difference(jaccard_join.odd_sketch(a), jaccard_join.odd_sketch(a)) == 0


@pytest.mark.parametrize("costly", [0, 10 ** 9])
def test_credits_alone_find_every_link(spark, monkeypatch, costly):
    """Without the stars every link has to come from look-ups (10 ** 9) or look-ups and neighbourhoods (0)."""
    monkeypatch.setattr(jaccard_join, "_star", lambda shared: shared.where("false").select(*jaccard_join._pair("set", "leader")))
    rows = jaccard_rows(7)
    assert similar(spark, rows, costly=costly) == plain_similar(rows)
