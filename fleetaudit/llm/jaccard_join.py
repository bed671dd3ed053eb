"""N-gram Jaccard self-join by universe partition and pigeonhole, exact.

A document is the set of its distinct shingles. Two sets of sizes r >= s and likeness ``percent`` or more differ in at most
``H = (100 - percent) (r + s) / (100 + percent)`` shingles, and their sizes lie in one band or in two that follow each
other. A band deals the universe of shingles by hash into H + 1 segments and some to spare. A set is indexed under the
part it has in each segment of its band, and looks up its parts in its own band and in the one below.

* **Pigeonhole.** If a set grants every segment v = -1, 0 or 1 differences so that the v + 1 add up to H + 1, a partner
  differs by at most v in some segment: v = 0 asks for the same part, v = 1 also for the parts with one shingle deleted,
  its own and the partner's (one-deletion neighbourhoods), v = -1 asks nothing.
* **Allocation by cost.** A look-up that finds nobody costs nothing. First the sets under one part are compared with one of
  them, a star, and joined into components; what is left of the cost of a look-up are the sets of other components it
  finds. A set asks the cheapest look-ups it needs; where these are costly (parts made of passages that very many
  documents share), it weighs them against deletion neighbourhoods of its other segments.
* **Verification.** Every set has an odd sketch, the parity of its shingles in twice as many bits; the bits two sketches
  differ in never outnumber the shingles the sets differ in, so most unlike pairs go without their sets. The rest are
  compared exactly on their shingles, which texts are read again for. Only sets of different components are compared.

Shingles are named by 64-bit hashes, sets by one of these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, pieces, written
from .components import components, stars

OWN, BELOW = 0, 1
SHORT = 128  # bytes of the shortest sketch, which joins compare
COSTLY = 64  # look-ups that find more sets than this are weighed against deletion neighbourhoods
SMALL = 1_000_000  # rows of a few numbers that may be broadcast


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 600_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], words: int, known: Words) -> list[np.ndarray]:
    """Of every text the ascending distinct 64-bit hashes of its shingles: A-Z lowered, words between ASCII white space; fewer
    words make one shingle, none make none. The words of all texts are mixed together."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = sum(map(len, parts))
    own = np.fromiter((known[w] for p in parts for w in p), np.uint64, count)
    whole = _windows(own, words)
    out, at = [], 0
    for p in parts:
        n = len(p)
        out.append(np.unique(whole[at:at + n - words + 1]) if n >= words else _windows(own[at:at + n], n) if n else own[:0])
        at += n
    return out


def _windows(own: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(own) - width + 1), width, np.uint64)
    for i in range(width):
        out = mixed((out ^ own[i:i + len(out)]) + np.uint64(0x9E3779B97F4A7C15))
    return out


class Scheme:
    """Bands of sizes, their segments, and how many differences a set has to allow for."""

    def __init__(self, percent: int):
        self.percent = percent
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(lows[-1] * 100 // percent + 1)
        self.lows = np.array(lows)
        self.starts: dict[int, np.ndarray] = {}

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def top(self, band: int) -> int:
        return int(self.lows[band + 1]) - 1

    def differences(self, r: int, s: int) -> int:
        return (100 - self.percent) * (r + s) // (100 + self.percent)

    def segments(self, band: int) -> int:
        top = self.top(band)
        most = self.differences(top, top * 100 // self.percent)
        return most + 1 + (-(-(most + 1) // 16) if most else 0)

    def roles(self, n: int) -> list[tuple[int, int, int]]:
        """(role, band, credits needed) of the bands a set of size n asks in."""
        band = self.band(n)
        out = [(OWN, band, self.differences(n, n) + 1)]
        if band and self.percent * n <= 100 * self.top(band - 1):
            out.append((BELOW, band - 1, self.differences(n, self.top(band - 1)) + 1))
        return out

    def borders(self, elements: np.ndarray, band: int) -> np.ndarray:
        """Where the segments of ``band`` start in the ascending ``elements``: equal ranges of the hashes."""
        if band not in self.starts:
            count = self.segments(band)
            self.starts[band] = np.array([-(-(i << 64) // count) for i in range(count)], np.uint64)
        return np.append(np.searchsorted(elements, self.starts[band]), len(elements))

    def parts(self, sums: np.ndarray, borders: np.ndarray, band: int) -> np.ndarray:
        """The key of the part in every segment. ``sums`` are the running sums of the spread elements, from zero."""
        return mixed((sums[borders[1:]] - sums[borders[:-1]]) ^ _salt(band, len(borders) - 1)).view(np.int64)

    def shortened(self, spread: np.ndarray, sums: np.ndarray, borders: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every element its segment and the key of the part without it."""
        segment = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        whole = sums[borders[1:]] - sums[borders[:-1]]
        return segment, mixed((whole[segment] - spread) ^ _salt(band, len(borders) - 1)[segment]).view(np.int64)


def _salt(band: int, count: int) -> np.ndarray:
    return mixed(np.arange(count, dtype=np.uint64) + np.uint64((band + 1) << 40))


def _sums(spread: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))


def odd_sketch(elements: np.ndarray) -> bytes:
    size = max(8 * SHORT, 1 << (2 * len(elements) - 1).bit_length())
    parity = np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """At most the number of elements that are in one set only; the longer sketch is folded."""
    x, y = (np.frombuffer(s, np.uint64) for s in sorted((a, b), key=len))
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _set_id(elements: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(elements.tobytes()), "<i8")[0])


ENTRY = "key long, set long, role int, segment int, n long, doc_id long, text_key long, sketch binary"


def _entries(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """One row per document (key null: set, n, doc_id, text_key, sketch) and, once per task and set, one per part it asks
    for or is indexed under (key, set, role, segment)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        known = Words()
        for batch in pieces(batches, chars=2_000_000):
            infos, keys, sets, roles, segments = [], [], [], [], []
            for doc_id, text_key, elements in zip(batch["doc_id"].astype("Int64"), batch["text_key"], shingle_sets(list(batch["text"]), words, known)):
                name = _set_id(elements)
                infos.append((name, len(elements), doc_id, text_key, odd_sketch(elements) if len(elements) else None))
                if not len(elements) or name in done:
                    continue
                if len(done) >= 1_000_000:
                    done.clear()
                done.add(name)
                sums = _sums(mixed(elements))
                for role, band, _ in scheme.roles(len(elements)):
                    own = scheme.parts(sums, scheme.borders(elements, band), band)
                    keys.append(own)
                    sets.append(np.full(len(own), name))
                    roles.append(np.full(len(own), role, np.int32))
                    segments.append(np.arange(len(own), dtype=np.int32))
            info = pd.DataFrame(infos, columns=["set", "n", "doc_id", "text_key", "sketch"])
            yield info.assign(key=pd.array([None] * len(info), "Int64"), role=-1, segment=-1).astype({"doc_id": "Int64"})
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "set": np.concatenate(sets), "role": np.concatenate(roles),
                                    "segment": np.concatenate(segments)}).assign(
                    n=0, doc_id=pd.array([None], "Int64")[0], text_key=0, sketch=None).astype({"doc_id": "Int64"})

    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInPandas(run, ENTRY)


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose part some other set has too, with ``leader``, the least of its sets. Entries are sorted by part and
    stream through, so a part that very many sets have is never held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row, whose successor is not known yet
        last_key = last_leader = None  # the part before that row
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key, name = frame["key"].to_numpy(), frame["set"].to_numpy()
            fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
            frame, key, name = frame[fresh], key[fresh], name[fresh]
            held = frame.iloc[-1:]
            starts = np.append(True, key[1:] != key[:-1])
            leader = name[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))]
            in_last = key == last_key if last_key is not None else np.zeros(len(key), bool)
            leader = np.where(in_last, last_leader, leader)
            together = np.append(~starts[1:], False) | ~starts | in_last
            out = frame.assign(leader=leader)[:-1][together[:-1]]
            if len(key) > 1:
                last_key, last_leader = key[-2], leader[-2]
            if len(out):
                yield out
        if held is not None and last_key is not None and held["key"].iloc[0] == last_key:
            yield held.assign(leader=last_leader)

    return (entries.repartition("key").sortWithinPartitions("key", "set")
            .mapInPandas(run, "key long, set long, role int, segment int, leader long"))


def _star(shared: DataFrame) -> DataFrame:
    """(a, b): every set with the leader of each of its parts."""
    return shared.where("set <> leader").select(*_pair("set", "leader")).distinct()


def _sides(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``side`` (set, …) of both, ending in _a and _b."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("set").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in side.columns if c != "set")), end)
    return pairs


def _plausible(pairs: DataFrame, info: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave the likeness open."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [sketch_difference(x, y) <= scheme.differences(n, m)
                    for x, y, n, m in zip(batch["sketch_a"], batch["sketch_b"], batch["n_a"].tolist(), batch["n_b"].tolist())]
            yield batch.loc[keep, ["a", "b"]]

    fitting = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * scheme.percent
    return _sides(pairs, info).where(fitting).mapInPandas(run, "a long, b long")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _few(df: DataFrame) -> DataFrame:
    """``df`` (a written table of a few numbers a row), broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _texts(asked: DataFrame, docs: DataFrame, homes: DataFrame) -> DataFrame:
    """The text of every set asked for."""
    wanted = _few(written(asked.join(homes, "set").select(F.col("doc_id").alias("home"), "text_key"), "jaccard_wanted"))
    return (docs.withColumn("text_key", F.xxhash64("text")).join(wanted, "text_key")
            .where(F.col("home").eqNullSafe(F.col("doc_id"))).select("text"))


def _verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that link, by exact intersections of their shingles."""
    pairs = written(pairs, "jaccard_pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), docs, homes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in pieces(batches):
            found = shingle_sets(list(batch["text"]), words, known)
            yield pd.DataFrame({"set": [_set_id(e) for e in found], "elements": [e.tobytes() for e in found]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["elements_a"], batch["elements_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= scheme.percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    elements = written(texts.mapInPandas(cut, "set long, elements binary"), "jaccard_sets")
    return written(_sides(pairs, elements).mapInPandas(compare, "a long, b long").distinct(), "jaccard_links")


def _neighbourhoods(texts: DataFrame, words: int, scheme: Scheme, roles: int, keys: DataFrame | None = None) -> DataFrame:
    """(set, role, segment, key): the parts with one shingle deleted of every set, in its first ``roles`` roles; of these only
    the ``keys`` asked for, if any are. A short list of keys is looked up in the task."""
    few = keys is not None and keys.count() <= SMALL
    names = np.sort(np.array([r[0] for r in keys.select("key").distinct().collect()], np.int64)) if few else None
    names = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in pieces(batches, chars=1_000_000):
            out = []
            for elements in shingle_sets(list(batch["text"]), words, known):
                if not len(elements):
                    continue
                spread = mixed(elements)
                sums, name = _sums(spread), _set_id(elements)
                for role, band, _ in scheme.roles(len(elements))[:roles]:
                    segment, key = scheme.shortened(spread, sums, scheme.borders(elements, band), band)
                    if names.value is not None:
                        hit = _among(key, names.value)
                        segment, key = segment[hit], key[hit]
                    if len(key):
                        out.append(pd.DataFrame({"set": name, "role": role, "segment": segment, "key": key}))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = texts.mapInPandas(run, "set long, role int, segment int, key long")
    return found.distinct() if few or keys is None else found.join(keys.select("key").distinct(), "key", "left_semi").distinct()


def _among(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(values), bool)
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values


def _needs(info: DataFrame, scheme: Scheme) -> DataFrame:
    """set, role, spare: the segments of a band a set may leave out."""
    @F.pandas_udf("array<struct<role:int,spare:int>>")
    def spare(n: pd.Series) -> pd.Series:
        return n.map(lambda x: [(role, scheme.segments(band) - need) for role, band, need in scheme.roles(x)])

    return info.select("set", F.inline(spare("n")))


def _short(info: DataFrame) -> DataFrame:
    """set, size and its sketch folded to the shortest, as longs."""
    @F.pandas_udf("array<long>")
    def folded(sketch: pd.Series) -> pd.Series:
        return sketch.map(lambda s: np.bitwise_xor.reduce(np.frombuffer(s, np.int64).reshape(-1, SHORT // 8), axis=0))

    return written(info.select("set", F.col("n").alias("size"), folded("sketch").alias("short")), "jaccard_short")


def _look_ups(shared: DataFrame, roots: DataFrame, info: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries under parts of several components with their ``cost``; how many sets each such part is the index of; and the
    look-ups left to a set once it leaves out its ``spare`` dearest ones (a set leaves out none it does not have to)."""
    at = shared.join(roots, "set", "left").select("key", "set", "role", "segment", F.coalesce("root", "set").alias("root"))
    at = written(at, "jaccard_parts")
    indexed = F.count_if(F.col("role") == OWN)
    several = written(at.groupBy("key").agg(indexed.alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
                      .where("n > 0 and r0 <> r1").select("key", "n"), "jaccard_several")
    at = written(at.join(several, "key"), "jaccard_mixed")
    same = written(at.groupBy("key", "root").agg(indexed.alias("same")), "jaccard_same")
    costs = at.join(same, ["key", "root"]).withColumn("cost", F.col("n") - F.col("same")).drop("same", "n").where("cost > 0")
    costs = written(costs.join(_needs(info, scheme), ["set", "role"]), "jaccard_costs")
    dearest = Window.partitionBy("set", "role").orderBy(F.desc("cost"), "segment")
    asked = costs.withColumn("place", F.row_number().over(dearest)).where("place > spare")
    return costs, several, written(asked.select("key", "set", "role", "segment", "root", "cost", "spare"), "jaccard_asked")


def _remaining(entries: DataFrame, shared: DataFrame, roots: DataFrame, homes: DataFrame, docs: DataFrame, words: int,
               scheme: Scheme, costly: int) -> DataFrame:
    """(a, b): pairs that the look-ups of the allocation find between components, not yet verified."""
    costs, several, asked = _look_ups(shared, roots, homes, scheme)
    short = _short(homes)
    index = written(costs.where(F.col("role") == OWN).join(short, "set")
                    .select("key", F.col("set").alias("other"), F.col("root").alias("far"), F.col("size").alias("far_size"), F.col("short").alias("far_short")), "jaccard_index")
    differ = sum((F.bit_count(F.get("short", F.lit(i)).bitwiseXOR(F.get("far_short", F.lit(i)))) for i in range(SHORT // 8)), F.lit(0))
    likely = ((F.col("root") != F.col("far")) & (F.least("size", "far_size") * 100 >= F.greatest("size", "far_size") * scheme.percent)
              & (differ * (100 + scheme.percent) <= (F.col("size") + F.col("far_size")) * (100 - scheme.percent)))
    dear = written(asked.groupBy("set", "role").agg(F.sum("cost").alias("cost"), F.count("*").alias("deficit"))
                   .where(F.col("cost") > costly).select("set", "role", "deficit"), "jaccard_dear")

    def found(look_ups: DataFrame) -> DataFrame:
        asking = look_ups.select("key", "set", "root").join(short, "set").alias("asking")
        return asking.join(index, "key").where(likely).select(*_pair("set", "other"))

    if not dear.limit(1).count():
        return found(asked).distinct()
    plain = asked.join(dear.select("set", "role"), ["set", "role"], "left_anti")
    # items of one credit each: a look-up, or the neighbourhood of a segment whose own look-up is free
    near = written(_neighbourhoods(_texts(dear.select("set").distinct(), docs, homes), words, scheme, roles=2).join(dear.select("set", "role"), ["set", "role"], "left_semi")
                   .join(costs.select("set", "role", "segment"), ["set", "role", "segment"], "left_anti"), "jaccard_near")
    upgrade = (near.join(several, "key", "left").groupBy("set", "role", "segment")
               .agg((F.count("*") + F.coalesce(F.sum("n"), F.lit(0))).alias("cost")).withColumn("kind", F.lit(1)))
    look_up = costs.join(dear.select("set", "role"), ["set", "role"], "left_semi").select("set", "role", "segment", "cost", F.lit(0).alias("kind"))
    cheapest = Window.partitionBy("set", "role").orderBy("cost", "kind", "segment")
    chosen = look_up.unionByName(upgrade).withColumn("place", F.row_number().over(cheapest)).join(dear, ["set", "role"]).where("place <= deficit")
    chosen = written(chosen.select("set", "role", "segment", "kind"), "jaccard_chosen")
    place = ["set", "role", "segment"]
    again = costs.join(chosen.where("kind = 0").drop("kind"), place, "left_semi")
    grown = chosen.where("kind = 1").drop("kind")
    deleted = written(near.join(grown, place, "left_semi").select("key", "set"), "jaccard_deleted")
    whole = written(entries.where("key is not null").join(_few(grown), place, "left_semi").select("key", "set").distinct(), "jaccard_whole")
    # the own part with one shingle less, against whole parts of the index; the whole one, against neighbourhoods of the index
    against = entries.where(F.col("role") == OWN).select("key", F.col("set").alias("other"))
    shorter = against.join(_few(deleted), "key").select(*_pair("set", "other"))
    longer = _neighbourhoods(docs.select("text"), words, scheme, roles=1, keys=whole).select("key", F.col("set").alias("other")).join(whole, "key").select(*_pair("set", "other"))
    across = shorter.unionByName(longer).where("a <> b").distinct()
    for end in ("a", "b"):
        across = across.join(roots.select(F.col("set").alias(end), F.col("root").alias(f"r_{end}")), end, "left").withColumn(f"r_{end}", F.coalesce(f"r_{end}", end))
    return found(plain).unionByName(found(again)).unionByName(across.where("r_a <> r_b").select("a", "b")).distinct()


def similar_documents(docs: DataFrame, words: int = 4, percent: int = 85, costly: int = COSTLY, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (distinct shingles) and component_id, the smallest id reachable over links, per row. Documents link
    if ``100 * intersection >= percent * union``.

    A null, empty or blank text has no shingle and links with nothing, not even its like. Repeated rows stay rows; a null
    id names a component only if it has no other. Other columns are never read."""
    scheme, docs = Scheme(percent), documents(docs, id_col, text_col)
    entries = written(_entries(docs, words, scheme), "jaccard_entries")
    rows = entries.where("key is null").select("doc_id", "set", "n", "text_key", "sketch")
    filled = rows.where("n > 0")
    homes = written(filled.groupBy("set").agg(F.min(F.struct("doc_id", "text_key")).alias("home"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
                    .select("set", "home.doc_id", "home.text_key", "n", "sketch"), "jaccard_homes")
    info = homes.select("set", "n", "sketch")
    shared = written(_shared(entries.where("key is not null").select("key", "set", "role", "segment")), "jaccard_shared")
    star = written(_plausible(_star(shared), info, scheme), "jaccard_star")
    # one pair a set first: most others then lie within a component
    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(first, docs, homes, words, scheme)
    roots = written(stars(links).select(F.col("node").alias("set"), "root"), "jaccard_roots")
    across = star.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        across = across.join(roots.select(F.col("set").alias(end), F.col("root").alias(f"r_{end}")), end, "left").withColumn(f"r_{end}", F.coalesce(f"r_{end}", end))
    rest = _plausible(_remaining(entries, shared, roots, homes, docs, words, scheme, costly), info, scheme)
    rest = rest.unionByName(across.where("r_a <> r_b").select("a", "b")).distinct()
    links = links.unionByName(_verified(rest, docs, homes, words, scheme))
    least = filled.groupBy("set").agg(F.min("doc_id").alias("least"))
    grouped = components(links, least.withColumnRenamed("set", "node")).select(F.col("node").alias("set"), "least")
    named = rows.where("n > 0").join(written(grouped, "jaccard_components"), "set").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return named.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
