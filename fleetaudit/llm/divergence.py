"""Source divergence audit: how far the word use of each (lang, source) group is from that of the other sources and of
its language.

The vocabulary of a language, its terms in at least ``least`` documents, is a minimal acyclic transducer with
lexicographic ordinals, built from the sorted terms in shards of consecutive ranges. The texts then stream through it for
the recount: a task counts the words of its rows, and the distinct ones run through the transducer, all a byte at a time.
Shards travel to the tasks in waves of bounded size; a vocabulary beyond one wave takes further passes over the texts.

All arithmetic is on integers. With count the occurrences of a kept term in a group, N their sum and V the kept terms,
``p = 1 + floor(1e9 * (count + 2) / (N + 2 V))`` and ``f(p, q) = floor((p - q)^2 / (p + q))``.

Two sources of a language are compared in cells of two blocks of sources and a slice of ordinals, as in a blocked matrix
product: no task sees a whole language. Terms that neither uses are counted, not listed."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written
from .transducer import Transducer

SCALE = 1_000_000_000
# bytes of terms, A-Z lowered; every other byte is a space
_TERMS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, only A-Z lowered, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _term_documents(rows: DataFrame, held: int = 400_000) -> DataFrame:
    """lang, term (binary) and docs, the number of rows with it. A task adds up before the shuffle and hands on whenever it
    holds ``held`` terms."""
    def flush(seen: dict[str, Counter]) -> pd.DataFrame:
        out = [(lang, term, n) for lang, counts in seen.items() for term, n in counts.items()]
        seen.clear()
        return pd.DataFrame(out, columns=["lang", "term", "docs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                seen.setdefault(lang, Counter()).update(set(terms(text)))
                if sum(map(len, seen.values())) >= held:
                    yield flush(seen)
        yield flush(seen)

    counts = rows.select("lang", "text").mapInPandas(run, "lang string, term binary, docs long")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, least: int = 10, shard_terms: int = 100_000) -> DataFrame:
    """shard, lang, first (least term), n, automaton: the transducers of every language's terms in at least ``least`` rows,
    one per run of at most ``shard_terms`` consecutive terms."""
    kept = _term_documents(_rows(docs)).where(F.col("docs") >= least).select("lang", "term")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, held = None, []

        def shard() -> pd.DataFrame:
            row = pd.DataFrame({"lang": [lang], "first": [held[0]], "n": [len(held)], "automaton": [Transducer.build(held).to_bytes()]})
            held.clear()
            return row

        for batch in batches:
            for of, term in zip(batch["lang"], map(bytes, batch["term"])):
                if held and (of != lang or len(held) == shard_terms):
                    yield shard()
                lang = of
                held.append(term)
        if held:
            yield shard()

    shards = (kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
              .mapInPandas(run, "lang string, first binary, n long, automaton binary"))
    return written(shards.withColumn("shard", F.monotonically_increasing_id()), "vocabulary")


def _waves(shards: DataFrame, wave_bytes: int) -> list[dict[int, int]]:
    """Shard numbers with their base (the terms of their language before them), in groups whose automata have at most
    ``wave_bytes`` together, or of one shard. The driver sees a short row per shard."""
    waves, size, of, base = [{}], 0, None, 0
    for r in shards.select("shard", "lang", "n", F.octet_length("automaton").alias("size")).orderBy("lang", "first").collect():
        if waves[-1] and size + r["size"] > wave_bytes:
            waves.append({})
            size = 0
        of, base = r["lang"], base if r["lang"] == of else 0
        waves[-1][r["shard"]] = base
        base, size = base + r["n"], size + r["size"]
    return waves


def _recounted(rows: DataFrame, machines: list[tuple[str, bytes, int, bytes]], held: int) -> DataFrame:
    """``recount`` over the terms of some shards (lang, first, base, automaton), ordered by lang and first, and not yet
    added up over the tasks."""
    bundle = rows.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict[str, list[tuple]] = {}
        for lang, first, base, data in bundle.value:
            shards.setdefault(lang, []).append((first, base, Transducer.from_bytes(data)))
        seen: dict[tuple[str, str], Counter] = {}

        def flush() -> pd.DataFrame:
            out: list[tuple] = []
            for (lang, source), counts in seen.items():
                out.append((lang, source, None, None, 0))
                words, own = sorted(counts), shards.get(lang, [])
                cuts = [bisect_left(words, first) for first, _, _ in own] + [len(words)]
                for (_, base, machine), lo, hi in zip(own, cuts, cuts[1:]):
                    ordinals = machine.ordinals(words[lo:hi])
                    out.extend((lang, source, base + o, w, counts[w]) for o, w in zip(ordinals.tolist(), words[lo:hi]) if o >= 0)
            seen.clear()
            return pd.DataFrame(out, columns=["lang", "source", "ordinal", "term", "n"]).astype({"ordinal": "Int64", "n": "int64"})

        size = 0
        for batch in pieces(batches):
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                counts = seen.setdefault((lang, source), Counter())
                size -= len(counts)
                counts.update(terms(text))
                size += len(counts)
                if size >= held:
                    yield flush()
                    size = 0
        yield flush()

    return rows.mapInPandas(run, "lang string, source string, ordinal long, term binary, n long")


def recount(docs: DataFrame, shards: DataFrame, wave_bytes: int = 1 << 25, held: int = 400_000) -> DataFrame:
    """lang, source, ordinal, term, n: the occurrences of kept terms in every group, by streaming the texts through the
    transducers; and a row of null ordinal and term and n zero for every group that occurs."""
    found = None
    for bases in _waves(shards, wave_bytes):
        own = shards.where(F.col("shard").isin(list(bases))).orderBy("lang", "first").collect()
        some = _recounted(_rows(docs), [(r["lang"], bytes(r["first"]), bases[r["shard"]], bytes(r["automaton"])) for r in own], held)
        found = some if found is None else found.unionByName(some)
    return found.groupBy("lang", "source", "ordinal", "term").agg(F.sum("n").alias("n"))


def _p(count: str, total: str = "total", kept: str = "kept") -> Column:
    """Exact in decimals, as the product may pass a long. Null where there is no kept term."""
    return F.expr(f"1 + (cast({count} as decimal(19, 0)) + 2) * cast({SCALE} as decimal(10, 0)) div nullif({total} + 2 * {kept}, 0)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _cells(groups: DataFrame, counts: DataFrame, block: int, slice_terms: int) -> DataFrame:
    """Rows (source, ordinal, p) of every cell (lang, i, j, slice); null ordinals carry the p of absent terms."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"),
                                       F.ceil(F.first("kept") / slice_terms).cast("int").alias("slices")).where("slices > 0")
    sizes = written(sizes, "divergence_sizes")
    own = F.pmod(F.xxhash64("source"), "blocks").cast("int")
    absent = (groups.join(sizes, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
              .select("lang", "source", "slice", "blocks", F.lit(None).cast("long").alias("ordinal"), F.col("p0").alias("p")))
    listed = counts.join(sizes, "lang").select("lang", "source", F.pmod("ordinal", F.col("slices")).cast("int").alias("slice"), "blocks", "ordinal", "p")
    rows = absent.unionByName(listed).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "slice", "own", "source", "ordinal", "p")


def _cell_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """source, other, value (f summed over the terms some source of the cell has) and seen, the number of these."""
    lang, i, j, _ = key
    absent = rows[rows["ordinal"].isna()].sort_values(["own", "source"])
    listed = rows[rows["ordinal"].notna()]
    names = pd.Index(absent["source"])
    at, ordinals = pd.factorize(listed["ordinal"])
    p = np.repeat(absent["p"].to_numpy(np.int64)[:, None], len(ordinals), axis=1)
    p[names.get_indexer(listed["source"]), at] = listed["p"].to_numpy(np.int64)
    first = int((absent["own"] == i).sum())
    out = []
    for a in range(first if i != j else len(names) - 1):
        lo = first if i != j else a + 1
        d, s = p[lo:] - p[a], p[lo:] + p[a]
        out.append(pd.DataFrame({"source": names[a], "other": names[lo:], "value": (d * d // s).sum(axis=1)}))
    if not out:
        return pd.DataFrame(columns=["lang", "source", "other", "value", "seen"])
    return pd.concat(out, ignore_index=True).assign(lang=lang, seen=len(ordinals))[["lang", "source", "other", "value", "seen"]]


def divergence(docs: DataFrame, least: int = 10, top: int = 10, shard_terms: int = 100_000, wave_bytes: int = 1 << 25,
               block: int = 256, slice_terms: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language, value f summed over all
    kept terms (zero without any). Part ``term``: the ``top`` kept terms of a group that it has and uses more than its
    language. Rank 1 is the largest value, ties to the smaller item in UTF-8.

    Null text, lang and source are empty; every row is a document, equal ones too; other columns are never read."""
    shards = vocabulary(docs, least, shard_terms)
    found = written(recount(docs, shards, wave_bytes), "divergence_counts")
    kept = shards.groupBy("lang").agg(F.sum("n").alias("kept"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(kept, "lang", "left").fillna(0, ["kept"])
    groups = written(totals.withColumn("p0", _p("0")), "divergence_groups")
    listed = found.where("ordinal is not null")
    counts = written(listed.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", "term", _p("n").alias("p")), "divergence_p")

    cells = _cells(groups, counts, block, slice_terms)
    sums = (cells.groupBy("lang", "i", "j", "slice").applyInPandas(_cell_sums, "lang string, source string, other string, value long, seen long")
            .groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    both = sums.select("lang", "source", "other", "value", "seen").unionByName(
        sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value", "seen"))
    # every pair of a language without kept terms is listed too, with zero
    left, right = (groups.select("lang", F.col("source").alias(n), "kept", F.col("p0").alias(p)) for n, p in (("source", "p"), ("other", "q")))
    bare = left.where("kept = 0").join(right.drop("kept"), "lang").where("source <> other").select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    pairs = (both.join(left, ["lang", "source"]).join(right.drop("kept"), ["lang", "other"])
             .select("lang", "source", "other", (F.col("value") + (F.col("kept") - F.col("seen")) * _f("p", "q")).alias("value")).unionByName(bare))

    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("kept").alias("kept"))
    whole = listed.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(langs, "lang").select("lang", "ordinal", _p("n").alias("q"))
    more = counts.join(whole, ["lang", "ordinal"]).where("p > q").withColumn("value", _f("p", "q"))
    own = Window.partitionBy("lang", "source")
    ranked = more.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    return (pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value",
                         F.row_number().over(own.orderBy(F.desc("value"), "other")).alias("rank"))
            .unionByName(ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")))


# the same rows in plain SQL
SQL = """
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
           from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as materialized (select lang, term from w group by lang, term having count(distinct rid) >= 10),
c as materialized (select w.lang, w.source, w.term, count(*) as n from w join kept on kept.lang = w.lang and kept.term = w.term group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as kept from kept group by lang),
gn as materialized (select g.lang, g.source, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0)::hugeint as total,
              coalesce(v.kept, 0)::hugeint as kept from g left join v on v.lang = g.lang),
p as materialized (select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * gn.kept) as p
      from gn join kept on kept.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
ln as (select lang, sum(total) as total, any_value(kept) as kept from gn group by lang),
q as materialized (select kept.lang, kept.term, 1 + (1000000000::hugeint * (coalesce(s.n, 0) + 2)) // (ln.total + 2 * ln.kept) as q
      from kept join ln on ln.lang = kept.lang left join (select lang, term, sum(n) as n from c group by lang, term) s on s.lang = kept.lang and s.term = kept.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
         from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
          from gn a join gn b on a.lang = b.lang and a.source <> b.source
          left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
more as (select p.lang, p.source, p.term as item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) as value
         from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
terms as (select *, row_number() over (partition by lang, source order by value desc, item) as rank from more)
select lang, source, 'pair' as part, item, value::bigint as value,
       (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select lang, source, 'term', item, value::bigint, rank::int from terms where rank <= 10
"""
