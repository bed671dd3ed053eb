"""Personal data by weak supervision, on DataFrame functions only.

Patterns propose spans of four kinds: the strict forms (the base, which always stays) and looser ones (spelled-out mail
addresses, long hexadecimal addresses, card-length numbers that fail their checksum, phone numbers without a country
code). Labelers vote yes, no or nothing on every proposal: the strict pattern, validity (checksums, ranges, lengths), a
gazetteer (top-level domains, issuer prefixes, calling codes), the words in front, and the characters on either side.
Expectation-maximisation over the vote patterns estimates how reliable each labeler is, without labels; a naive Bayes
classifier over features of the span is then fitted to its posteriors and decides on the loose proposals.

Proposals stay in an array of their document's row, so nothing is shuffled but counts. What reaches the driver is bounded
by the number of vote patterns (4 x 3^5) and of feature values (4 x 7 x 8). Every pattern runs in time linear in the text:
repetitions are possessive or bounded, and start where a run of their characters starts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "valid", "gazetteer", "context", "border")
N_FEATURES, N_VALUES = 8, 8

_MAIL = "A-Za-z0-9._%+-"
# Matches as the plain form would: a match starts at the start of a run of its first characters, or where the last ended.
STRICT = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{_MAIL}])[{_MAIL}]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9.+-])(?<!\+[0-9]{1,3}[ .-]{0,2})(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "ch", "at", "be",
           "us", "ca", "au", "jp", "cn", "in", "br", "mx", "ru", "pl", "se", "no", "dk", "fi", "pt", "biz", "me", "dev", "app")
CALLING = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|35|37|38|42|50|59|67|85|88|96|97|99)"
ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6(?:011|5[0-9]{2})[0-9]{12})$"
WORDS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|connected|login|logged)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|cvv|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|sms|whatsapp)\b",
}
WORDS_AGAINST = r"(?i)\b(?:version|v|release|order|invoice|isbn|issn|id|token|sha|hash|build|chapter|section|figure|table|serial|ref)\b"


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _before_each(lengths: Column) -> Column:
    """For every place the sum of the lengths before it. Sums run over blocks of about the square root of their number,
    so a text of very many matches stays cheap."""
    def summed(lens: Column) -> Column:
        n = F.size(lens)
        block = F.ceil(F.sqrt(n)).cast("int")

        def within(totals: Column) -> Column:
            starts = F.transform(totals, lambda _, b: _sum(F.slice(totals, 1, b)))
            return _let(starts, lambda heads: F.transform(lens, lambda _, i: F.get(heads, F.floor(i / block).cast("int")) + _sum(
                F.slice(lens, F.floor(i / block).cast("int") * block + 1, i % block))))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: _sum(F.slice(lens, b * block + 1, block)))
        return _let(blocks, within)

    return _let(lengths, summed)


def _matches(text: Column, pattern: str) -> Column:
    """start, end (code points), m, before (up to 40 characters in front) and after (the next one) of every match."""
    def located(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            before = _before_each(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
            return F.zip_with(before, F.sequence(F.lit(0), F.size(found) - 1), lambda at, i: _let(at + F.length(F.get(gaps, i)), lambda s: F.struct(
                s.alias("start"), (s + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("m"),
                F.right(F.get(gaps, i), F.lit(40)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))))

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), placed))

    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return F.coalesce(_let(F.regexp_extract_all(text, F.lit(pattern), 0), located), none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + _let(
        F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 0, d).otherwise(
            F.when(d > 4, d * 2 - 9).otherwise(d * 2))))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: F.when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255))


def _vote(yes: Column, no: Column) -> Column:
    """2 for yes, 1 for no, 0 for nothing."""
    return F.when(yes, 2).when(no, 1).otherwise(0)


def _votes(kind: str, base: Column, m: Column, before: Column, after: Column) -> list[Column]:
    never, digits = F.lit(False), _digits(m)
    if kind == "email":
        last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        valid, listed, unlisted = last.rlike("^[a-z]{2,}$"), last.isin(*DOMAINS), last.rlike("[0-9]")
    elif kind == "ip":
        valid = F.when(m.contains(":"), True).otherwise(_octets(m))
        listed, unlisted = m.rlike(r"^(?:10|127|172|192)\."), m.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\.")
    elif kind == "card":
        valid, listed = _luhn(digits), digits.rlike(ISSUERS)
        unlisted = ~listed
    else:
        valid = F.length(digits).between(9, 15)
        listed, unlisted = m.startswith("+") & m.rlike(CALLING), m.startswith("+0")
    front = F.substring(before, -1, 1)
    clear = ~front.rlike(r"[\p{L}\p{N}]") & ~after.rlike(r"[\p{L}\p{N}]")
    return [_vote(base, never), _vote(valid, ~valid), _vote(listed, unlisted),
            _vote(before.rlike(WORDS_FOR[kind]), before.rlike(WORDS_AGAINST)), _vote(clear, ~clear)]


def _features(base: Column, m: Column, before: Column, after: Column, votes: Column) -> list[Column]:
    """Small integers below ``N_VALUES``."""
    digits = F.length(_digits(m))

    def border(c: Column) -> Column:
        return (F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"\p{N}"), 3)
                .when(c.isin(*"\"'`"), 4).when(c.isin(*".,;:!?"), 5).otherwise(6))

    marks = sum((F.when(m.contains(c), 1 << i).otherwise(0) for i, c in enumerate(" -.")), F.lit(0))
    return [F.when(base, 1).otherwise(0), F.get(votes, F.lit(1)), F.get(votes, F.lit(2)), F.get(votes, F.lit(3)),
            F.least(F.floor(digits / 3).cast("int"), F.lit(7)), marks, border(F.substring(before, -1, 1)), border(after)]


def _proposals(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, base, code, features) of one kind, by start. ``code`` numbers the vote pattern."""
    at = KINDS.index(kind)

    def judged(match: Column, base: Column) -> Column:
        m, before, after = match["m"], match["before"], match["after"]
        votes = F.array(*_votes(kind, base, m, before, after))
        return _let(votes, lambda v: F.struct(
            F.lit(at).alias("kind"), match["start"].alias("start"), match["end"].alias("end"), base.alias("base"),
            F.aggregate(v, F.lit(0), lambda a, x: a * 3 + x).alias("code"),
            F.array(*_features(base, m, before, after, v)).alias("features")))

    def strict(match: Column) -> Column:
        m = match["m"]
        return {"email": F.lit(True), "ip": _octets(m), "card": _luhn(_digits(m)),
                "phone": F.length(_digits(m)).between(9, 15)}[kind]

    found = _matches(text, STRICT[kind])
    own = F.transform(found, lambda x: _let(strict(x), lambda b: judged(x, b)))
    if kind in ("ip", "phone"):
        own = F.filter(own, lambda x: x["base"])  # a strict form that fails its check is no proposal of the loose one
    if kind in LOOSE:
        own = F.concat(own, F.transform(_matches(text, LOOSE[kind]), lambda x: judged(x, F.lit(False))))
    return F.array_sort(own, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(
        F.signum(a["end"] - b["end"]).cast("int")))


def proposals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``found``: the proposals of its whole text (null: empty), by kind, then start."""
    found = fresh(docs, "found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(found, _let(text, lambda t: F.concat(*(_proposals(k, t) for k in KINDS)))).drop(text_col)


@dataclass
class Model:
    """Of every kind the log-odds of a span: a bias and the weight of each feature's value."""

    bias: list[float]
    weight: list[list[list[float]]]
    reliability: dict[tuple[str, str], tuple[float, float]]  # (kind, labeler): P(yes | true), P(yes | false)

    def odds(self, span: Column) -> Column:
        table = F.array(*(F.lit(float(w)) for kind in self.weight for f in kind for w in f))
        bias = F.array(*(F.lit(float(b)) for b in self.bias))
        base = span["kind"] * (N_FEATURES * N_VALUES)
        return F.get(bias, span["kind"]) + F.aggregate(
            F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), F.lit(0.0),
            lambda a, f: a + F.get(table, base + f * N_VALUES + F.get(span["features"], f)))


def estimate(patterns: list[tuple[int, int, int]], rounds: int = 40) -> tuple[dict[tuple[int, int], float], dict]:
    """Expectation-maximisation over (kind, vote pattern, count): the posterior of every pattern, and of every labeler the
    rates at which it says yes to true and to false spans when it says anything. Rates start from the belief that
    labelers are mostly right and keep a weak pull towards it, so the classes can't change places."""
    posterior: dict[tuple[int, int], float] = {}
    rates: dict[tuple[str, str], tuple[float, float]] = {}
    places = range(len(LABELERS))
    for kind in range(len(KINDS)):
        rows = [(code, n, [code // 3 ** (len(LABELERS) - 1 - j) % 3 for j in places]) for k, code, n in patterns if k == kind]
        if not rows:
            continue
        prior, yes = 0.5, [(0.8, 0.2)] * len(LABELERS)
        belief: dict[int, float] = {}
        for _ in range(rounds):
            for code, _, votes in rows:
                odds = log(prior / (1 - prior))
                for j, v in enumerate(votes):
                    if v:
                        p, q = yes[j]
                        odds += log(p / q) if v == 2 else log((1 - p) / (1 - q))
                belief[code] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
            total = sum(n for _, n, _ in rows)
            prior = (sum(n * belief[c] for c, n, _ in rows) + 1) / (total + 2)
            pull = 1 + 0.02 * total
            yes = [tuple(
                (sum(n * w(belief[c]) for c, n, v in rows if v[j] == 2) + pull * start)
                / (sum(n * w(belief[c]) for c, n, v in rows if v[j]) + pull)
                for w, start in ((lambda b: b, 0.8), (lambda b: 1 - b, 0.2))) for j in places]
        posterior |= {(kind, c): b for c, b in belief.items()}
        rates |= {(KINDS[kind], LABELERS[j]): yes[j] for j in places}
    return posterior, rates


def train(found: DataFrame, column: str = "found") -> Model:
    """Reliabilities from the votes of all proposals, then the span classifier from their posteriors."""
    spans = found.select(F.explode(column).alias("s"))
    counted = spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.code").alias("code")).agg(F.count("*").alias("n")).collect()
    posterior, rates = estimate([(r["kind"], r["code"], r["n"]) for r in counted])
    size = 3 ** len(LABELERS)
    table = F.array(*(F.lit(float(posterior.get((k, c), 0.5))) for k in range(len(KINDS)) for c in range(size)))
    belief = F.get(table, F.col("s.kind") * size + F.col("s.code"))
    sums = (spans.select("s", belief.alias("p"), F.posexplode("s.features").alias("feature", "value"))
            .groupBy(F.col("s.kind").alias("kind"), "feature", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
            .collect())
    yes = [[[0.0] * N_VALUES for _ in range(N_FEATURES)] for _ in KINDS]
    no = [[[0.0] * N_VALUES for _ in range(N_FEATURES)] for _ in KINDS]
    for r in sums:
        yes[r["kind"]][r["feature"]][r["value"]], no[r["kind"]][r["feature"]][r["value"]] = r["yes"], r["no"]
    bias, weight = [], []
    for k in range(len(KINDS)):
        n1, n0 = sum(yes[k][0]), sum(no[k][0])
        bias.append(log((n1 + 1) / (n0 + 1)))
        weight.append([[log((yes[k][f][v] + 0.5) / (n1 + 0.5 * N_VALUES)) - log((no[k][f][v] + 0.5) / (n0 + 0.5 * N_VALUES))
                        for v in range(N_VALUES)] for f in range(N_FEATURES)])
    return Model(bias, weight, rates)


def kept(found: Column, model: Model) -> Column:
    """The spans that stay: every base span, and the proposals the classifier takes that touch no span of their kind
    before them."""
    taken = F.filter(found, lambda s: s["base"] | (model.odds(s) > 0))

    def first(s: Column, o: Column) -> Column:
        return (o["kind"] == s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]) & (
            o["base"] | (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["end"] < s["end"])))

    return _let(taken, lambda t: F.filter(t, lambda s: s["base"] | ~F.exists(t, lambda o: first(s, o))))


def _written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256, spans (kind:start:end, all that stay, by kind,
    then start), n_added. A null or empty text has none; repeated rows give equal rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(proposals(rows), "personal_data")
    model = train(found)
    spans = found.select("doc_id", F.filter("found", lambda s: s["base"]).alias("base"), kept(F.col("found"), model).alias("spans"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(count, range(len(KINDS)))
    return spans.select("doc_id", *counts, F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"),
                        _written_out(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span that stays replaced by its kind in brackets; overlapping spans become the kind of the
    first. All columns and rows stay; a null text stays null."""
    found = fresh(docs, "found_spans")
    model = train(written(proposals(docs.select(F.col(text_col).alias("text"))), "personal_data"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = _let(text, lambda t: kept(F.concat(*(_proposals(k, t) for k in KINDS)), model))
    rows = docs.withColumn(found, spans)

    def masked(spans: Column) -> Column:
        # reach: where the text masked so far ends
        ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(
            F.signum(b["end"] - a["end"]).cast("int")))
        names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

        def step(a: Column, s: Column) -> Column:
            between = F.substring(text_col, a["reach"] + 1, s["start"] - a["reach"])
            fresh_part = F.concat(between, F.get(names, s["kind"]))
            return F.when(s["start"] >= a["reach"], F.struct(F.concat(a["parts"], F.array(fresh_part)).alias("parts"), s["end"].alias("reach"))
                          ).otherwise(F.struct(a["parts"].alias("parts"), F.greatest(a["reach"], s["end"]).alias("reach")))

        start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("reach"))
        rest = F.col(text_col)
        return F.aggregate(ordered, start, step, lambda a: F.concat(
            F.array_join(a["parts"], ""), F.substring(rest, a["reach"] + 1, F.length(rest))))

    return rows.withColumn(text_col, F.when(F.size(found) > 0, masked(F.col(found))).otherwise(F.col(text_col))).drop(found)
