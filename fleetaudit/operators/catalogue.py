"""Schema catalogues and migrations.

``columns``: (repo keys, model, tbl, col, type, nullable, pk, is_unique, fk_tbl, fk_col, on_delete, orm, file, line).
``indexes``: (repo keys, tbl, idx_seq, cols array, is_unique). ``relations``: (repo keys, model, name, target,
back_populates, kind, uselist, secondary, explicit_join, line, file). ``ops``: (repo keys, tool, mig_seq, op_seq, kind,
tbl, col, detail map, file, line, downgrade). ``dialects``: (repo keys, dialect).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import _c
from ..functions.text import snake
from . import REPO

# Type families, name patterns and limits.
FAMILIES = [
    ("int64", r"^(?:big\w*|int8|bigserial)\b|^bigautofield|^positivebigintegerfield"),
    ("int16", r"^(?:small\w*|int2|tinyint|smallserial)\b|^positivesmallintegerfield"),
    ("int32", r"^(?:int|integer|int4|serial|mediumint|autofield|integerfield|positiveintegerfield)\b"),
    ("uuid", r"uuid"),
    ("objectid", r"objectid"),
    ("string", r"^(?:str|string|varchar|char|text|nvarchar|nchar|unicode\w*|citext|character|charfield|textfield|"
               r"emailfield|slugfield|urlfield|enum)\b"),
    ("bool", r"^(?:bool|boolean|booleanfield|nullbooleanfield)\b"),
    ("number", r"^(?:numeric|decimal|float|double|real|money|number|decimalfield|floatfield)\b"),
    ("datetime", r"^(?:date|time|timestamp|datetime|interval)"),
    ("json", r"json"),
]
INT_FAMILIES = ["int16", "int32", "int64"]
FLOAT_TYPE = r"(?i)\b(?:float|real|double|double_precision|floatfield)\b"
MONEY_WORDS = ["price", "prices", "amount", "cost", "costs", "total", "subtotal", "balance", "fee", "fees", "salary",
               "wage", "payment", "revenue", "tax", "discount", "charge", "refund", "budget", "money", "usd", "eur"]
NOT_MONEY_WORDS = ["rate", "ratio", "percent", "percentage", "pct", "count", "weight", "score", "factor"]
NATURAL_KEY = r"(?i)^(?:email|e_mail|username|user_name|login|slug|sku|handle)$"
PERSON_MODEL = r"(?i)^\w*(?:user|account|member|customer|person|profile|admin|staff|employee|subscriber)s?$"
LOG_MODEL = r"(?i)audit|log$|logs$|event|history|activity|snapshot|archive|outbox|journal|trail"
SNAPSHOT_MODEL = (r"(?i)order|invoice|receipt|payment|transaction|shipment|line_?item|booking|reservation|audit|log|"
                  r"history|event|snapshot|archive|ledger|quote|contract|statement|charge|refund")
EXTERNAL_PREFIX = (r"(?i)^(?:external|stripe|paypal|github|gitlab|google|apple|facebook|twitter|slack|provider|remote|"
                   r"session|request|trace|correlation|idempotency|transaction|message|object|entity|resource|client|"
                   r"device|installation|tenant_external)$")
REFERENCE_MODEL = (
    r"(?i)^(?:countr(?:y|ies)|currenc(?:y|ies)|languages?|locales?|time_?zones?|roles?|permissions?|settings?|"
    r"config(?:uration)?s?|feature_?flags?|features?|plans?|regions?|provinces?|states?|statuses|status|units?|"
    r"\w*types?|\w*kinds?|\w*categor(?:y|ies)|\w*choices?|\w*enums?)$")
# End of fixed values


def type_family(col) -> Column:
    """Comparable family of a SQL or ORM type name; empty when unknown."""
    t = F.lower(F.trim(F.coalesce(_c(col), F.lit(""))))
    t = F.regexp_replace(t, r"^(?:(?:db|sa|sqlalchemy|types|models|postgresql|mysql|sqlite|pg|dialects)\.)++", "")
    t = F.regexp_replace(t, r"^mapped\[(?:optional\[)?|\]+$", "")
    out = F.substring_index(t, "(", 1)
    for family, pattern in reversed(FAMILIES):
        out = F.when(t.rlike(pattern), F.lit(family)).otherwise(out)
    return F.when(t.isin("", "fk", "auto"), "").otherwise(out)


def _ints(a: Column, b: Column) -> Column:
    return a.isin(*INT_FAMILIES) & b.isin(*INT_FAMILIES)


def issue(rows: DataFrame, rule: str, title: Column, severity, confidence: str = "high",
          kind: str = "confirmed") -> DataFrame:
    return rows.select(
        *REPO, F.lit(f"database.{rule}").alias("rule"), title.alias("title"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"), "file", F.col("line").cast("int").alias("line"))


def leading(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """(repo, tbl, col) of columns some key or index starts with."""
    keys = columns.filter(F.col("pk") | F.col("is_unique")).select(*REPO, "tbl", "col")
    return keys.unionByName(indexes.select(*REPO, "tbl", F.get("cols", F.lit(0)).alias("col"))).distinct()


def _sql(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("orm").isin("sqlalchemy", "django", "sql", "prisma"))


def _only(dialects: DataFrame, name: str) -> DataFrame:
    return dialects.groupBy(*REPO).agg(F.min("dialect").alias("_a"), F.max("dialect").alias("_b")).filter(
        (F.col("_a") == name) & (F.col("_b") == name)).select(*REPO)


def fk_without_index(columns: DataFrame, indexes: DataFrame, dialects: DataFrame) -> DataFrame:
    """Foreign keys no index starts with. Django and MySQL create one themselves."""
    fks = _sql(columns).filter(F.col("fk_tbl").isNotNull() & (F.col("orm") != "django"))
    rows = fks.join(_only(dialects, "mysql"), REPO, "left_anti").join(
        leading(columns, indexes), [*REPO, "tbl", "col"], "left_anti")
    return issue(rows, "fk-without-index", F.lit("Foreign key column without an index"), "low", "medium", "estimate")


def _plurals(name: Column) -> Column:
    """Table spellings a prefix may stand for."""
    return F.array_distinct(F.array(
        name, F.concat(name, F.lit("s")), F.concat(name, F.lit("es")),
        F.when(name.endswith("y"), F.concat(F.regexp_replace(name, "y$", ""), F.lit("ies"))).otherwise(name)))


def missing_foreign_keys(columns: DataFrame) -> DataFrame:
    """``<x>_id`` columns that name a table, hold its key's type and declare no foreign key."""
    rows = _sql(columns).filter(F.col("fk_tbl").isNull() & ~F.col("pk"))
    under = F.regexp_extract("col", r"^([a-z][a-z0-9_]*?)_id$", 1)
    prefix = F.when(under != "", under).otherwise(F.regexp_extract("col", r"^([a-z][A-Za-z0-9]*?)(?:Id|ID)$", 1))
    rows = rows.withColumn("prefix", snake(prefix)).filter(
        (F.col("prefix") != "") & ~F.col("prefix").rlike(EXTERNAL_PREFIX))
    kinds = columns.select(*REPO, "tbl", F.regexp_extract(
        F.lower("col"), r"^(.+?)_?(?:type|model|kind|table|class)$", 1).alias("prefix")).filter("prefix <> ''").distinct()
    rows = rows.join(kinds, [*REPO, "tbl", "prefix"], "left_anti")
    targets = columns.groupBy(*REPO, F.col("tbl").alias("target")).agg(
        F.min("model").alias("target_model"), F.count(F.when(F.col("pk"), 1)).alias("_pks"),
        F.min(F.when(F.col("pk"), F.col("type"))).alias("_pk_type"), F.min("orm").alias("target_orm"))
    named = targets.select("*", F.explode(F.array_distinct(F.array(
        F.col("target"), snake("target_model"), F.lower("target_model")))).alias("spelling"))
    wanted = rows.select("*", F.posexplode(_plurals(F.col("prefix"))).alias("_i", "spelling"))
    hit = wanted.join(named, [*REPO, "spelling"])
    hit = hit.groupBy(*[c for c in rows.columns]).agg(F.min(F.struct(
        "_i", "target", "target_model", "_pks", "_pk_type", "target_orm")).alias("t"))
    mine, theirs = type_family("type"), F.when(F.col("t._pks") == 1, type_family(F.col("t._pk_type"))).otherwise("")
    agree = (mine == "") | (theirs == "") | (mine == theirs) | _ints(mine, theirs)
    same = (F.col("t.target_orm") == F.col("orm")) | (F.col("orm") == "sql") | (F.col("t.target_orm") == "sql")
    hit = hit.filter(agree & same)
    log = F.col("model").rlike(LOG_MODEL) | F.col("tbl").rlike(LOG_MODEL)
    return issue(hit, "missing-foreign-key", F.concat(
        F.lit("`"), "tbl", F.lit("."), "col", F.lit("` has no foreign key")),
        F.when(log, "low").otherwise("medium"), "medium", "potential")


def key_type_mismatch(columns: DataFrame) -> DataFrame:
    """Foreign key columns whose type family differs from the referenced column's."""
    a = columns.filter(F.col("fk_tbl").isNotNull() & F.col("orm").isin("sqlalchemy", "sql", "prisma"))
    b = columns.select(*REPO, F.col("tbl").alias("fk_tbl"), F.col("col").alias("fk_col"), F.col("type").alias("_bt"))
    rows = a.join(b, [*REPO, "fk_tbl", "fk_col"]).withColumns({"_fa": type_family("type"), "_fb": type_family("_bt")})
    rows = rows.filter((F.col("_fa") != "") & (F.col("_fb") != "") & (F.col("_fa") != F.col("_fb")))
    return issue(rows, "inconsistent-relationship", F.concat(
        "model", F.lit("."), "col", F.lit(" ("), "_fa", F.lit(") references "), "fk_tbl", F.lit("."), "fk_col",
        F.lit(" ("), "_fb", F.lit(")")), F.when(_ints(F.col("_fa"), F.col("_fb")), "medium").otherwise("high"))


def set_null_on_required(columns: DataFrame) -> DataFrame:
    action = F.upper(F.translate(F.coalesce("on_delete", F.lit("")), "_", " "))
    rows = columns.filter(action.isin("SET NULL", "SETNULL") & ~F.col("nullable"))
    return issue(rows, "inconsistent-relationship", F.concat(
        "model", F.lit("."), "col", F.lit(" is NOT NULL but ON DELETE SET NULL")), "medium")


def relation_problems(relations: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Relationship sides that miss or contradict each other, lack a key path, or promise uniqueness nobody keeps.

    Every join is between two catalogues of the whole fleet, so each is a merge join: a catalogue's rows compress so well that
    Spark would take it for a small table and send it through the driver."""
    models = columns.groupBy(*REPO, "model").agg(F.min("tbl").alias("tbl"), F.min("orm").alias("orm"))
    rel = relations.join(models.hint("merge"), [*REPO, "model"])
    target = models.select(*REPO, F.col("model").alias("target"), F.col("tbl").alias("target_tbl"))
    known = rel.join(target.hint("merge"), [*REPO, "target"])
    other = relations.select(*REPO, F.col("model").alias("target"), F.col("name").alias("back_populates"),
                             F.col("target").alias("_ot"), F.col("back_populates").alias("_ob"))
    sides = known.filter((F.col("orm") == "sqlalchemy") & F.col("back_populates").isNotNull()).join(
        other.hint("merge"), [*REPO, "target", "back_populates"], "left")
    here = F.concat("model", F.lit("."), "name")
    gone = issue(sides.filter(F.col("_ot").isNull()), "inconsistent-relationship", F.concat(
        here, F.lit(" back_populates a missing "), "target", F.lit("."), "back_populates"), "medium")
    crossed = issue(sides.filter(F.col("_ot").isNotNull() & (
        ~F.col("_ob").eqNullSafe(F.col("name")) | (F.col("_ot") != F.col("model")))), "inconsistent-relationship",
        F.concat(here, F.lit(" and "), "target", F.lit("."), "back_populates", F.lit(" do not point at each other")), "medium")
    fks = columns.filter(F.col("fk_tbl").isNotNull()).select(*REPO, "tbl", "fk_tbl").distinct()
    links = fks.unionByName(fks.select(*REPO, F.col("fk_tbl").alias("tbl"), F.col("tbl").alias("fk_tbl"))).distinct() \
        .withColumnRenamed("fk_tbl", "target_tbl")
    free = known.filter((F.col("orm") == "sqlalchemy") & ~F.coalesce("secondary", F.lit(False))
                        & ~F.coalesce("explicit_join", F.lit(False)))
    unlinked = issue(free.join(links.hint("merge"), [*REPO, "tbl", "target_tbl"], "left_anti"), "inconsistent-relationship",
                     F.concat(here, F.lit(" has no foreign key path to "), "target"), "medium")
    unique = columns.filter(F.col("is_unique") | F.col("pk")).select(*REPO, "tbl", "col").unionByName(
        indexes.filter(F.col("is_unique") & (F.size("cols") == 1)).select(*REPO, "tbl", F.get("cols", F.lit(0)).alias("col"))
    ).distinct().withColumn("_u", F.lit(True))
    back = columns.filter(F.col("fk_tbl").isNotNull()).join(unique.hint("merge"), [*REPO, "tbl", "col"], "left").groupBy(
        *REPO, F.col("tbl").alias("target_tbl"), F.col("fk_tbl").alias("tbl")).agg(
        F.max(F.coalesce("_u", F.lit(False))).alias("_any"), F.min("col").alias("_col"))
    single = known.filter((F.col("orm") == "sqlalchemy") & (F.col("uselist") == F.lit(False))).join(
        back.hint("merge"), [*REPO, "tbl", "target_tbl"]).filter(~F.col("_any"))
    loose = issue(single, "inconsistent-relationship", F.concat(
        here, F.lit(" is one-to-one but "), "target_tbl", F.lit("."), "_col", F.lit(" is not unique")), "low", "medium", "potential")
    unknown = issue(rel.filter((F.col("orm") == "mongoose") & (F.col("kind") == "ref")).join(
        target.hint("merge"), [*REPO, "target"], "left_anti").drop("kind"), "inconsistent-relationship", F.concat(
        here, F.lit(" refs unknown model '"), "target", F.lit("'")), "medium", "medium", "potential")
    return gone.unionByName(crossed).unionByName(unlinked).unionByName(loose).unionByName(unknown)


def duplicated_data(columns: DataFrame) -> DataFrame:
    """Copies ``<relation>_<column>`` next to a foreign key, and ``<child>_count`` counter caches."""
    sql = _sql(columns)
    refs = sql.filter(F.col("fk_tbl").isNotNull() & (F.col("fk_tbl") != F.col("tbl"))).select(
        *REPO, "tbl", snake(F.regexp_replace("col", r"_?id$|Id$", "")).alias("prefix"), "fk_tbl").distinct()
    plain = columns.filter(~F.col("pk") & F.col("fk_tbl").isNull())
    source = plain.select(*REPO, F.col("tbl").alias("fk_tbl"), F.col("col").alias("_copied"), F.col("model").alias("_of"))
    names = refs.join(source, [*REPO, "fk_tbl"]).withColumn("col", F.concat_ws("_", "prefix", "_copied"))
    copies = sql.filter(~F.col("pk") & F.col("fk_tbl").isNull() & ~F.col("model").rlike(SNAPSHOT_MODEL)).drop("fk_tbl").join(
        names.select(*REPO, "tbl", "col", "_of", "_copied"), [*REPO, "tbl", "col"])
    copied = issue(copies, "duplicated-data", F.concat(
        F.lit("`"), "tbl", F.lit("."), "col", F.lit("` copies "), "_of", F.lit("."), "_copied"), "low", "medium", "potential")
    what = snake(F.coalesce(F.nullif(F.regexp_extract("col", r"^(\w+?)_count$", 1), F.lit("")),
                            F.nullif(F.regexp_extract("col", r"^num_(\w+)$", 1), F.lit("")),
                            F.nullif(F.regexp_extract("col", r"^(\w+?)Count$", 1), F.lit(""))))
    counters = sql.withColumn("_what", what).filter(F.col("_what").isNotNull())
    children = sql.filter(F.col("fk_tbl").isNotNull() & (F.col("fk_tbl") != F.col("tbl"))).select(
        *REPO, F.col("fk_tbl").alias("tbl"), F.col("model").alias("_child"), F.explode(F.array_distinct(F.concat(
            _plurals(snake("model")), F.array("tbl")))).alias("_what")).distinct()
    cached = counters.join(children, [*REPO, "tbl", "_what"]).groupBy(*REPO, "tbl", "col", "file", "line").agg(
        F.min("_child").alias("_child"))
    return copied.unionByName(issue(cached, "duplicated-data", F.concat(
        F.lit("`"), "tbl", F.lit("."), "col", F.lit("` caches a count of "), "_child"), "low", "medium", "potential"))


def design_issues(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables without a primary key, money in floating point, natural keys without a unique constraint."""
    keyed = columns.groupBy(*REPO, "model").agg(
        F.max("pk").alias("_pk"), F.min("file").alias("file"), F.min("line").alias("line")).filter(~F.col("_pk"))
    words = F.transform(F.regexp_extract_all("col", F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0)), F.lower)
    named = F.arrays_overlap(words, F.array(*[F.lit(w) for w in MONEY_WORDS])) & ~F.arrays_overlap(
        words, F.array(*[F.lit(w) for w in NOT_MONEY_WORDS]))
    money = columns.filter(named & F.col("type").rlike(FLOAT_TYPE))
    unique = indexes.filter("is_unique").select(*REPO, "tbl", F.explode("cols").alias("col")).distinct()
    natural = columns.filter(F.col("col").rlike(NATURAL_KEY) & ~F.col("is_unique") & ~F.col("pk") & (
        (F.lower("col") != "email") | F.col("model").rlike(PERSON_MODEL))).join(unique, [*REPO, "tbl", "col"], "left_anti")
    return issue(keyed, "no-primary-key", F.concat(F.lit("Model "), "model", F.lit(" has no primary key")), "medium",
                 "medium").unionByName(
        issue(money, "money-as-float", F.concat(F.lit("Monetary column `"), "col", F.lit("` stored as floating point")),
              "medium", "medium")).unionByName(
        issue(natural, "missing-unique-constraint", F.concat(F.lit("`"), "model", F.lit("."), "col", F.lit(
            "` has no unique constraint")), "low", "low", "potential"))


def missing_indexes(queries: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Equality or limited-sort lookups no index serves, one issue per (model, column).

    ``queries``: (repo keys, query_id, model, eq_cols array, order_cols array, limited, file, line).
    """
    served = leading(columns, indexes)
    cols = F.when(F.size("eq_cols") > 0, F.col("eq_cols")).when(F.col("limited"), F.col("order_cols"))
    rows = queries.withColumn("_cols", cols).filter(
        (F.size("_cols") > 0) & ~F.col("model").rlike(REFERENCE_MODEL)).select(
        *REPO, "query_id", "model", "file", "line", (F.size("eq_cols") == 0).alias("sorts"),
        F.posexplode("_cols").alias("_i", "col"))
    meta = columns.select(*REPO, "model", "tbl", "col", "type", F.col("fk_tbl").isNotNull().alias("_fk"))
    rows = rows.join(meta, [*REPO, "model", "col"], "left").join(
        served.withColumn("_ix", F.lit(True)), [*REPO, "tbl", "col"], "left")
    usable = type_family("type") != "bool"
    judged = rows.groupBy(*REPO, "query_id", "model", "file", "line", "sorts").agg(
        F.max(F.col("tbl").isNull() | F.coalesce("_ix", F.lit(False)) | F.coalesce("_fk", F.lit(False))).alias("_skip"),
        F.min(F.when(usable, F.struct("_i", "tbl", "col"))).alias("f")).filter(~F.col("_skip") & F.col("f").isNotNull())
    sites = judged.groupBy(*REPO, "model", F.col("f.tbl").alias("tbl"), F.col("f.col").alias("col")).agg(
        F.count(F.lit(1)).alias("sites"), F.min(F.struct("file", "line")).alias("at")).select("*", "at.file", "at.line")
    return issue(sites, "missing-index", F.concat(F.lit("`"), "tbl", F.lit("."), "col", F.lit(
        "` is queried without an index")), F.when(F.col("sites") == 1, "low").otherwise("medium"), "medium", "estimate")


# --- migrations ------------------------------------------------------------------------------------
DESTRUCTIVE = ["drop_table", "drop_column", "truncate", "delete"]


def widening(old: Column, new: Column) -> Column:
    """varchar(n) to a larger varchar or to text."""
    a = F.regexp_extract(old, r"\((\d+)", 1).cast("int")
    b = F.regexp_extract(new, r"\((\d+)", 1).cast("int")
    strings = (type_family(old) == "string") & (type_family(new) == "string")
    return F.coalesce(strings & (new.rlike(r"\btext\b|unicodetext") | (b >= a)), F.lit(False))


def _still_declared(ops: DataFrame, columns: DataFrame) -> DataFrame:
    """Drops whose table or column the models still declare and no later migration brings back."""
    drops = ops.filter(F.col("kind").isin("drop_table", "drop_column"))
    models = columns.filter(F.col("orm") != "sql")
    tables = models.select(*REPO, "tbl").distinct()
    declared = drops.filter("kind = 'drop_table'").join(tables, [*REPO, "tbl"], "left_semi").unionByName(
        drops.filter("kind = 'drop_column'").join(models.select(*REPO, "tbl", "col").distinct(), [*REPO, "tbl", "col"],
                                                  "left_semi"))
    # the last migration that brings a table or a column back, per table and per column
    back = ops.filter(F.col("kind").isin("create_table", "add_column", "rename_column")).select(
        *REPO, "tool", "tbl", F.when(F.col("kind") == "rename_column", F.col("detail")["to"])
        .when(F.col("kind") == "add_column", F.col("col")).alias("_c"), "kind", "mig_seq")
    whole = back.filter("kind = 'create_table'").groupBy(*REPO, "tool", "tbl").agg(F.max("mig_seq").alias("_table_at"))
    single = back.filter("_c IS NOT NULL").groupBy(*REPO, "tool", "tbl", F.col("_c").alias("col")).agg(
        F.max("mig_seq").alias("_col_at"))
    rows = declared.join(whole, [*REPO, "tool", "tbl"], "left").join(single, [*REPO, "tool", "tbl", "col"], "left")
    later = F.coalesce(F.col("_table_at") > F.col("mig_seq"), F.lit(False)) | (
        (F.col("kind") == "drop_column") & F.coalesce(F.col("_col_at") > F.col("mig_seq"), F.lit(False)))
    return rows.filter(~later).select(*REPO, "tool", "mig_seq", "op_seq").withColumn("_used", F.lit(True))


def _looked_back(rows: DataFrame, mig: list[str], flag: str, name: Column, statements: DataFrame) -> DataFrame:
    """``rows`` with ``flag``: whether an earlier step of the same migration is a statement of that name. A name's first step
    tells, so the look-back is a minimum per name, combined before the shuffle, and an equi-join: a migration of any length
    is neither gathered nor sorted. ``statements`` has ``_name``."""
    first = statements.groupBy(*mig, "_name").agg(F.min("op_seq").alias("_at"))
    joined = rows.withColumn("_name", name).join(first, [*mig, "_name"], "left")
    return joined.withColumn(flag, F.coalesce(F.col("_at") < F.col("op_seq"), F.lit(False))).drop("_at", "_name")


def migration_issues(ops: DataFrame, columns: DataFrame, dialects: DataFrame) -> DataFrame:
    """Destructive, unsafe and irreversible migration steps, judged per engine. What earlier steps of the same migration
    did is looked up by name, see ``_looked_back``; steps of equal number don't see each other."""
    engines = dialects.groupBy(*REPO).agg(F.collect_set("dialect").alias("_d"))
    mig = [*REPO, "tool", "mig_seq"]
    none = F.array().cast("array<string>")
    made = ops.filter("kind = 'create_table'").select(*mig, "tbl").distinct()
    rows = ops.filter(~F.col("tbl").isin("?", "") & (F.coalesce("col", F.lit("")) != "?")).join(made, [*mig, "tbl"], "left_anti")
    rows = rows.join(engines, REPO, "left").withColumn("_d", F.coalesce("_d", none))
    copies = ops.filter(F.col("kind").isin("insert", "update"))
    rows = _looked_back(rows, mig, "_read", F.coalesce("col", "tbl"), copies.withColumn(
        "_name", F.explode(F.split(F.col("detail")["reads"], ","))))
    rows = _looked_back(rows, mig, "_filled", F.concat_ws(".", "tbl", "col"), ops.filter("kind = 'update'").withColumn(
        "_name", F.concat_ws(".", "tbl", "col")))
    rows = _looked_back(rows, mig, "_code", F.lit(""), ops.filter("kind = 'run_python'").withColumn("_name", F.lit("")))
    rows = rows.join(_still_declared(ops, columns), [*mig, "op_seq"], "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col("detail")[name], F.lit("")) == "true"

    where = F.concat(F.lit("`"), F.col("tbl"), F.coalesce(F.concat(F.lit("."), F.col("col")), F.lit("")), F.lit("`"))
    nothing = F.size("_d") == 0
    pg, mysql = nothing | F.array_contains("_d", "postgresql"), nothing | F.array_contains("_d", "mysql")
    lite = F.array_contains("_d", "sqlite")
    wide = widening(F.coalesce(F.col("detail")["existing"], F.lit("")), F.coalesce(F.col("detail")["type"], F.lit("")))
    kind = F.col("kind")
    copied = F.col("_read") | F.col("_code")
    gone = kind.isin("drop_table", "drop_column", "truncate") | ((kind == "delete") & ~flag("where"))
    verb = F.when(kind == "drop_table", "drops table").when(kind == "drop_column", "drops column").when(
        kind == "truncate", "truncates").otherwise("deletes every row of")
    sqlite_only = (F.size("_d") == 1) & lite
    batch = sqlite_only & (F.col("tool") == "alembic") & ~flag("batch") & kind.isin(
        "alter_type", "set_not_null", "add_fk", "add_unique", "drop_constraint", "add_check")

    def case(cond: Column, title: Column, severity, confidence: str = "medium", how: str = "potential",
             rule: str = "unsafe-migration") -> tuple[Column, Column]:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return cond, F.struct(F.lit(rule).alias("rule"), title.alias("title"), sev.alias("severity"),
                              F.lit(confidence).alias("confidence"), F.lit(how).alias("how"))

    def says(text: str, tail: str = "") -> Column:
        return F.concat(F.lit(text), where, F.lit(tail))

    arms = [
        case(gone, F.concat(F.lit("Migration "), verb, F.lit(" "), where), F.when(F.col("_used"), "high").when(
            copied, "low").otherwise("medium"), "high", "confirmed", "destructive-migration"),
        case(batch, F.concat(F.lit("Alembic `"), kind, F.lit("` on SQLite outside batch mode")), "medium", "high", "confirmed"),
        case(kind.isin("rename_column", "rename_table"), says("Migration renames "), "medium"),
        case((kind == "add_column") & flag("not_null") & ~flag("default") & ~flag("django"),
             says("NOT NULL column ", " added without a default"), F.when(pg | lite, "medium").otherwise("low"), "high",
             "confirmed"),
        case((kind == "add_column") & flag("django") & flag("indexed") & pg,
             says("AddField ", " builds an index while blocking writes"), "low"),
        case((kind == "create_index") & ~flag("concurrently") & pg & ~flag("mysql"),
             says("Index on ", " built without CONCURRENTLY"), "medium"),
        case((kind == "alter_type") & ~wide & (pg | mysql), says("Column type change on "), "medium"),
        case(kind == "set_not_null", says("SET NOT NULL on existing column "), F.when(
            F.col("_filled"), "low").otherwise("medium")),
        case((kind == "add_fk") & ~flag("not_valid") & pg, says("Foreign key on ", " added and validated at once"), "medium"),
        case((kind == "add_fk") & ~flag("not_valid") & mysql, says("Foreign key on ", " added to an existing table"), "low"),
        case((kind == "add_unique") & pg & ~flag("using_index"),
             says("Unique constraint on ", " built while blocking writes"), "medium"),
        case(kind == "update", says("Data backfill of ", " inside a schema migration"), "low"),
    ]
    picked = F.lit(None)
    for cond, value in reversed(arms):
        picked = F.when(cond, value).otherwise(picked)
    # what a generator yields is made once; a plain column would be repeated for every field below
    hits = rows.withColumn("i", F.explode(F.array(picked))).filter(F.col("i").isNotNull()).select(
        *REPO, F.concat(F.lit("database."), F.col("i.rule")).alias("rule"), F.col("i.title").alias("title"),
        F.col("i.severity").alias("severity"), F.col("i.confidence").alias("confidence"), F.col("i.how").alias("kind"),
        "file", F.col("line").cast("int").alias("line"))
    first = ops.filter((F.col("tool") == "alembic") & F.col("downgrade").isin("missing", "empty")).groupBy(*mig).agg(
        F.min_by(F.struct("file", "line"), "op_seq").alias("at")).select(*REPO, "at.file", "at.line")
    one_way = issue(first, "irreversible-migration", F.lit("Alembic migration has no downgrade"), "low")
    bare = ops.filter(F.coalesce(F.col("detail")["irreversible"], F.lit("")) == "true").groupBy(*mig).agg(
        F.min_by(F.struct("kind", "file", "line"), "op_seq").alias("at")).select(*REPO, "at.*")
    label = F.when(F.col("kind") == "run_python", "RunPython").otherwise("RunSQL")
    titled = bare.withColumn("_t", F.concat(label, F.lit(" without a reverse operation"))).drop("kind")
    return hits.unionByName(one_way).unionByName(issue(titled, "irreversible-migration", F.col("_t"), "low"))


def missing_migrations(files: DataFrame, models: DataFrame) -> DataFrame:
    """Models without any migration folder, and a Prisma schema without committed migrations."""
    path = F.col("path")
    alembic = (path.rlike(r"(?:alembic\.ini|/env\.py)$") & path.rlike("alembic|migrations")) | (
        path.contains("/versions/") & path.contains("migrations"))
    flags = files.groupBy(*REPO).agg(
        F.max(alembic | path.rlike(r"(?:^|/)(?:migrations|db/migrate|migrate)/")).alias("_any"),
        F.max(path == "prisma/schema.prisma").alias("_prisma"),
        F.max(path.startswith("prisma/migrations/")).alias("_prisma_any")).withColumns({
            "file": F.lit(""), "line": F.lit(None).cast("int")})
    mapped = models.filter("orm = 'sqlalchemy'").select(*REPO).distinct()
    return issue(flags.filter(~F.col("_any")).join(mapped, REPO, "left_semi"), "no-migrations",
                 F.lit("ORM models without schema migrations"), "medium", "medium", "potential").unionByName(
        issue(flags.filter(F.col("_prisma") & ~F.col("_prisma_any")).withColumn("file", F.lit("prisma/schema.prisma")),
              "prisma-no-migrations", F.lit("Prisma schema without committed migrations"), "medium", "medium", "potential"))


def schema_issues(columns: DataFrame, indexes: DataFrame, relations: DataFrame, dialects: DataFrame) -> DataFrame:
    parts = [fk_without_index(columns, indexes, dialects), missing_foreign_keys(columns), key_type_mismatch(columns),
             set_null_on_required(columns), relation_problems(relations, columns, indexes), duplicated_data(columns),
             design_issues(columns, indexes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
