"""Import graph, schema catalogue and migration plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue as CA
from ..operators import graph as G
from ..session import cut_lineage
from ..sources.files import explode_lines
from ..vocab import RULE_NAMESPACE as NS
from .repositories import CUST

CLOSURE = """reach AS (SELECT repo_id, src AS a, dst AS b FROM e UNION SELECT r.repo_id, r.a, e.dst FROM reach r
               JOIN e ON e.repo_id = r.repo_id AND e.src = r.b),
  mutual AS (SELECT x.repo_id, x.a, x.b FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a),
  comp AS (SELECT repo_id, a AS node, min(b) AS component FROM mutual GROUP BY ALL),
  big AS (SELECT repo_id, component, count(*) AS size FROM comp GROUP BY ALL HAVING count(*) > 1)"""


def _rule(df: DataFrame) -> DataFrame:
    return df.select("repo_id", F.expr(f"substring(rule_id, {len(NS) + 1})").alias("rule"), "file_path", "severity")


def _edges(t) -> DataFrame:
    return t.edges.filter("src <> dst")


def _file_edges(t) -> DataFrame:
    return G.import_edges(explode_lines(t.repo_files), t.repo_files)


def _issues(df: DataFrame) -> DataFrame:
    return df.select("repo_id", F.expr("substring(rule, 10)").alias("rule"), "title", "severity")


def _fk_columns(t) -> DataFrame:
    return t.schema_columns


def relations(t) -> DataFrame:
    """Two relationship sides per catalogue, contradicting each other for some."""
    repo = F.col("repo_id").cast("int")
    base = t.schema_columns.filter("col = 'id' AND tbl = 'users'").select("org_id", "repo_id")
    none = F.lit(None).cast("string")
    fields = ["model", "name", "target", "back_populates", "kind", "uselist", "secondary", "explicit_join", "file", "line"]

    def side(model, name, target, back, uselist):
        return F.struct(*[v.alias(n) for n, v in zip(fields, (
            F.lit(model), F.lit(name), F.lit(target), back, F.lit("relationship"), uselist, F.lit(False), F.lit(False),
            F.lit("models.py"), F.lit(1)), strict=True)])

    unset = F.lit(None).cast("boolean")
    sides = F.array(
        side("User", "posts", "Post", F.when(repo % 3 == 0, "writer").otherwise("author"), F.when(repo % 4 == 0, False)),
        side("Post", "author", "User", F.when(repo % 5 == 0, "articles").otherwise("posts"), unset),
        side("Note", "owner", "User", none, unset))
    return base.withColumn("s", F.explode(sides)).select("org_id", "repo_id", "s.*")


def ops(t) -> DataFrame:
    return t.migration_ops.withColumns({
        "detail": F.create_map(F.lit("not_null"), F.col("not_null"), F.lit("default"), F.col("dflt"), F.lit("where"), F.col("wherex"),
                               F.lit("reads"), F.col("reads"), F.lit("existing"), F.lit("varchar(50)"), F.lit("type"), F.col("to_type"),
                               F.lit("to"), F.col("col")),
        "file": F.concat(F.lit("migrations/"), F.col("mig_seq").cast("string"), F.lit(".py")), "line": F.lit(1)}).drop(
        "not_null", "dflt", "wherex", "reads", "to_type")


def queries(t) -> DataFrame:
    """One lookup fact per line item on the catalogue of its customer."""
    rows = t.sql("""SELECT org_id, repo_id, op_seq, mig_seq, col, tbl, not_null, dflt FROM migration_ops""")
    model = F.when(F.col("tbl") == "users", "User").when(F.col("tbl") == "posts", "Post").otherwise("Note")
    one = F.array("col")
    none = F.array().cast("array<string>")
    return rows.select(
        "org_id", "repo_id", F.concat_ws("-", "mig_seq", "op_seq").alias("query_id"), model.alias("model"),
        F.when(F.col("not_null") == "true", one).otherwise(none).alias("eq_cols"),
        F.when(F.col("not_null") == "true", none).otherwise(one).alias("order_cols"), (F.col("dflt") == "true").alias("limited"),
        F.lit("q.py").alias("file"), (F.col("op_seq") % 100000).cast("int").alias("line"))


MIG_SQL = """
  base AS (SELECT *, concat('`', tbl, '.', col, '`') AS w FROM migration_ops),
  made AS (SELECT DISTINCT repo_id, mig_seq, tbl FROM base WHERE kind = 'create_table'),
  dial AS (SELECT repo_id, dialect FROM schema_dialects),
  cols AS (SELECT repo_id, tbl, col FROM schema_columns),
  tabs AS (SELECT DISTINCT repo_id, tbl FROM schema_columns),
  seen AS (SELECT b.*, d.dialect, d.dialect IS NULL OR d.dialect = 'postgresql' AS pg, d.dialect IS NULL OR d.dialect = 'mysql' AS my,
      coalesce(d.dialect = 'sqlite', false) AS lite,
      EXISTS (SELECT 1 FROM base x WHERE x.repo_id = b.repo_id AND x.mig_seq = b.mig_seq AND x.op_seq < b.op_seq AND x.kind = 'update'
              AND list_contains(string_split(x.reads, ','), b.col)) AS copied,
      EXISTS (SELECT 1 FROM base x WHERE x.repo_id = b.repo_id AND x.mig_seq = b.mig_seq AND x.op_seq < b.op_seq AND x.kind = 'update'
              AND x.tbl = b.tbl AND x.col = b.col) AS filled,
      CASE kind WHEN 'drop_table' THEN EXISTS (SELECT 1 FROM tabs x WHERE x.repo_id = b.repo_id AND x.tbl = b.tbl)
           WHEN 'drop_column' THEN EXISTS (SELECT 1 FROM cols x WHERE x.repo_id = b.repo_id AND x.tbl = b.tbl AND x.col = b.col) END
        AND NOT EXISTS (SELECT 1 FROM base x WHERE x.repo_id = b.repo_id AND x.tbl = b.tbl AND x.mig_seq > b.mig_seq
              AND (x.kind = 'create_table' OR (b.kind = 'drop_column' AND x.kind IN ('add_column', 'rename_column') AND x.col = b.col))) AS used
    FROM base b LEFT JOIN dial d ON d.repo_id = b.repo_id
    WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.repo_id = b.repo_id AND m.mig_seq = b.mig_seq AND m.tbl = b.tbl)),
  judged AS (SELECT repo_id, mig_seq, op_seq, CASE
      WHEN kind IN ('drop_table', 'drop_column', 'truncate') OR (kind = 'delete' AND wherex = 'false') THEN struct_pack(r := 'destructive-migration',
        t := concat('Migration ', CASE kind WHEN 'drop_table' THEN 'drops table' WHEN 'drop_column' THEN 'drops column' WHEN 'truncate' THEN 'truncates'
          ELSE 'deletes every row of' END, ' ', w), s := CASE WHEN used THEN 'high' WHEN copied THEN 'low' ELSE 'medium' END)
      WHEN lite AND kind IN ('alter_type', 'set_not_null', 'add_fk', 'add_unique') THEN
        struct_pack(r := 'unsafe-migration', t := concat('Alembic `', kind, '` on SQLite outside batch mode'), s := 'medium')
      WHEN kind = 'rename_column' THEN struct_pack(r := 'unsafe-migration', t := concat('Migration renames ', w), s := 'medium')
      WHEN kind = 'add_column' AND not_null = 'true' AND dflt = 'false' THEN struct_pack(r := 'unsafe-migration',
        t := concat('NOT NULL column ', w, ' added without a default'), s := CASE WHEN pg OR lite THEN 'medium' ELSE 'low' END)
      WHEN kind = 'create_index' AND pg THEN struct_pack(r := 'unsafe-migration', t := concat('Index on ', w, ' built without CONCURRENTLY'), s := 'medium')
      WHEN kind = 'alter_type' AND to_type = 'varchar(10)' AND (pg OR my) THEN
        struct_pack(r := 'unsafe-migration', t := concat('Column type change on ', w), s := 'medium')
      WHEN kind = 'set_not_null' THEN struct_pack(r := 'unsafe-migration', t := concat('SET NOT NULL on existing column ', w),
        s := CASE WHEN filled THEN 'low' ELSE 'medium' END)
      WHEN kind = 'add_fk' AND pg THEN struct_pack(r := 'unsafe-migration', t := concat('Foreign key on ', w, ' added and validated at once'), s := 'medium')
      WHEN kind = 'add_fk' AND my THEN struct_pack(r := 'unsafe-migration', t := concat('Foreign key on ', w, ' added to an existing table'), s := 'low')
      WHEN kind = 'add_unique' AND pg THEN struct_pack(r := 'unsafe-migration', t := concat('Unique constraint on ', w, ' built while blocking writes'), s := 'medium')
      WHEN kind = 'update' THEN struct_pack(r := 'unsafe-migration', t := concat('Data backfill of ', w, ' inside a schema migration'), s := 'low')
      END AS i FROM seen),
  listed AS (SELECT repo_id, i.r AS rule, i.t AS title, i.s AS severity FROM judged WHERE i IS NOT NULL)"""

PLANS = [
    ("import_cycles", lambda t: G.strongly_connected(_edges(t)).select("repo_id", "node", "component", "size"),
     f"""WITH RECURSIVE e AS (SELECT repo_id, src, dst FROM edges WHERE src <> dst), {CLOSURE}
        SELECT repo_id, node, component, size FROM comp JOIN big USING (repo_id, component)"""),
    ("package_cycles", lambda t: (lambda e: G.package_cycles(e, G.strongly_connected(e)))(cut_lineage(_edges(t))).select(
        "repo_id", "node", "component"), """
        WITH RECURSIVE m AS (SELECT repo_id, src, dst FROM edges WHERE src <> dst),
        mreach AS (SELECT repo_id, src AS a, dst AS b FROM m UNION SELECT r.repo_id, r.a, m.dst FROM mreach r
                   JOIN m ON m.repo_id = r.repo_id AND m.src = r.b),
        mcomp AS (SELECT x.repo_id, x.a AS node, min(x.b) AS c FROM mreach x JOIN mreach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY ALL),
        mbig AS (SELECT repo_id, c, list_sort(list(DISTINCT split_part(node, '/', 1))) AS dirs FROM mcomp GROUP BY ALL HAVING count(*) > 1),
        e AS (SELECT DISTINCT repo_id, split_part(src, '/', 1) AS src, split_part(dst, '/', 1) AS dst FROM m
              WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)),
        reach AS (SELECT repo_id, src AS a, dst AS b FROM e UNION SELECT r.repo_id, r.a, e.dst FROM reach r
                  JOIN e ON e.repo_id = r.repo_id AND e.src = r.b),
        comp AS (SELECT x.repo_id, x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY ALL),
        big AS (SELECT repo_id, component, list_sort(list(node)) AS dirs FROM comp GROUP BY ALL HAVING count(*) > 1)
        SELECT c.repo_id, node, c.component FROM comp c JOIN big b ON b.repo_id = c.repo_id AND b.component = c.component
        WHERE NOT EXISTS (SELECT 1 FROM mbig m WHERE m.repo_id = b.repo_id AND m.dirs = b.dirs)"""),
    ("fan_out", lambda t: _edges(t).groupBy("repo_id", "src").agg(F.countDistinct("dst").alias("n")),
     "SELECT repo_id, src, count(DISTINCT dst) AS n FROM edges WHERE src <> dst GROUP BY ALL"),
    ("import_graph", lambda t: _file_edges(t).select("repo_id", "src", "dst"), f"""WITH {CUST}
        SELECT repo_id, 'src/server.js' AS src, 'src/util.ts' AS dst FROM cust
        UNION ALL SELECT repo_id, 'src/util.ts', 'src/server.js' FROM cust WHERE k % 2 = 0
        UNION ALL SELECT repo_id, 'app/services.py', 'app/models.py' FROM cust
        UNION ALL SELECT repo_id, 'app/models.py', 'app/services.py' FROM cust WHERE k % 2 = 0"""),
    ("layers", lambda t: G.layers(t.repo_files).select("repo_id", "path", "layer"), f"""WITH {CUST}
        SELECT repo_id, unnest(['src/server.js', 'src/util.ts', 'app/services.py', 'app/models.py', 'app/__init__.py']) AS path,
               unnest(['controller', '', 'service', 'data', '']) AS layer FROM cust"""),
    ("architecture_rules", lambda t: _rule(G.architecture({"files": t.repo_files, "lines": explode_lines(t.repo_files)})), f"""WITH {CUST}
        SELECT repo_id, 'architecture.import-cycle' AS rule, unnest(['src/server.js', 'app/models.py']) AS file_path, 'low' AS severity
          FROM cust WHERE k % 2 = 0
        UNION ALL SELECT repo_id, 'architecture.dependency-direction', 'app/models.py', 'low' FROM cust WHERE k % 2 = 0"""),
    ("fk_without_index", lambda t: CA.fk_without_index(_fk_columns(t), t.schema_indexes, t.schema_dialects).select("repo_id", "line"), f"""
        WITH {CUST} SELECT repo_id, 6 AS line FROM cust WHERE k % 7 > 0 AND NOT (k % 5 > 0 AND k % 4 = 1)"""),
    ("missing_foreign_keys", lambda t: _issues(CA.missing_foreign_keys(_fk_columns(t))), f"""WITH {CUST}
        SELECT repo_id, 'missing-foreign-key' AS rule, '`notes.post_id` has no foreign key' AS title, 'medium' AS severity FROM cust
        WHERE k % 2 = 0 OR k % 5 = 0"""),
    ("key_type_mismatch", lambda t: _issues(CA.key_type_mismatch(_fk_columns(t))), f"""WITH {CUST}
        SELECT repo_id, 'inconsistent-relationship' AS rule, concat('Post.user_id (', CASE WHEN k % 3 = 1 THEN 'int32' ELSE 'string' END,
          ') references users.id (int64)') AS title, CASE WHEN k % 3 = 1 THEN 'medium' ELSE 'high' END AS severity FROM cust WHERE k % 3 > 0"""),
    ("set_null_on_required", lambda t: _issues(CA.set_null_on_required(_fk_columns(t))), f"""WITH {CUST}
        SELECT repo_id, 'inconsistent-relationship' AS rule, 'Post.user_id is NOT NULL but ON DELETE SET NULL' AS title, 'medium' AS severity
        FROM cust WHERE k % 4 = 1 AND k % 2 = 1"""),
    ("relation_problems", lambda t: _issues(CA.relation_problems(relations(t), _fk_columns(t), t.schema_indexes)), f"""WITH {CUST}
        SELECT repo_id, 'inconsistent-relationship' AS rule, 'User.posts back_populates a missing Post.writer' AS title, 'medium' AS severity FROM cust WHERE k % 3 = 0
        UNION ALL SELECT repo_id, 'inconsistent-relationship', 'Post.author back_populates a missing User.articles', 'medium' FROM cust WHERE k % 5 = 0
        UNION ALL SELECT repo_id, 'inconsistent-relationship', 'User.posts and Post.author do not point at each other', 'medium' FROM cust WHERE k % 5 = 0 AND k % 3 > 0
        UNION ALL SELECT repo_id, 'inconsistent-relationship', 'Post.author and User.posts do not point at each other', 'medium' FROM cust WHERE k % 3 = 0 AND k % 5 > 0
        UNION ALL SELECT repo_id, 'inconsistent-relationship', 'Note.owner has no foreign key path to User', 'medium' FROM cust
        UNION ALL SELECT repo_id, 'inconsistent-relationship', 'User.posts is one-to-one but posts.user_id is not unique', 'low' FROM cust WHERE k % 4 = 0"""),
    ("duplicated_data", lambda t: _issues(CA.duplicated_data(_fk_columns(t))), f"""WITH {CUST}
        SELECT repo_id, 'duplicated-data' AS rule, '`posts.user_email` copies User.email' AS title, 'low' AS severity FROM cust WHERE k % 4 = 0
        UNION ALL SELECT repo_id, 'duplicated-data', '`users.post_count` caches a count of Post', 'low' FROM cust WHERE k % 3 = 0"""),
    ("schema_design", lambda t: _issues(CA.design_issues(_fk_columns(t), t.schema_indexes)), f"""WITH {CUST}
        SELECT repo_id, 'no-primary-key' AS rule, 'Model Post has no primary key' AS title, 'medium' AS severity FROM cust WHERE k % 5 = 0
        UNION ALL SELECT repo_id, 'no-primary-key', 'Model Note has no primary key', 'medium' FROM cust
        UNION ALL SELECT repo_id, 'money-as-float', 'Monetary column `price_total` stored as floating point', 'medium' FROM cust WHERE k % 6 = 0
        UNION ALL SELECT repo_id, 'missing-unique-constraint', '`User.email` has no unique constraint', 'low' FROM cust WHERE k % 2 = 1"""),
    ("missing_indexes", lambda t: _issues(CA.missing_indexes(queries(t), _fk_columns(t), t.schema_indexes)), """
        WITH q AS (SELECT repo_id, tbl, col, CAST(repo_id AS INT) AS k FROM migration_ops WHERE not_null = 'true' OR dflt = 'true'),
        hit AS (SELECT q.repo_id, q.tbl, q.col FROM q JOIN schema_columns c ON c.repo_id = q.repo_id AND c.tbl = q.tbl AND c.col = q.col
                WHERE NOT c.pk AND NOT c.is_unique AND c.fk_tbl IS NULL)
        SELECT repo_id, 'missing-index' AS rule, concat('`', tbl, '.', col, '` is queried without an index') AS title,
          CASE WHEN count(*) = 1 THEN 'low' ELSE 'medium' END AS severity FROM hit GROUP BY repo_id, tbl, col"""),
    ("migration_issues", lambda t: _issues(CA.migration_issues(ops(t), _fk_columns(t), t.schema_dialects)), f"""WITH {MIG_SQL}
        SELECT repo_id, rule, title, severity FROM listed
        UNION ALL SELECT DISTINCT ON (repo_id, mig_seq) repo_id, 'irreversible-migration', 'Alembic migration has no downgrade', 'low'
          FROM base WHERE downgrade = 'empty'"""),
]
