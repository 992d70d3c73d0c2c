"""Every operator bound to the driver's tables: queries and their DuckDB SQL.

The tables hold no source code, so operators work on columns of the same shape; each binding says which. Numbers are cast
to the same types on both sides, and arrays are joined to text in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import diff as D
from patchloom.operators import graph as G
from patchloom.operators import merge as M
from patchloom.operators import metrics as E
from patchloom.session import checkpointed, dealt, prepare
from patchloom.sources import patches as P

QUERIES: dict = {}
ORACLES: dict = {}


def bound(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


# --- Diff algebra -----------------------------------------------------------------------------------------------------

RUNS = """
runs AS (SELECT k, grp, min(n) AS run_start, max(n) AS run_end, count(*) AS run_len FROM (
  SELECT k, n, sum(s) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT k, n, CASE WHEN n = lag(n) OVER (PARTITION BY k ORDER BY n) + 1 THEN 0 ELSE 1 END AS s FROM pts)) GROUP BY k, grp)
"""


@bound(f"WITH pts AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity > 25), {RUNS} SELECT k AS l_orderkey, run_start, run_end, run_len FROM runs")
def islands_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive line numbers of an order among its lines of quantity over 25."""
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 25")
    return D.runs(rows, "l_linenumber", "l_orderkey").drop("grp")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """An order's lines as an old text (all) and a new one: returned lines are deleted, lines of status N follow anew.
    Returns all old lines, deleted ones, all new lines, added ones, each numbered within its side."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    # both sides are read for their lines, changes, pivots and runs, and numbered once
    old = checkpointed(l.select("l_orderkey", F.row_number().over(w).alias("line_no"), "l_returnflag", "l_partkey"))
    kept = old.where("l_returnflag <> 'R'").select("l_orderkey", "line_no", "l_returnflag", "l_partkey", F.lit(0).alias("again"))
    extra = old.where("l_returnflag = 'N'").select("l_orderkey", "line_no", "l_returnflag", "l_partkey", F.lit(1).alias("again"))
    new = kept.unionByName(extra).withColumnRenamed("line_no", "o").withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("o", "again")))
    new = checkpointed(new.select("l_orderkey", "line_no", "again", "l_partkey"))
    return old, old.where("l_returnflag = 'R'"), new, new.where("again = 1")


VERSIONS = """
old AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag AS f, l_partkey AS p FROM lineitem),
new AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n, again) AS n, again, p FROM (
  SELECT k, n, 0 AS again, p FROM old WHERE f <> 'R' UNION ALL SELECT k, n, 1, p FROM old WHERE f = 'N')),
pa AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS pv FROM old WHERE f <> 'R'),
pb AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS pv FROM new WHERE again = 0),
lm AS (SELECT pa.k, pa.n AS src, pb.n AS dst FROM pa JOIN pb ON pa.k = pb.k AND pa.pv = pb.pv),
lm0 AS (SELECT k, src, dst FROM lm UNION SELECT DISTINCT k, 0, 0 FROM old),
dr AS (SELECT k, min(n) AS s, max(n) AS e FROM (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS g FROM old WHERE f = 'R') GROUP BY k, g),
ar AS (SELECT k, min(n) AS s, max(n) AS e FROM (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS g FROM new WHERE again = 1) GROUP BY k, g),
hm AS (SELECT dr.k, dr.s AS a_start, dr.e AS a_end, ar.s AS b_start, ar.e AS b_end FROM dr JOIN ar ON dr.k = ar.k
  WHERE EXISTS (SELECT 1 FROM lm0 WHERE lm0.k = dr.k AND src = dr.s - 1 AND dst = ar.s - 1)
    AND EXISTS (SELECT 1 FROM lm0 WHERE lm0.k = dr.k AND src = dr.e + 1 AND dst = ar.e + 1))
"""


@bound(f"WITH {VERSIONS} SELECT k AS l_orderkey, n::int AS line_no, pv::int AS pv FROM pa")
def context_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """D3: lines of an order that stay, numbered in order."""
    old, gone, _, _ = _versions(spark, sf)
    return D.context_pivot(old.select("l_orderkey", "line_no"), gone.select("l_orderkey", "line_no"), "l_orderkey").withColumnRenamed("pivot", "pv")


def _line_map(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    old, gone, new, added = _versions(spark, sf)
    cols = ("l_orderkey", "line_no")
    a = D.context_pivot(old.select(*cols), gone.select(*cols), "l_orderkey")
    b = D.context_pivot(new.select(*cols), added.select(*cols), "l_orderkey")
    return D.line_map(a, b, "l_orderkey"), old, gone, new, added


@bound(f"WITH {VERSIONS} SELECT k AS l_orderkey, src::int AS src, dst::int AS dst FROM lm")
def line_map(spark: SparkSession, sf: str) -> DataFrame:
    """Old line numbers to new ones."""
    return _line_map(spark, sf)[0]


@bound(f"WITH {VERSIONS} SELECT k AS l_orderkey, a_start::int AS a_start, a_end::int AS a_end, b_start::int AS b_start, b_end::int AS b_end FROM hm")
def hunk_map(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted runs paired with added ones."""
    m, _, gone, _, added = _line_map(spark, sf)
    return D.hunk_map(D.runs(gone, "line_no", "l_orderkey"), D.runs(added, "line_no", "l_orderkey"), m, "l_orderkey")


@bound(f"""WITH {VERSIONS},
dc AS (SELECT dr.k, dr.s, dr.e, string_agg(p::varchar, chr(10) ORDER BY n) AS code FROM dr JOIN old ON old.k = dr.k AND n BETWEEN s AND e GROUP BY ALL),
ac AS (SELECT ar.k, ar.s, ar.e, string_agg(p::varchar, chr(10) ORDER BY n) AS code FROM ar JOIN new ON new.k = ar.k AND n BETWEEN s AND e GROUP BY ALL),
back AS (SELECT k, dst, CASE WHEN min(src) = 0 THEN 0 ELSE max(src) END AS src FROM lm0 GROUP BY k, dst)
SELECT l_orderkey, type, a_start::int AS a_start, a_end::int AS a_end, b_start::int AS b_start, b_end::int AS b_end, a_code, b_code, insert_line::int AS insert_line FROM (SELECT hm.k AS l_orderkey, 'mod' AS type, a_start, a_end, b_start, b_end, dc.code AS a_code, ac.code AS b_code, NULL::int AS insert_line
  FROM hm JOIN dc ON dc.k = hm.k AND dc.s = a_start JOIN ac ON ac.k = hm.k AND ac.s = b_start
UNION ALL SELECT k, 'del', s, e, NULL, NULL, code, NULL, NULL FROM dc WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.k = dc.k AND a_start = s)
UNION ALL SELECT ac.k, 'add', NULL, NULL, s, e, NULL, code, back.src FROM ac LEFT JOIN back ON back.k = ac.k AND back.dst = s - 1 WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.k = ac.k AND b_start = s))""")
def patch_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Modified, deleted and added hunks, a line's text being its part number."""
    m, _, gone, _, added = _line_map(spark, sf)
    text = lambda df: df.select("l_orderkey", "line_no", F.col("l_partkey").cast("string").alias("text"))
    return D.patch_hunks(text(gone), text(added), m, "l_orderkey")


@bound("""WITH b AS (SELECT user_id, event_id // 64 AS blk, min(event_id) AS s, max(event_id) AS e FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT event_id, user_id FROM events v WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = v.user_id AND v.event_id BETWEEN s AND e)""")
def uncovered_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user outside the spans of their errors."""
    ev = table(spark, sf, "events", "event_id", "user_id", "event_type")
    spans = ev.where("event_type = 'error'").groupBy("user_id", F.floor(F.col("event_id") / 64).alias("blk")).agg(F.min("event_id").alias("run_start"), F.max("event_id").alias("run_end"))
    return D.uncovered(ev.select("event_id", "user_id"), spans, "user_id", n="event_id")


@bound(f"""WITH {VERSIONS} SELECT k AS l_orderkey, 'delete' AS side, n::int AS line_no FROM old WHERE f = 'R' AND NOT EXISTS (SELECT 1 FROM hm WHERE hm.k = old.k AND n BETWEEN a_start AND a_end)
UNION ALL SELECT k, 'add', n::int FROM new WHERE again = 1 AND NOT EXISTS (SELECT 1 FROM hm WHERE hm.k = new.k AND n BETWEEN b_start AND b_end)""")
def unmapped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted and added lines in no paired hunk."""
    l = dealt(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = l.select("l_orderkey", "l_returnflag", F.row_number().over(w).alias("o"))
    # both versions of _versions() from one row of the table, in the part that its order was dealt to
    line = lambda side, again, changed: F.struct(F.lit(side).alias("side"), F.lit(again).alias("again"), changed.alias("changed"))
    flag = F.col("l_returnflag")
    kept = F.when(flag != "R", line("add", 0, F.lit(False)))
    both = F.array_compact(F.array(line("delete", 0, flag == "R"), kept, F.when(flag == "N", line("add", 1, F.lit(True)))))
    lines = l.select("l_orderkey", "o", F.explode(both).alias("x")).select("l_orderkey", "o", "x.*")
    return D.unpaired(lines, "l_orderkey", order=("o", "again"))


@bound("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = string_split(p_name, ' ')[1] THEN p_brand ELSE w END), chr(10)) AS code FROM part""")
def statements_back(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names as statements, the first one replaced by what a map gives."""
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", D.transform_back(words, F.create_map(words[0], F.col("p_brand"))).alias("code"))


def _turn_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A patch for each two turns in a row: the first's lines deleted, the second's added after an equal line."""
    c = table(spark, sf, "conversations").where("text is not null")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("new", F.lead("text").over(w)).where("new is not null")
    old_n, new_n = F.size(F.split("text", "\n", -1)), F.size(F.split("new", "\n", -1))
    head = F.concat(F.lit("diff --git a/f.c b/f.c\n--- a/f.c\n+++ b/f.c\n@@ -1,"), old_n + 1, F.lit(" +1,"), new_n + 1, F.lit(" @@\n same\n"))
    body = F.concat(F.lit("-"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n-")), F.lit("\n+"), F.replace(F.col("new"), F.lit("\n"), F.lit("\n+")))
    return c.select("conv_id", "turn", F.concat(head, body).alias("text"))


TURNS = """t AS (SELECT conv_id, turn, text AS old, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations WHERE text IS NOT NULL),
p AS (SELECT * FROM t WHERE new IS NOT NULL),
d AS (SELECT conv_id, turn, 'delete' AS side, unnest(string_split(old, chr(10))) AS text, generate_subscripts(string_split(old, chr(10)), 1) + 1 AS line_no FROM p
  UNION ALL SELECT conv_id, turn, 'add', unnest(string_split(new, chr(10))), generate_subscripts(string_split(new, chr(10)), 1) + 1 FROM p)"""


@bound(f"WITH {TURNS} SELECT conv_id, turn, side, line_no::int AS line_no, text FROM d")
def diff_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Added and deleted lines of patches made from turns of conversations."""
    return D.parse_diff(_turn_diffs(spark, sf), "conv_id", "turn").select("conv_id", "turn", "side", "line_no", "text")


@bound(f"WITH {TURNS} SELECT conv_id, turn, count(*) FILTER (side = 'add') AS n_add, count(*) FILTER (side = 'delete') AS n_delete, max(length(text))::int AS longest FROM d GROUP BY conv_id, turn")
def diff_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that each patch adds and deletes."""
    d = D.parse_diff(_turn_diffs(spark, sf), "conv_id", "turn")
    return d.groupBy("conv_id", "turn").agg(F.count_if(F.col("side") == "add").alias("n_add"), F.count_if(F.col("side") == "delete").alias("n_delete"), F.max(F.length("text")).alias("longest"))


@bound(f"WITH {TURNS} SELECT conv_id, turn, 'same' || chr(10) || new AS text FROM p")
def apply_patches(spark: SparkSession, sf: str) -> DataFrame:
    """The patches applied to the first turns give the second ones."""
    p = _turn_diffs(spark, sf)
    old = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("same\n"), "text").alias("text"))
    return D.apply_patches(old.join(p.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi"), D.parse_diff(p, "conv_id", "turn"), "conv_id", "turn")


@bound("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::int AS file_idx, 'diff --git a/' || role || ' b/' || role || chr(10) || text AS section FROM conversations WHERE text IS NOT NULL""")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as patches of several files, cut at their headers again."""
    c = table(spark, sf, "conversations").where("text is not null")
    part = F.concat(F.lit("diff --git a/"), "role", F.lit(" b/"), "role", F.lit("\n"), "text")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return D.split_files(whole, "conv_id").withColumn("file_idx", F.col("file_idx").cast("int"))


@bound("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS r FROM (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS norm, text FROM documents))
SELECT a.doc_id, b.doc_id AS first_id, a.text = b.text AS identical FROM t a JOIN t b ON a.norm = b.norm AND b.r = 1 WHERE a.r > 1""")
def exact_match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents equal to an earlier one but for white space, by a hash of what is left, then compared."""
    d = table(spark, sf, "documents", "doc_id", "text").withColumn("norm", F.sha2(T.normalize(F.col("text"), False), 256))
    first = d.groupBy("norm").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("norm", "first_id")
    pairs = d.join(first, "norm").where("doc_id > first_id")
    b = d.select(F.col("doc_id").alias("first_id"), F.col("text").alias("other"))
    return pairs.join(b, "first_id").where(T.exact_match(F.col("text"), F.col("other"))).select("doc_id", "first_id", (F.col("text") == F.col("other")).alias("identical"))


@bound("""SELECT doc_id, length(array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)))::int AS third_line_offset,
(length(left(text, 500)) - length(replace(left(text, 500), chr(10), '')) + 1)::int AS line_at_500 FROM documents""")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where a document's third line is cut off, and the line at offset 500."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", T.line_offset(F.col("text"), F.lit(3)).alias("third_line_offset"), T.offset_line(F.col("text"), F.lit(500)).alias("line_at_500"))


# --- Text -------------------------------------------------------------------------------------------------------------

WS = r"[ \t\n\r\f\v]"


@bound(f"""SELECT page_id, length(regexp_replace(html, '{WS}+', '', 'g'))::int AS n_solid, length(regexp_replace(html, ',{WS}*', ', ', 'g'))::int AS n_params,
length(replace(html, chr(10), ''))::int AS n_unbroken, regexp_replace(regexp_replace(html, '(^|\\n){WS}*\\n', '\\1', 'g'), '(^|\\n){WS}*\\n', '\\1', 'g') AS filled FROM pages""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    """T4, T5: pages without white space and line feeds, as lengths, and without empty lines."""
    p, h = table(spark, sf, "pages", "page_id", "html"), F.col("html")
    return p.select("page_id", F.length(T.normalize(h, False)).alias("n_solid"), F.length(T.remove_param_linebreaks(h)).alias("n_params"), F.length(T.remove_linebreaks(h)).alias("n_unbroken"), T.remove_empty_lines(h).alias("filled"))


def _code(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, code): a part as code with two comments, and two literals that look like comments."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    l = F.lit
    return p.select("p_partkey", F.concat(l("f("), "p_size", l("); // "), "p_name", l('\n"a // '), "p_brand", l('" /* '), "p_type", l("\n*/ x = '/*';\n")).alias("code"))


BARE = """'f(' || p_size || '); ' || chr(10) || '"a // ' || p_brand || '"  x = ''/*'';' || chr(10)"""


@bound(f"SELECT p_partkey, {BARE} AS bare, regexp_replace({BARE}, '{WS}+', '', 'g') AS solid, {BARE} AS tokens FROM part")
def code_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as code without comments, by replacing them and by tokens, and without white space."""
    c = F.col("code")
    return _code(spark, sf).select("p_partkey", T.remove_comments(c).alias("bare"), T.normalize(c).alias("solid"), T.code_only(c).alias("tokens"))


@bound("""SELECT p_partkey, '// ' || p_name AS comment FROM part UNION ALL SELECT p_partkey, '/* ' || p_type || chr(10) || '*/' FROM part""")
def code_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct comments, literals being skipped."""
    return _code(spark, sf).select("p_partkey", F.explode(T.comments(F.col("code"))).alias("comment"))


@bound("""SELECT p_partkey, ' int f' || p_size || '( int a) { return 1;' || repeat(chr(10), 2) || '#include <' || p_brand || '>' || chr(10) || 'UNUSEDX; void g();' AS code, '<' || p_brand || '>' AS included FROM part""")
def macros(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as code without macros, and what it includes."""
    l = F.lit
    code = F.concat(l("R_API int f"), "p_size", l("(IN int a) {\\\n  return 1;\n#define X\n#include <"), "p_brand", l(">\nUNUSEDX; METHODDEF(void) g();"))
    return table(spark, sf, "part").select("p_partkey", T.del_macros(code).alias("code"), F.array_join(T.includes(code), ",").alias("included"))


@bound("""SELECT p_partkey, 'if(x){' || chr(10) || '{' || chr(10) || p_name || '}' || chr(10) || ';}' || chr(10) || 'y' AS code FROM part""")
def brackets(spark: SparkSession, sf: str) -> DataFrame:
    """Brackets around two nested bodies whose spans are given."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("if(x)"), "p_name", F.lit(";y")).alias("code"), F.octet_length("p_name").alias("n"))
    span = lambda e: F.struct(F.lit(5).alias("start"), e.alias("end"))
    return T.bracketed(p.withColumn("spans", F.array(span(F.col("n") + 5), span(F.col("n") + 4))), "code", "spans", "p_partkey")


@bound("""SELECT p_partkey, 'c' AS language, 'int a  = ' || p_size || ';' || chr(10) || 'g();' || chr(10) AS code FROM part
UNION ALL SELECT p_partkey, 'java', 'b .c(' || p_size || ') .d();' || chr(10) || '@A' || chr(10) || 'e();' || chr(10) FROM part""")
def formatted_code(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as C and Java, in one form: no comments and macros, a statement a line, no empty lines."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    c = p.select("p_partkey", F.lit("c").alias("language"), F.concat(F.lit("int a // "), "p_name", F.lit("\n  = "), "p_size", F.lit(";\n\n#define X\ng();\n")).alias("code"))
    java = p.select("p_partkey", F.lit("java").alias("language"), F.concat(F.lit("b\n .c("), "p_size", F.lit(")\n .d(); /* "), "p_name", F.lit(" */\n@A\ne();\n")).alias("code"))
    java = java.withColumn("code", F.regexp_replace("code", r" /\*", "/*"))
    return T.formatted(c, "code", "p_partkey", "language").unionByName(T.formatted(java, "code", "p_partkey", "language", language="java"))


@bound("""SELECT page_id, CASE WHEN contains(url, 'ghostscript') THEN 'ghostscript' WHEN contains(url, 'gitlab') THEN 'gitlab' ELSE 'github' END AS kind,
regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', '@@', 'g') AS path FROM pages""")
def split_key_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds and parts of addresses."""
    p, u = table(spark, sf, "pages", "page_id", "url"), F.col("url")
    return p.select("page_id", T.repo_host(u).alias("kind"), F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.replace(F.regexp_extract(u, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"), F.lit("@@")).alias("path"))


@bound("""WITH u AS (SELECT 'https://github.com/o' || (c_nationkey) || '/r' || (c_custkey) || '/commit/' || md5(c_name) || CASE WHEN c_custkey % 2 = 0 THEN '#diff-1' ELSE '' END AS a, 'https://github.com/o/r/commit/' || md5(c_mktsegment) AS b, c_custkey FROM customer)
SELECT 'C' || c_custkey AS CVE_ID, replace(regexp_replace(replace(a, 'https://github.com/', ''), '/commit/.*$', ''), '/', '@@') AS repo_name,
regexp_replace(regexp_extract(a, '/commit/(.*)$', 1), '#diff.*$', '') AS pre_commit, regexp_extract(b, '/commit/(.*)$', 1) AS post_commit, 'github' AS repohost FROM u""")
def work_table(spark: SparkSession, sf: str) -> DataFrame:
    """A work table with two addresses in a cell, made from customers."""
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    a = F.concat(F.lit("https://github.com/o"), "c_nationkey", F.lit("/r"), "c_custkey", F.lit("/commit/"), F.md5("c_name"), F.when(F.col("c_custkey") % 2 == 0, "#diff-1").otherwise(""))
    raw = c.select(F.concat(F.lit("C"), "c_custkey").alias("CVE_ID"), F.concat(a, F.lit("\nhttps://github.com/o/r/commit/"), F.md5("c_mktsegment")).alias("patch"), F.lit(None).cast("string").alias("TOOL_R2"))
    return P.work_items(raw).drop("tool_results")


@bound("""SELECT conv_id, turn, list_sort(string_split(text, ','))[1] IS NOT NULL AS some, u.pos::int AS pos, trim(u.item) AS item FROM conversations,
LATERAL (SELECT unnest(string_split(text, ',')) AS item, generate_subscripts(string_split(text, ','), 1) - 1 AS pos) u WHERE text IS NOT NULL""")
def answer_items(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated answers as ranked items."""
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.lit(True).alias("some"), F.posexplode(T.answer_items(F.col("text"))).alias("pos", "item"))


@bound("""WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.c' WHEN 1 THEN '.hpp' WHEN 2 THEN '.txt' WHEN 3 THEN '.C' ELSE '' END AS name FROM part)
SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS allowed, regexp_replace(trim(name || ' #x'), '[\\s#?/].*$', '') AS id, 'old/' || replace(name, ' ', '_') AS old_file, replace(name, ' ', '_') AS new_file FROM n""")
def name_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Extension rule, scrubbing of ids and names in a header, on part names with extensions."""
    p = table(spark, sf, "part", "p_partkey", "p_name")
    ext = F.element_at(F.array(*map(F.lit, (".c", ".hpp", ".txt", ".C", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = p.select("p_partkey", F.concat("p_name", ext).alias("name"))
    plain = F.replace(F.col("name"), F.lit(" "), F.lit("_"))
    old, new = P.file_header(F.concat(F.lit("diff --git a/old/"), plain, F.lit(" b/"), plain, F.lit("\n--- a/x")))
    return p.select("p_partkey", P.allowed(F.col("name")).alias("allowed"), P.scrub_commit(F.concat("name", F.lit(" #x"))).alias("id"), old.alias("old_file"), new.alias("new_file"))


# --- Sources ----------------------------------------------------------------------------------------------------------


@bound("""WITH c AS (SELECT c_custkey AS k, 'r' || c_nationkey AS repo, c_custkey % 7 AS v, c_name AS t FROM customer)
SELECT c.k, c.t AS old_text, n.t AS new_text FROM c LEFT JOIN c n ON n.k = c.k + 1 AND n.repo = c.repo""")
def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of two versions of a file, customers being files of their nations."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("r"), "c_nationkey").alias("repo"), (F.col("c_custkey") % 7).alias("commit"), F.concat(F.lit("f"), "c_custkey").alias("path"), F.col("c_name").alias("text"))
    f = c.select("k", "repo", F.col("commit").alias("pre_commit"), ((F.col("k") + 1) % 7).alias("post_commit"), F.col("path").alias("old_file"), F.concat(F.lit("f"), F.col("k") + 1).alias("new_file"))
    return P.with_blobs(f, c.drop("k")).select("k", "old_text", "new_text")


@bound("""WITH t AS (SELECT conv_id * 100 + turn AS k, turn % 4 AS m, role FROM conversations)
SELECT k, CASE m WHEN 0 THEN '-' || role || chr(10) || '+x' WHEN 1 THEN 'diff --git a/f b/f' || chr(10) || '+' || role END AS diff, CASE WHEN m < 2 THEN 'found' WHEN m = 2 THEN 'wrong_answer' ELSE 'not_found' END AS status FROM t""")
def answer_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Diffs in answers: fenced, bare, none at all, no answer."""
    m = F.col("turn") % 4
    text = F.when(m == 0, F.concat(F.lit("so\n```diff\n-"), "role", F.lit("\n+x\n```\nend"))).when(m == 1, F.concat(F.lit("see\ndiff --git a/f b/f\n+"), "role")).when(m == 2, F.concat(F.lit("no "), "role"))
    return P.answer_diffs(table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), text.alias("text")), "k")


@bound("""SELECT n_nationkey AS k, v AS version, 'p' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_regionkey::int AS src_line, NULL::int AS tgt_line, 2::bigint AS n_points FROM nation, (VALUES ('pre'), ('post')) t(v)""")
def call_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Points and edges of nested call graphs, one a nation, with a line that is missing."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("p"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"), F.col("n_regionkey").cast("string").alias("r"))
    g = F.struct(F.array("a", "b").alias("points"), F.array(F.array("a", "b", "r")).alias("edges"))
    points, edges = P.call_graph(n.select("k", g.alias("pre"), g.alias("post")), "k")
    return edges.join(points.groupBy("k", "version").agg(F.count("node").alias("n_points")), ["k", "version"])


@bound("""SELECT conv_id, v AS version, 0 AS path_id, (row_number() OVER (PARTITION BY conv_id, v ORDER BY turn) - 1)::int AS pos, role AS file, 'm' || turn AS method, turn::int AS line FROM conversations, (VALUES ('pre'), ('post')) t(v)""")
def taint_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of nested traces, a conversation being one and its turns the nodes."""
    node = F.struct(F.col("role").alias("file"), F.concat(F.lit("m"), "turn").alias("method"), F.col("turn").cast("int").alias("lineNumber"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"])
    c = table(spark, sf, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.array(path).alias("pre")).withColumn("post", F.col("pre"))
    return P.taint_nodes(c, "conv_id")


@bound("""SELECT n_regionkey AS k, 'r"' || n_regionkey || chr(92) AS src, n_name AS dst FROM nation""")
def dot_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """regions' nations as DOT graphs and back, with quotes and backslashes in names."""
    e = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.concat(F.lit('r"'), "n_regionkey", F.lit("\\")).alias("src"), F.col("n_name").alias("dst"))
    return P.dot_edges(P.to_dot(e, "k").withColumnRenamed("dot", "text"), "k").drop("pos")


@bound("""SELECT user_id, tool, event_id::int AS found_sec, crash_id, n, sig FROM (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'aflgo' WHEN 'signup' THEN 'beacon' END AS tool, lpad((event_id % 1000000)::varchar, 6, '0') AS crash_id, event_id AS n, 6::int AS sig FROM events)""")
def fuzz_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Found crashes of logs, an event being a log with a heading or without, and the parts of their names."""
    head = F.when(F.col("event_type") == "error", "# AFLGo\n").when(F.col("event_type") == "signup", "## beacon\n").otherwise("")
    name = F.concat(F.lit("id:"), F.lpad((F.col("event_id") % 1_000_000).cast("string"), 6, "0"), F.lit(","), "event_id", F.lit(",sig:06,src:000004"))
    ev = table(spark, sf, "events").select("user_id", "event_id", name.alias("name"), F.lit("log.md").alias("file"), F.concat(head, F.lit("found at "), "event_id", F.lit(" sec.\nend")).alias("text"))
    found = P.fuzz_events(ev, "user_id", "event_id", "name")
    return found.select("user_id", "tool", "found_sec", *P.crash_name(F.col("name"))[:3])


@bound("""SELECT c_custkey AS k, 'c' AS op, c_nationkey::int AS old_start, (c_nationkey + 1)::int AS old_end, s AS side, CASE s WHEN '<' THEN c_name ELSE c_mktsegment END AS text, c_nationkey::int AS src_line FROM customer, (VALUES ('<'), ('>')) t(s)""")
def tool_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of diffs in normal format, and node mappings, made from customers."""
    c = table(spark, sf, "customer")
    d = c.select(F.col("c_custkey").alias("k"), F.concat("c_nationkey", F.lit(","), F.col("c_nationkey") + 1, F.lit("c7\n< "), "c_name", F.lit("\n---\n> "), "c_mktsegment").alias("text"))
    m = c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("name: x  @ "), "c_nationkey", F.lit(" @ if  @ 9 @ ")).alias("text"))
    return P.normal_diff(d, "k").select("k", "op", "old_start", "old_end", "side", "text").join(P.node_mapping(m, "k").select("k", "src_line"), "k")


@bound("""SELECT user_id, event_id, 'Error' AS level, event_type AS name, 'at ' || event_id AS message, (event_id % 100)::int AS offset FROM events WHERE event_type = 'error'""")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Errors among nested diagnostics."""
    msg = F.struct(F.concat(F.lit("at "), "event_id").alias("Message"), (F.col("event_id") % 100).cast("int").alias("FileOffset"))
    d = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "Error").otherwise("Warning").alias("Level"), F.col("event_type").alias("DiagnosticName"), msg.alias("DiagnosticMessage"))
    return P.errors_of(d, "user_id", "event_id")


@bound("""WITH d AS (SELECT DISTINCT ON (item_id) item_id, text FROM benchmark) SELECT c_custkey, n.text AS description FROM customer LEFT JOIN d n ON n.item_id = c_custkey""")
def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the text of the benchmark item of their number, if there is one."""
    d = table(spark, sf, "benchmark").select(F.col("item_id").alias("c_custkey"), F.col("text").alias("description"))
    return P.with_description(table(spark, sf, "customer", "c_custkey"), d, "c_custkey")


@bound("""SELECT a.conv_id, 'q' AS "left", 'a' AS "right", a.text = b.text AS is_same FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn = 1""")
def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """The first turns of a conversation as two artifacts to compare."""
    c = table(spark, sf, "conversations").select("conv_id", F.when(F.col("turn") == 0, "q").when(F.col("turn") == 1, "a").otherwise("-").alias("name"), "text")
    return P.compare_artifacts(c, [("q", "a")], "conv_id")


# --- Graphs -----------------------------------------------------------------------------------------------------------


@bound("""WITH e AS (SELECT user_id, event_type AS src, lead(event_type) OVER w AS dst, event_id AS s, lead(event_id) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT src, dst, count(*) AS n_pairs, min(s) AS first_s, max(t) AS last_t FROM e WHERE dst IS NOT NULL GROUP BY src, dst""")
def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """G1: edges between the types of a user's events in a row; parallel edges are counted by user and summed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.col("event_id").alias("src_line"), F.lead("event_id").over(w).alias("tgt_line")).where("dst is not null")
    g = G.build_graph(e, "user_id").select("src", "dst", "pairs", F.array_max(F.transform("pairs", lambda x: x["t"])).alias("t"))
    return g.groupBy("src", "dst").agg(F.sum(F.size("pairs")).alias("n_pairs"), F.min(F.col("pairs")[0]["s"]).alias("first_s"), F.max("t").alias("last_t"))


def _tree(spark: SparkSession, sf: str, leaf: str = "supplier") -> DataFrame:
    """Edges region -> nation -> supplier (or customer)."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    key, own = ("s_suppkey", "s_nationkey") if leaf == "supplier" else ("c_custkey", "c_nationkey")
    s = table(spark, sf, leaf).select(F.concat(F.lit("n"), own).alias("src"), F.concat(F.lit("s"), key).alias("dst"))
    return n.unionByName(s)


TREE = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@bound(f"""WITH {TREE}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT 'n' || n_nationkey FROM nation)
SELECT node, node NOT IN (SELECT dst FROM e) AS is_source, node NOT IN (SELECT src FROM e) AS is_sink FROM v WHERE node NOT IN (SELECT dst FROM e) OR node NOT IN (SELECT src FROM e)""")
def graph_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Sources and sinks of the tree of regions, nations and suppliers."""
    e = _tree(spark, sf)
    return G.ends(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")), e)


PATHS = f"""WITH RECURSIVE {TREE}, p AS (
  SELECT src AS node, [src] AS path FROM e WHERE src LIKE 'r%' GROUP BY src
  UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst))
SELECT array_to_string(path, '>') AS path, len(path)::int AS n_nodes FROM p WHERE node NOT IN (SELECT src FROM e)"""


def _shown(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join("node_path", ">").alias("path"), F.size("node_path").alias("n_nodes"))


@bound(PATHS)
def graph_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All paths from sources to sinks of the tree."""
    e = _tree(spark, sf)
    ends = G.ends(e.select(F.col("src").alias("node")), e)
    return _shown(G.simple_paths(e, ends.where("is_source"), ends.where("is_sink")))


@bound(PATHS.replace("len(path)::int AS n_nodes FROM p WHERE", "len(path)::int AS n_nodes FROM p WHERE list_contains(path, 'n7') AND"))
def graph_paths_target(spark: SparkSession, sf: str) -> DataFrame:
    """Those paths that lead through one nation."""
    e = _tree(spark, sf)
    ends = G.ends(e.select(F.col("src").alias("node")), e)
    return _shown(G.simple_paths(e, ends.where("is_source"), ends.where("is_sink"), through="n7"))


BIP = """b AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _orders_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers who met in an order."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    l = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


def _component(e: DataFrame) -> DataFrame:
    names = e.sparkSession.createDataFrame([("s1",)], "name string")
    return G.reach(e, G.seeds_containing(e.select(F.col("dst").alias("node")), names), directed=False)


def _links(e: DataFrame) -> DataFrame:
    own = e.where("src like 'c1%'")
    return G.touching(e, own.select(F.col("src").alias("node")).unionByName(own.select(F.col("dst").alias("node"))).distinct())


@bound(f"""WITH RECURSIVE {BIP}, u AS (SELECT src, dst FROM b UNION SELECT dst, src FROM b), r AS (
  SELECT dst AS node FROM b WHERE dst LIKE 's1%' UNION SELECT u.dst FROM r JOIN u ON u.src = r.node) SELECT node FROM r""")
def graph_component(spark: SparkSession, sf: str) -> DataFrame:
    """All customers and suppliers linked, in either direction, with suppliers whose name holds s1."""
    return _component(_orders_graph(spark, sf))


@bound(f"WITH {BIP} SELECT src, dst FROM b WHERE src LIKE 'c1%' OR dst IN (SELECT dst FROM b WHERE src LIKE 'c1%')")
def graph_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Links with either end among the customers c1... or their suppliers."""
    return _links(_orders_graph(spark, sf))


@bound("""SELECT u.node AS name, min(p.node) AS node FROM (SELECT 'n' || n_nationkey AS node FROM nation) u JOIN (SELECT 'root/n' || n_nationkey || '/s' || s_suppkey AS full, 'root/r' || n_regionkey || '/n' || n_nationkey AS node FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey) p ON ends_with(p.node, '/' || u.node) GROUP BY u.node""")
def suffix_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The first point that ends in a wanted name."""
    n = table(spark, sf, "nation")
    points = n.select(F.concat(F.lit("root/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("node"))
    return G.resolve_suffix(points, n.select(F.concat(F.lit("n"), "n_nationkey").alias("name")))


FLOWS = """SELECT s.user_id, s.event_type, s.event_id AS src_line, d.event_id AS dst_line FROM events s JOIN events d ON d.user_id = s.user_id AND d.event_id > s.event_id AND d.event_id < s.event_id + 3000"""


@bound(FLOWS + " AND d.event_type = s.event_type")
def taint_window_same(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events of one type, the second within 3000 ids after the first."""
    ev = table(spark, sf, "events", "user_id", "event_type", "event_id")
    return G.window_flows(ev, "user_id", "event_type", "event_id", F.col("s.event_id"), F.col("s.event_id") + 3000, span=3000)


@bound(FLOWS + " AND d.event_type = 'purchase' AND s.event_type = 'signup'")
def taint_window(spark: SparkSession, sf: str) -> DataFrame:
    """Signups and the same user's purchases within 3000 ids."""
    ev = table(spark, sf, "events", "user_id", "event_type", "event_id")
    sink = (F.col("d.event_type") == "purchase") & (F.col("s.event_type") == "signup")
    return G.window_flows(ev, "user_id", "event_type", "event_id", F.col("s.event_id"), F.col("s.event_id") + 3000, sink, span=3000)


@bound("""WITH s AS (SELECT user_id, event_id FROM events WHERE event_type = 'signup'), t AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, event_id AS line FROM s UNION ALL SELECT e.user_id, e.event_id FROM events e JOIN t ON t.user_id = e.user_id WHERE e.event_id < t.m AND e.user_id NOT IN (SELECT user_id FROM s)""")
def taint_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Signups, or for users without any all events before their last purchase."""
    ev = table(spark, sf, "events", "user_id", "event_type", "event_id").withColumnRenamed("event_id", "line")
    pick = lambda t: ev.where(F.col("event_type") == t).select("user_id", "line")
    return G.sources_or_earlier(ev.select("user_id", "line"), pick("signup"), pick("purchase"), "user_id")


@bound(f"""WITH {TREE} SELECT 'r' || n_regionkey || '>n' || n_nationkey || '>s' || s_suppkey AS path, 'r' || n_regionkey || '>n' || n_nationkey || ':' || n_nationkey || ',n' || n_nationkey || '>s' || s_suppkey || ':' || s_suppkey AS hops FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def graph_path_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Paths from regions to suppliers with the lines of their edges."""
    e = _tree(spark, sf)
    line = F.regexp_extract("dst", r"(\d+)$", 1).cast("int")
    g = G.build_graph(e.withColumns({"src_line": line, "tgt_line": line}))
    sup = e.select(F.col("dst").alias("node")).where("node like 's%'")
    paths = G.simple_paths(e, e.select(F.col("src").alias("node")).where("node like 'r%'"), sup)
    hops = F.transform("edge_path", lambda x: F.concat(x["caller"], F.lit(">"), x["callee"], F.lit(":"), x["source_tgt_pairs"][0]["s"]))
    return G.paths_with_lines(paths, g).select(F.array_join("node_path", ">").alias("path"), F.array_join(hops, ",").alias("hops"))


@bound("""WITH v AS (SELECT * FROM (VALUES ('pre'), ('post')) t(version)), s AS (SELECT n_regionkey AS k, n_nationkey AS n, s_suppkey AS x FROM nation JOIN supplier ON s_nationkey = n_nationkey)
SELECT s.k, version, 's' || x || '>n' || n || '>a/f#r' || k AS path FROM s, v WHERE version = 'pre' OR n % 2 = 0""")
def trigger_paths(spark: SparkSession, sf: str) -> DataFrame:
    """For each region and version all paths from suppliers to the region's trigger, which is named by the old version
    alone; the new version has lost the nations of odd number."""
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "k")
    sup = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("k", "n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.concat(F.lit("s"), "s_suppkey").alias("src"))
    top = n.select("k", "n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("a/f#r"), "k").alias("dst"))
    both = top.unionByName(sup)
    edges = both.withColumn("version", F.lit("pre")).unionByName(both.where("n_nationkey % 2 = 0 or src like 's%'").withColumn("version", F.lit("post")))
    points = top.select("k", F.lit("pre").alias("version"), F.col("dst").alias("node")).unionByName(top.select("k", F.lit("post").alias("version"), F.lit("b/f#r0").alias("node"))).distinct()
    starts = sup.select("k", F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("version"), F.col("src").alias("node"))
    wanted = n.select("k", F.concat(F.lit("f#r"), "k").alias("name")).distinct()
    return G.trigger_paths(points, edges, starts, wanted, "k").select("k", "version", F.array_join("node_path", ">").alias("path"))


def _turn_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as trees: a root over turns of ten bytes each."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    turns = c.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("id"), F.lit(1).alias("depth"), F.col("role").alias("type"), (F.col("turn") * 10).alias("start_byte"), (F.col("turn") * 10 + 10).alias("end_byte"))
    root = turns.groupBy("doc").agg(F.lit(0).cast("long").alias("id"), F.lit(0).alias("depth"), F.lit("root").alias("type"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))
    return turns.unionByName(root)


@bound("""WITH t AS (SELECT conv_id AS doc, turn + 1 AS id, role AS type, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, 'root', 0 FROM conversations)
SELECT doc, id, o::int AS "order", c AS capture FROM t JOIN (VALUES ('root', 'any'), ('user', 'any'), ('user', 'asked'), ('assistant', 'any')) x(type, c) ON x.type = t.type""")
def node_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Node tables: nodes in order of a walk, and what captures by type find."""
    n = _turn_nodes(spark, sf)
    found = G.captures(n, {"any": ("root", "user", "assistant"), "asked": ("user",)}, "doc").select("doc", "id", "capture")
    return G.pre_order(n, "doc").select("doc", "id", "order").join(found, ["doc", "id"])


@bound("SELECT user_id AS id, min(event_id) AS first_id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id")
def node_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Node tables: nodes of two types, one row an id."""
    n = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("first_id"))
    return G.distinct_nodes(G.select_nodes(n, "error", "purchase"), "first_id").select("id", "first_id")


@bound("""SELECT conv_id AS doc, turn AS id, role AS type FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1""")
def node_select(spark: SparkSession, sf: str) -> DataFrame:
    """Node tables: the first child of one type, a conversation being a parent of its turns."""
    c = table(spark, sf, "conversations")
    n = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.lit(-1).cast("long").alias("parent"), F.col("role").alias("type"), F.col("turn").alias("start_byte"))
    roots = n.select("doc", "parent").distinct().select("doc", F.col("parent").alias("id"))
    return G.children(n, roots, "assistant", first=True).select("doc", "id", "type")


RANK = f"""WITH {TREE}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::double AS n FROM v), d AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
r0 AS (SELECT node, 1 / n AS rank FROM v, n)""" + "".join(f""",
r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM d)) / n + 0.85 * coalesce(got, 0) AS rank
  FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / deg) AS got FROM e JOIN d USING (src) JOIN r{i} ON r{i}.node = src GROUP BY dst) g ON g.dst = v.node)""" for i in range(20)) + " SELECT node, round(rank, 9) AS rank FROM r20"


@bound(RANK)
def rank_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty rounds of PageRank on the tree."""
    return G.pagerank(_tree(spark, sf)).withColumn("rank", F.round("rank", 9))


# --- Merging ----------------------------------------------------------------------------------------------------------

def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    """A snippet for each order and return flag: its lines, marked + or - by flag, unmarked for N."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity")
    mark = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("")
    line = F.concat(mark, F.lit("q"), (F.col("l_quantity") % 4).cast("int"))
    rows = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return rows.select((F.col("l_orderkey") % 500).alias("grp"), F.col("l_orderkey").alias("snip"), "text")


LINES = """l AS (SELECT l_orderkey % 500 AS grp, l_orderkey AS snip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '' END || 'q' || (l_quantity % 4)::int) - 1 AS pos,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '' END || 'q' || (l_quantity % 4)::int AS line, l_returnflag <> 'N' AS marked FROM lineitem),
g AS (SELECT *, coalesce(sum((NOT marked)::int) OVER (PARTITION BY snip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM l)"""


@bound(f"WITH {LINES} SELECT grp, snip, pos::int AS pos, line, marked, gap::int AS gap FROM g")
def gap_split(spark: SparkSession, sf: str) -> DataFrame:
    """M1: lines of snippets with the number of unmarked lines before them."""
    return M.split_gaps(_snippets(spark, sf), "grp", "snip")


@bound(f"""WITH {LINES}, b AS (SELECT grp, snip, coalesce(list(line ORDER BY pos) FILTER (NOT marked), []) AS base FROM g GROUP BY grp, snip HAVING bool_or(marked)),
m AS (SELECT grp, snip, gap, line, min(pos) AS pos FROM g WHERE marked GROUP BY ALL),
k AS (SELECT grp, base, min(snip) AS first_snippet, count(*) AS n_snippets FROM b GROUP BY grp, base),
x AS (SELECT k.grp, k.base, m.gap, 0 AS kind, m.snip, m.pos, m.line FROM k JOIN b ON b.grp = k.grp AND b.base = k.base JOIN m ON m.snip = b.snip
  UNION ALL SELECT k.grp, k.base, i - 1, 1, 0, i - 1, k.base[i] FROM k, LATERAL (SELECT unnest(range(1, len(k.base) + 1)) AS i))
SELECT x.grp, first_snippet, n_snippets, string_agg(line, chr(10) ORDER BY gap, kind, snip, pos) AS merged FROM x JOIN k ON k.grp = x.grp AND k.base = x.base GROUP BY x.grp, x.base, first_snippet, n_snippets""")
def gap_merge(spark: SparkSession, sf: str) -> DataFrame:
    """M2: snippets of a group with equal unmarked lines, merged."""
    return M.merge_snippets(_snippets(spark, sf), "grp", "snip")


@bound("""WITH o AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT event_id, user_id, event_type FROM o WHERE prev IS NULL OR prev <> event_type""")
def render_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """M3: a user's events without those of the same type as the one before."""
    ev = table(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    return M.drop_consecutive(ev, "event_type", ["ts", "event_id"], "user_id").select("event_id", "user_id", "event_type")


@bound("""WITH o AS (SELECT l_orderkey, l_linenumber AS line, l_partkey AS p, l_returnflag AS f, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)
SELECT l_orderkey, string_agg(CASE WHEN f = 'R' THEN '-   ' ELSE '' END || p, chr(10) ORDER BY line, pos) AS rendered FROM o WHERE prev IS NULL OR prev <> line GROUP BY l_orderkey""")
def render_trace(spark: SparkSession, sf: str) -> DataFrame:
    """M3: orders as traces; a returned line is a changed one. The file is the order, the text a part number."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    n = l.select("l_orderkey", F.concat_ws("/", "l_orderkey", pos).alias("file"), F.col("l_linenumber").alias("line"), pos.alias("pos"), F.col("l_partkey").cast("string").alias("text"), "l_returnflag")
    return M.render_trace(n.drop("l_returnflag"), n.where("l_returnflag = 'R'").select("file", "line"), "-", "l_orderkey")


@bound("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """M4: distinct event types of a user at their first place."""
    return M.first_distinct(table(spark, sf, "events", "user_id", "event_type", "event_id"), "event_type", "event_id", "user_id")


@bound("""WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN greatest(a, b) >= 5 THEN 'modified' ELSE 'all' END AS mode FROM n""")
def size_gate(spark: SparkSession, sf: str) -> DataFrame:
    """M5: orders with five lines or more on one side."""
    n = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    return n.select("l_orderkey", M.size_gate(F.col("a"), F.col("b"), 5).alias("mode"))


@bound("""WITH d AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Warning' END AS level, 'use of undeclared identifier ''' || CASE WHEN event_id % 3 = 0 THEN 'ABC' ELSE 'abc' END || ''' ' || (event_id % 11) AS message FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM d WHERE level = 'Error' AND NOT message LIKE '%ABC%' AND message NOT LIKE '% 7') SELECT user_id, event_id, message FROM f WHERE r = 1""")
def fault_first(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first error event that counts, messages being made from ids."""
    ev = table(spark, sf, "events", "user_id", "event_id", "event_type")
    msg = F.concat(F.lit("use of undeclared identifier '"), F.when(F.col("event_id") % 3 == 0, "ABC").otherwise("abc"), F.lit("' "), F.col("event_id") % 11)
    d = ev.select("user_id", "event_id", F.when(F.col("event_type") == "error", "Error").otherwise("Warning").alias("level"), F.lit("n").alias("name"), msg.alias("message"))
    ignored = d.where(F.col("message").endswith(" 7")).select("message")
    return M.first_fault(d, ignored, "event_id", "user_id").select("user_id", "event_id", "message")


@bound("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS diff FROM conversations GROUP BY conv_id")
def concat_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """M8: texts of a conversation in order."""
    return M.concat_diffs(table(spark, sf, "conversations"), "turn", "text", "conv_id")


# --- Metrics ----------------------------------------------------------------------------------------------------------


@bound("SELECT category, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS category FROM part) WHERE category <> '' GROUP BY category")
def taxonomy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by the words of their type."""
    return E.category_counts(table(spark, sf, "part", "p_partkey", "p_type"), "p_type", " ", "p_partkey").select("category", "n")


@bound("""WITH c AS (SELECT s_nationkey::varchar AS category, count(*) AS n FROM supplier GROUP BY 1) SELECT f AS family, category, n FROM c JOIN (VALUES ('low', '0'), ('low', '1'), ('low', '2'), ('even', '0'), ('even', '2'), ('even', '4')) t(f, cat) ON cat = category""")
def taxonomy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by nation, under two families that overlap."""
    c = E.category_counts(table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("k")), "k")
    return E.roll_up(c, {"low": ["0", "1", "2"], "even": ["0", "2", "4"]})


SETS = """e AS (SELECT user_id % 10 AS fam, user_id, date_trunc('month', ts) AS m, event_type FROM events),
s AS (SELECT fam, user_id, coalesce(list(DISTINCT m) FILTER (event_type = 'purchase'), []) AS p, coalesce(list(DISTINCT m) FILTER (event_type = 'signup'), []) AS t FROM e GROUP BY fam, user_id),
c AS (SELECT fam, user_id, len(list_intersect(p, t)) AS tp, len(p) - len(list_intersect(p, t)) AS fp, len(t) - len(list_intersect(p, t)) AS fn, list_sort(p) = list_sort(t) AS exact FROM s)"""


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """Months in which a user purchased (predicted) and signed up (true), in ten families."""
    e = table(spark, sf, "events", "user_id", "ts", "event_type").withColumn("m", F.date_format("ts", "yyyy-MM"))
    pick = lambda t: F.collect_set(F.when(F.col("event_type") == t, F.col("m")))
    return e.groupBy((F.col("user_id") % 10).alias("fam"), "user_id").agg(pick("purchase").alias("p"), pick("signup").alias("t"))


@bound(f"WITH {SETS} SELECT fam, user_id, tp::int AS tp, fp::int AS fp, fn::int AS fn, exact FROM c")
def set_counts(spark: SparkSession, sf: str) -> DataFrame:
    """True and false positives of a user's months."""
    return E.set_counts(_sets(spark, sf), "p", "t", "fam", "user_id")


@bound(f"""WITH {SETS}, a AS (SELECT fam::varchar AS family, tp, fp, fn, exact FROM c UNION ALL SELECT 'all', tp, fp, fn, exact FROM c)
SELECT family, count(*) AS n, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, sum(exact::int)::bigint AS n_exact, sum(tp) / nullif(sum(tp) + sum(fp), 0) AS precision, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS recall, 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS f1 FROM a GROUP BY family""")
def set_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and metrics of the families and of all."""
    c = E.set_counts(_sets(spark, sf), "p", "t", "fam").withColumn("family", F.col("fam").cast("string")).drop("fam")
    return E.set_prf(E.with_all(c, "family"), "family")


@bound("""WITH r AS (SELECT lang AS family, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS tool, CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS label FROM labels JOIN documents USING (doc_id)),
s AS (SELECT family, tool, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp FROM r GROUP BY 1, 2), a AS (SELECT *, sum(tp) OVER (PARTITION BY family) AS every FROM s)
SELECT family, tool, tp, fp, tp / nullif(tp + fp, 0) AS precision, tp / nullif(every, 0) AS recall, 2 * tp / nullif(tp + fp + every, 0) AS f1 FROM a""")
def label_prf(spark: SparkSession, sf: str) -> DataFrame:
    """E5: a rule on length against quality labels, by language; recall over all good documents of a language."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents", "doc_id", "lang", "n_chars"), "doc_id")
    r = d.select(F.col("lang").alias("family"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("tool"), F.when(F.col("quality") == 1, "TP").otherwise("FP").alias("label"))
    return E.label_prf(r, "family", "tool", "label")


RATES = """SELECT o_orderpriority AS family, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_totalprice > 100000) AS big FROM orders GROUP BY 1"""


def _rate_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    flag = lambda c: c.cast("double")
    return o.select(F.col("o_orderpriority").alias("family"), flag(F.col("o_orderstatus") == "F").alias("finished"), flag(F.col("o_orderstatus") == "O").alias("open"), flag(F.col("o_totalprice") > 100000).alias("big"))


@bound(f"WITH r AS ({RATES}) SELECT family, 'finished' AS measure, n, f AS n_ok, f / n AS rate FROM r UNION ALL SELECT family, 'open', n, o, o / n FROM r UNION ALL SELECT family, 'big', n, big, big / n FROM r")
def rates_long(spark: SparkSession, sf: str) -> DataFrame:
    """Success rates of three measures by order priority."""
    return E.rates(_rate_rows(spark, sf), "family", ["finished", "open", "big"])


@bound(f"WITH r AS ({RATES}) SELECT family, f / n AS finished, o / n AS open, big / n AS big FROM r")
def rates_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The same side by side."""
    names = ["finished", "open", "big"]
    return E.pivot_rates(E.rates(_rate_rows(spark, sf), "family", names), "family", names)


@bound("""WITH u AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase')::double AS a, min(event_id) FILTER (event_type = 'error')::double AS b FROM events GROUP BY user_id), r AS (SELECT user_id % 7 AS family, a, b FROM u),
s AS (SELECT family, count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, avg(a) FILTER (a IS NOT NULL AND b IS NOT NULL) AS mean_a, avg(b) FILTER (a IS NOT NULL AND b IS NOT NULL) AS mean_b, count(a) / count(*) AS rate_a, count(b) / count(*) AS rate_b FROM r GROUP BY family)
SELECT family, n, n_both, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, rate_a, rate_b, round(abs((mean_b - mean_a) / nullif(mean_a, 0)), 9) AS time_change, round((rate_b - rate_a) / nullif(rate_a, 0), 9) AS rate_change FROM s""")
def time_to_event(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a user's first purchase and first error as times of two arms; -1 marks none."""
    ev = table(spark, sf, "events", "user_id", "event_id", "event_type")
    first = lambda t: F.coalesce(F.min(F.when(F.col("event_type") == t, F.col("event_id"))).cast("double"), F.lit(-1.0))
    u = ev.groupBy("user_id").agg(first("purchase").alias("a"), first("error").alias("b")).withColumn("family", F.col("user_id") % 7)
    t = E.time_to_event(u, "family", "a", "b")
    return t.withColumns({"mean_a": F.round("mean_a", 6), "mean_b": F.round("mean_b", 6), "time_change": F.round("time_change", 9), "rate_change": F.round("rate_change", 9)})


@bound("""SELECT p_partkey, list_bool_and(list_transform(string_split(p_name, ' '), lambda t: contains(t, left(p_type, 1)))) AS hit_all, list_bool_or(list_transform(string_split(p_name, ' '), lambda t: contains(t, lower(left(p_type, 1))))) AS hit_any,
list_bool_and(list_transform(string_split(p_name, ' '), lambda t: list_bool_or(list_transform(string_split(lower(p_type), ' '), lambda q: contains(q, left(t, 2)))))) AS covered FROM part""")
def substring_forall(spark: SparkSession, sf: str) -> DataFrame:
    """Part types' letters in all or any words of the name, and names covered by types."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    words, types = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    heads = F.transform(words, lambda w: F.concat(F.lit("dir/"), F.substring(w, 1, 2)))
    return p.select("p_partkey", E.hit_all(F.substring("p_type", 1, 1), words).alias("hit_all"), E.hit_any(F.lower(F.substring("p_type", 1, 1)), words).alias("hit_any"), E.covered(types, heads).alias("covered"))


@bound("""SELECT c_custkey, summary FROM (SELECT DISTINCT o_custkey AS c_custkey, 'error' AS summary FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, 'TIMEOUT' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def timeout_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a very large order failed, those without any order timed out."""
    c, o = table(spark, sf, "customer", "c_custkey"), table(spark, sf, "orders", "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    failed = o.where("o_totalprice > 300000").select("c_custkey").distinct().withColumn("summary", F.lit("error"))
    return E.ledger(c, o.select("c_custkey"), failed, "c_custkey")


@bound("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_items(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a finished order."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return E.pending(table(spark, sf, "customer", "c_custkey"), done, "c_custkey")


@bound("""SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1""")
def argmax_first(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's supplier with the largest balance, the first of equals."""
    return E.argmax_first(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey", "s_nationkey")


@bound("""WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) SELECT s_nationkey, n::int AS top_n, rank::int AS rank, s_suppkey, s_acctbal FROM r JOIN range(1, 6) t(n) ON rank <= n""")
def topn_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's best suppliers for cuts 1 to 5."""
    return E.top_n_sweep(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey", 5, "s_nationkey")


@bound("""SELECT p_brand, count(*) AS n, round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) AS unit, round(avg(l_tax / nullif(l_discount, 0)), 6) AS tax_per_discount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def ratio_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Mean ratios of order lines by brand; lines without discount are left out of the second."""
    l = table(spark, sf, "lineitem", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    j = l.join(table(spark, sf, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    r = E.ratio_by_category(j, "p_brand", {"unit": ("l_extendedprice", "l_quantity"), "tax_per_discount": ("l_tax", "l_discount")})
    return r.withColumns({"unit": F.round("unit", 6), "tax_per_discount": F.round("tax_per_discount", 6)})


@bound("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event."""
    return E.latest(table(spark, sf, "events", "user_id", "event_id", "event_type"), "event_id", "user_id")


@bound("""WITH f AS (SELECT DISTINCT 'r' || n_regionkey || '/n' || n_nationkey AS d FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT DISTINCT 'r' || n_regionkey FROM nation WHERE n_regionkey < 2),
p AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey AS path, 'r' || n_regionkey || '/n' || n_nationkey AS d1, 'r' || n_regionkey AS d2 FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT path, CASE WHEN d1 IN (SELECT d FROM f) THEN d1 WHEN d2 IN (SELECT d FROM f) THEN d2 END AS parent FROM p""")
def nearest_parent(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest folder of a supplier's path that holds a make file; even nations and the first regions have one."""
    n = table(spark, sf, "nation").withColumns({"r": F.concat(F.lit("r"), "n_regionkey"), "d": F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey")})
    files = n.where("n_nationkey % 2 = 0").select(F.concat("d", F.lit("/Makefile")).alias("path")).unionByName(n.where("n_regionkey < 2").select(F.concat("r", F.lit("/Makefile")).alias("path")))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("d", F.lit("/s"), "s_suppkey").alias("path"))
    return P.nearest_parent(s, files, "Makefile")


# --- Sequential operators; where there is no SQL, tests compare with plain rules ------------------------------------------------------


def _near_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text is not null")
    return c.withColumn("new", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("new is not null").select("conv_id", "turn", F.col("text").alias("old"), "new")


@bound()
def text_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Unified diffs of turns in a row."""
    return D.text_diffs(_near_turns(spark, sf), "conv_id", "turn")


@bound()
def line_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of turns in a row, matched by similarity."""
    t = _near_turns(spark, sf).select("conv_id", "turn", F.split("old", r"\. ").alias("a_lines"), F.split("new", r"\. ").alias("b_lines"))
    return D.match_lines(t, "conv_id", "turn", least=0.5)


@bound()
def statement_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Words of turns in a row, aligned."""
    t = _near_turns(spark, sf).select("conv_id", "turn", F.split("old", " ").alias("a_lines"), F.split("new", " ").alias("b_lines"))
    return D.map_statements(t, "conv_id", "turn")


@bound("""WITH c AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations WHERE text IS NOT NULL),
w AS (SELECT DISTINCT conv_id, turn, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM c), v AS (SELECT DISTINCT conv_id, turn, unnest(string_split_regex(lower(q), '[^\\p{L}\\p{N}_]+')) AS w FROM c),
d AS (SELECT w, count(*) AS df FROM w WHERE w <> '' GROUP BY w), s AS (SELECT conv_id, turn, sum(ln(1 + (SELECT count(*) FROM c) / df)) AS score FROM w JOIN v USING (conv_id, turn, w) JOIN d USING (w) GROUP BY ALL),
r AS (SELECT conv_id, turn, round(coalesce(score, 0), 9) AS score FROM c LEFT JOIN s USING (conv_id, turn)) SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn))::int AS rank FROM r""")
def overlap_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation ranked for its first turn by shared words."""
    c = table(spark, sf, "conversations").where("text is not null")
    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return E.rank_by_overlap(c.withColumn("query", first), "query", "text", "turn", "conv_id").select("conv_id", "turn", "score", "rank")


@bound(rf"""WITH m AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|/\*.*?\*/|//[^\r\n]*|.[^/''"]*'),
  lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') AND ends_with(x, '*/') AND length(x) > 3 THEN chr(2) || replace(x, chr(10), chr(3)) || chr(2) ELSE x END), '') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, string_split(regexp_replace(t, '\\\n[ \t]*', ' ', 'g'), chr(10)) AS lines FROM m),
b AS (SELECT doc_id, lines, list_transform(lines, lambda x: regexp_replace(x, '^{T.BLANK}+|{T.BLANK}+$', '', 'g')) AS bare FROM l),
c AS (SELECT doc_id, lines, bare, array_to_string(list_transform(bare, lambda x: CASE WHEN x = '' THEN 'B' WHEN starts_with(x, '#') THEN 'A'
  WHEN regexp_matches(x, '^([?]|[|][|]|&&)') THEN CASE WHEN regexp_matches(x, '[;{{)}}:\x02]$') THEN 'X' ELSE 'W' END WHEN regexp_matches(x, '[;{{)}}:\x02]$') THEN 'E' ELSE 'P' END), '') AS k FROM b),
s AS (SELECT doc_id, lines, bare, flatten(list_transform(regexp_extract_all(k, '{T.STATEMENT}'), lambda s: list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i = length(s) THEN i - 1 ELSE 0 END + CASE WHEN i > 1 THEN 0.5 ELSE 0 END))) AS steps FROM c)
SELECT doc_id, replace(replace(substr(array_to_string(list_transform(lines, lambda x, i: CASE WHEN steps[i] = floor(steps[i]) THEN chr(10) || x WHEN bare[i] = '' THEN '' ELSE ' ' || bare[i] END || repeat(chr(10), floor(steps[i])::int)), ''), 2), chr(2), ''), chr(3), chr(10)) AS code FROM s
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def joined_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents joined up to the ends of statements."""
    return T.join_statements(table(spark, sf, "documents", "doc_id", "text"), "text", "doc_id")


@bound("""SELECT page_id, len(list_filter(regexp_extract_all(regexp_replace(html, '(?s)(?:"(?:\\\\.|[^"\\\\])*"|''(?:\\\\.|[^''\\\\])*'')|(?:/\\*.*?\\*/|//[^\\r\\n]*)', ' ', 'g'), '\\b([A-Za-z_]\\w*)\\s*\\(', 1), lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof')))::int AS n_calls FROM pages""")
def call_names(spark: SparkSession, sf: str) -> DataFrame:
    """Syntax selection, approximated: calls in pages' scripts."""
    return table(spark, sf, "pages", "page_id", "html").select("page_id", F.size(T.calls(F.col("html"))).alias("n_calls"))


@bound("""WITH p AS (SELECT l_orderkey, list(l_partkey::varchar ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(p) >= 3 AS recovered, array_to_string(list_slice(p, 1, 3), chr(10)) AS text, (least(len(p), 3) - 1)::int AS used FROM p""")
def recovery(spark: SparkSession, sf: str) -> DataFrame:
    """M6: orders' lines put back one by one until there are three."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    o = l.groupBy("l_orderkey").agg(lines.alias("pool")).withColumn("base", F.slice("pool", 1, 1)).withColumn("pool", F.expr("slice(pool, 2, size(pool))"))
    return M.recover(o, lambda t: t.count("\n") >= 2, "l_orderkey")


from patchloom.plans import flow_bindings, syntax_bindings, varied_bindings  # noqa: E402, F401  these register their own
