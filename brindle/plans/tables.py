"""The kernels over the star-schema tables, each with the SQL that gives the same rows.

Adapters are plain selects: parts are symbols (brand = crate), lines are references, events are a log
of definitions and uses, documents are bodies, pages are paths.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.functions import text as T
from brindle.operators import detect, graph, packages, report, resolve, similarity
from brindle.plans import cache as cache_plans
from brindle.sources import external
from brindle.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name], SQL[name] = f, sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str):
    """Microseconds of a time without a zone since 1970, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def symbols(spark, sf):
    p = table(spark, sf, "part")
    vis = F.when(F.col("p_size") <= 16, "public").when(F.col("p_size") <= 33, "pub_crate").otherwise("private")
    name = F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_name")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("crate_name"), name.alias("name"), F.concat_ws("::", F.col("p_brand"), F.col("p_type"), name).alias("qualified"), vis.alias("visibility"), "p_type")


_NAME = "CAST(p_size AS VARCHAR) || ' ' || p_type || ' ' || p_name"
_SYM = f"""SELECT p_partkey AS symbol_id, p_brand AS crate_name, {_NAME} AS name, p_brand || '::' || p_type || '::' || {_NAME} AS qualified, p_type,
  CASE WHEN p_size <= 16 THEN 'public' WHEN p_size <= 33 THEN 'pub_crate' ELSE 'private' END AS visibility FROM part"""


def refs(spark, sf):
    """Every line refers to its part's name, from the crate of its supplier's nation: by the bare name if quantity and
    discount are full, by the part's brand if the quantity is 1, and by "crate" otherwise."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("from_crate"))
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_name").alias("name"))
    root = F.when((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.095), None).when(F.col("l_quantity") == 1, F.col("p_brand")).otherwise("crate")
    both = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ref_id"), "from_crate", "name", root.alias("root"), "l_linestatus", "p_partkey")


_REFS = f"""SELECT l_orderkey * 8 + l_linenumber AS ref_id, 'Brand#' || CAST(s_nationkey + 1 AS VARCHAR) AS from_crate, {_NAME} AS name, l_linestatus, p_partkey,
  CASE WHEN l_quantity = 50 AND l_discount > 0.095 THEN NULL WHEN l_quantity = 1 THEN p_brand ELSE 'crate' END AS root
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey"""
_REACHES = "r.name = s.name AND (r.root IS NULL OR s.crate_name = r.from_crate OR (r.root NOT IN ('crate', 'self', 'super', 'Self') AND r.root = s.crate_name))"


@query(f"""WITH s AS ({_SYM}), r AS ({_REFS})
SELECT symbol_id, crate_name, name, visibility FROM s WHERE visibility IN ('public', 'pub_crate')
AND symbol_id NOT IN (SELECT s.symbol_id FROM s JOIN r ON {_REACHES})""")
def dead_code(spark, sf):
    return detect.dead_items(symbols(spark, sf), refs(spark, sf)).select("symbol_id", "crate_name", "name", "visibility")


@query(f"""WITH s AS ({_SYM}), r AS ({_REFS})
SELECT symbol_id, crate_name, name FROM s WHERE symbol_id IN (SELECT s.symbol_id FROM s JOIN r ON {_REACHES})""")
def referenced_symbols(spark, sf):
    return resolve.referenced(symbols(spark, sf), refs(spark, sf)).select("symbol_id", "crate_name", "name")


@query(f"""WITH s AS ({_SYM}), r AS ({_REFS})
SELECT s.symbol_id, count(*) AS n_refs, count(DISTINCT r.from_crate) AS n_crates FROM s JOIN r ON {_REACHES} GROUP BY s.symbol_id""")
def ref_resolution(spark, sf):
    return resolve.reference_counts(refs(spark, sf), symbols(spark, sf))


@query(f"""WITH o AS (SELECT c_mktsegment AS crate_key, o_orderstatus, {_NAME} AS name, p_brand FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
deps AS (SELECT DISTINCT crate_key, replace(name, ' ', '-') || '-' || p_brand AS name FROM o WHERE o_orderstatus = 'F'),
used AS (SELECT DISTINCT crate_key, replace(name, ' ', '_') || '_' || p_brand AS name FROM o WHERE o_orderstatus = 'O')
SELECT d.crate_key, d.name FROM deps d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.crate_key = d.crate_key AND u.name IN (d.name, replace(d.name, '-', '_')))""")
def unused_deps(spark, sf):
    c, o, li, p = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select("c_mktsegment", "o_orderstatus", "p_brand", F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_name").alias("n"))
    dash = F.concat_ws("-", F.replace("n", F.lit(" "), F.lit("-")), "p_brand")
    deps = rows.where("o_orderstatus = 'F'").select(F.col("c_mktsegment").alias("crate_key"), dash.alias("name")).distinct()
    deps = deps.select("*", F.lit(None).cast("string").alias("rename"), F.lit("normal").alias("kind"), F.lit(False).alias("optional"))
    used = rows.where("o_orderstatus = 'O'").select(F.col("c_mktsegment").alias("from_crate"), F.concat_ws("_", F.replace("n", F.lit(" "), F.lit("_")), "p_brand").alias("name"), F.lit(None).cast("string").alias("root"))
    return detect.unused_deps(deps, used).select("crate_key", "name")


def log(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))


_LOG = "SELECT event_id, user_id, event_type, epoch_us(ts) AS pos FROM events"
_ENCLOSED = f"""WITH e AS ({_LOG}), p AS (SELECT user_id, pos, min(event_id) AS event_id FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
x AS (SELECT e.event_id, e.user_id, p.event_id AS enclosing_id FROM (SELECT * FROM e WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.pos >= p.pos)"""


def _enclosed(spark, sf):
    e = log(spark, sf)
    return resolve.enclosing(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "at", "event_id", "user_id", "at", "event_id")


@query(_ENCLOSED + " SELECT event_id, enclosing_id FROM x")
def enclosing_symbol(spark, sf):
    return _enclosed(spark, sf).select("event_id", "enclosing_id")


@query(_ENCLOSED + " SELECT enclosing_id AS caller, count(*) AS n_refs, min(event_id) AS first_ref FROM x WHERE enclosing_id IS NOT NULL GROUP BY 1")
def direct_callers(spark, sf):
    return _enclosed(spark, sf).where("enclosing_id is not null").groupBy(F.col("enclosing_id").alias("caller")).agg(F.count("*").alias("n_refs"), F.min("event_id").alias("first_ref"))


@query(f"""WITH e AS ({_LOG}), s AS (SELECT event_id, user_id, pos, (SELECT min(n.pos) FROM e n WHERE n.event_type = 'signup' AND n.user_id = e.user_id AND n.pos > e.pos) AS next_at FROM e WHERE event_type = 'signup')
SELECT s.event_id AS caller, c.event_id AS callee FROM s JOIN e c ON c.user_id = s.user_id AND c.event_type = 'click' AND c.pos >= s.pos AND (s.next_at IS NULL OR c.pos < s.next_at)""")
def callees_range(spark, sf):
    """Uses within the span of a definition: every one of those that begin at the as-of place."""
    e = log(spark, sf)
    s = e.where("event_type = 'signup'")
    hit = resolve.enclosing(e.where("event_type = 'click'"), s, "user_id", "at", "event_id", "user_id", "at", "event_id").where("enclosing_id is not null")
    at = s.select(F.col("user_id").alias("u"), F.col("at").alias("a"), F.col("event_id").alias("caller"))
    first = s.select(F.col("event_id").alias("enclosing_id"), F.col("at").alias("begin"))
    both = hit.join(first, "enclosing_id").join(at, (F.col("user_id") == F.col("u")) & (F.col("begin") == F.col("a")))
    return both.select("caller", F.col("event_id").alias("callee"))


@query(f"""WITH e AS ({_LOG}) SELECT event_id, (SELECT min(n.pos) FROM e n WHERE n.user_id = e.user_id AND n.pos > e.pos) AS next_at FROM e""")
def next_symbol(spark, sf):
    return resolve.spans(log(spark, sf), "user_id", "at").select("event_id", "next_at")


def part_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst").distinct()


_EDGES = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT 7 AS node, 0 AS distance UNION SELECT e.src, b.distance + 1 FROM b JOIN e ON e.dst = b.node WHERE b.distance < 2)
SELECT CAST(node AS BIGINT) AS node, min(distance) AS distance FROM b WHERE node <> 7 GROUP BY 1""")
def blast_radius(spark, sf):
    """Transitive callers of part 7, two steps at most."""
    e = part_edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.bfs(e, spark.createDataFrame([(7,)], "node long"), 2)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT CAST(11 AS BIGINT) AS node UNION SELECT e.dst FROM b JOIN e ON e.src = b.node) SELECT node FROM b WHERE node <> 11""")
def callees_transitive(spark, sf):
    return graph.bfs(part_edges(spark, sf), spark.createDataFrame([(11,)], "node long")).select("node")


def nation_flow(spark, sf):
    """(src, dst, region, dst_region, w): what suppliers' nations sell to customers' nations."""
    li, o, c, s, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    flow = rows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("w")).where("src <> dst")
    sellers = s.select(F.col("s_nationkey").alias("dst")).distinct()
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("region")), n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("dst_region"))
    return flow.join(sellers, "dst", "left_semi").join(a, "src").join(b, "dst")


_FLOW = """flow AS (SELECT s_nationkey AS src, c_nationkey AS dst, a.n_regionkey AS region, b.n_regionkey AS dst_region, sum(CAST(l_quantity AS BIGINT)) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
  WHERE s_nationkey <> c_nationkey AND c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1, 2, 3, 4)"""
_TOP = "SELECT src, dst, region FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM flow {}) WHERE k = 1"
_SCC = "reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src), scc AS (SELECT a.src AS node, min(a.dst) AS comp FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"


@query(f"WITH RECURSIVE {_FLOW}, edges AS ({_TOP.format('')}), {_SCC} SELECT node, comp FROM scc WHERE comp IN (SELECT comp FROM scc GROUP BY 1 HAVING count(*) > 1)")
def crate_cycles(spark, sf):
    return graph.cycles(graph.functional_edges(nation_flow(spark, sf), "src", "dst", "w")).select("node", "comp")


@query(f"WITH RECURSIVE {_FLOW}, edges AS ({_TOP.format('WHERE region = dst_region')}), {_SCC} SELECT n_regionkey AS region, node, comp FROM scc JOIN nation ON n_nationkey = node WHERE comp IN (SELECT comp FROM scc GROUP BY 1 HAVING count(*) > 1)")
def module_cycles(spark, sf):
    inside = nation_flow(spark, sf).where("region = dst_region")
    edges = graph.functional_edges(inside, "src", "dst", "w").join(inside.select("src", "region").distinct(), "src")
    return graph.cycles(edges, "region").select("region", "node", "comp")


@query("""SELECT DISTINCT c.n_name AS src, s.n_name AS dst, o_orderpriority AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey JOIN region ON r_regionkey = s.n_regionkey WHERE r_name = 'ASIA'""")
def crate_deps(spark, sf):
    li, o, c, s, n, r = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    keys = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).select("c_nationkey", "s_nationkey", "o_orderpriority").distinct()
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("crate")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    deps = keys.join(a, "c_nationkey").join(b, "s_nationkey").select("crate", "name", F.col("o_orderpriority").alias("kind"))
    own = n.join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"))
    return packages.crate_edges(deps, own)


@query(f"""WITH s AS ({_SYM}), r AS ({_REFS}) SELECT DISTINCT from_crate FROM r WHERE from_crate <> 'Brand#7' AND (root = 'Brand#7' OR (root IS NULL AND name IN (SELECT name FROM s WHERE crate_name = 'Brand#7')))""")
def reverse_deps(spark, sf):
    return packages.reverse_crate_deps(refs(spark, sf), symbols(spark, sf), "Brand#7")


@query(f"""WITH s AS ({_SYM}), r AS ({_REFS}) SELECT DISTINCT r.from_crate FROM r JOIN s ON {_REACHES} WHERE starts_with(s.qualified, 'Brand#7::PROMO::')""")
def reverse_module_deps(spark, sf):
    inside = symbols(spark, sf).where(F.col("qualified").startswith("Brand#7::PROMO::"))
    return resolve.referring_crates(refs(spark, sf), inside)


@query(f"""WITH s AS ({_SYM}), n AS (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM s), r AS ({_REFS}),
u AS (SELECT s.symbol_id, s.visibility, s.symbol_id = r.p_partkey AS same_file, s.crate_name = r.from_crate AS same_crate FROM n s JOIN r ON r.name = s.name AND (s.crate_name = r.from_crate OR (r.root IS NULL AND k = 1) OR (r.root NOT IN ('crate', 'self', 'super', 'Self') AND r.root = s.crate_name))
  WHERE s.visibility <> 'private'),
p AS (SELECT symbol_id, visibility, count(*) AS n_refs, bool_and(same_file) AS f, bool_and(same_crate) AS c FROM u GROUP BY 1, 2)
SELECT symbol_id, visibility, CASE WHEN f THEN 'private' ELSE 'pub_crate' END AS suggested, n_refs FROM p WHERE (c OR f) AND CASE WHEN f THEN 'private' ELSE 'pub_crate' END <> visibility""")
def visibility(spark, sf):
    s = symbols(spark, sf).withColumn("_k", F.count("*").over(Window.partitionBy("name"))).where("visibility <> 'private'")
    r = refs(spark, sf).withColumnRenamed("name", "_name")
    hit = resolve.visibility_uses(s.withColumnRenamed("name", "_own"), r.withColumnRenamed("_name", "name"))
    return detect.visibility_suggestions(hit.select("symbol_id", "visibility", (F.col("symbol_id") == F.col("p_partkey")).alias("same_file"), (F.col("crate_name") == F.col("from_crate")).alias("same_crate")))


@query(f"""WITH s AS ({_SYM}) SELECT symbol_id, qualified, name FROM s WHERE regexp_full_match(qualified, 'Brand#1[^:]*::.*::[^:]*ring') OR regexp_full_match(name, '1[^:]* red [^:]*')""")
def ls_glob(spark, sf):
    s = symbols(spark, sf)
    return s.where(T.glob(F.col("qualified"), "Brand#1*::**::*ring") | T.glob(F.col("name"), "1* red *")).select("symbol_id", "qualified", "name").orderBy("qualified", "symbol_id")


@query(f"""WITH e AS (SELECT l_partkey AS src, l_orderkey * 8 + l_linenumber AS ord, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
g AS (SELECT src, dst, min(ord) AS first_ref FROM e WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2)
SELECT src AS target_id, CAST(k AS INTEGER) AS rank, dst AS neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY first_ref, dst) AS k FROM g) WHERE k <= 5""")
def ctx_neighbors(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.lead("l_partkey").over(w).alias("dst"))
    return resolve.first_neighbors(e.where("dst is not null and src <> dst"), "src", "dst", "ord").select(F.col("src").alias("target_id"), "rank", F.col("dst").alias("neighbor_id"))


def bodies(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("fn_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qualified"), F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+"), lambda x: x != "").alias("tokens"))


_TOKENS = "SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM documents"
_PAIRS = f"""tok AS ({_TOKENS}), sh AS (SELECT doc_id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], chr(1)))) AS s FROM tok WHERE len(t) >= 40),
ex AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh), cand AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_shared FROM ex a JOIN ex b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, n_shared, na + nb - n_shared AS n_union FROM cand WHERE n_shared * 100 >= (na + nb - n_shared) * 85)"""


@query(f"WITH {_PAIRS} SELECT a, b, n_shared, n_union FROM pairs")
def dupes_pairs(spark, sf):
    p = similarity.similar_pairs(bodies(spark, sf))
    return p.select("a", "b", F.col("inter").cast("long").alias("n_shared"), F.col("uni").cast("long").alias("n_union"))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node, min(other) AS comp FROM reach GROUP BY 1), m AS (SELECT comp, string_agg(node, ',' ORDER BY node) AS members, count(*) AS n_members FROM comp GROUP BY 1)
SELECT m.comp, members, n_members, round(min(n_shared / n_union), 6) AS min_similarity, round(max(n_shared / n_union), 6) AS max_similarity FROM m JOIN comp c ON c.comp = m.comp JOIN pairs p ON p.a = c.node GROUP BY 1, 2, 3""")
def dupes_clusters(spark, sf):
    c = similarity.clusters(bodies(spark, sf))
    return c.select("comp", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "n_members", F.round("min_similarity", 6).alias("min_similarity"), F.round("max_similarity", 6).alias("max_similarity"))


_CLASS = "CASE WHEN regexp_matches({0}, '^(b?r?\"|r#|b\")') THEN 'string-literal' WHEN regexp_matches({0}, '^[0-9]') THEN 'numeric' WHEN regexp_matches({0}, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'identifier' ELSE 'structural' END"


@query(f"""WITH {_PAIRS}, mem AS (SELECT a, b, x.t AS t, y.t AS u FROM pairs JOIN tok x ON x.doc_id = a JOIN tok y ON y.doc_id = b),
pl AS (SELECT a, b, p, t[p + 1] AS v, u[p + 1] AS w FROM (SELECT *, unnest(range(0, least(len(t), len(u)))) AS p FROM mem)),
k AS (SELECT a, b, CASE WHEN {_CLASS.format('v')} <> {_CLASS.format('w')} THEN 'structural' ELSE {_CLASS.format('v')} END AS class FROM pl WHERE v <> w UNION ALL SELECT a, b, 'structural' FROM mem WHERE len(t) <> len(u))
SELECT a, b, class, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def diff_cluster(spark, sf):
    return similarity.pair_divergences(bodies(spark, sf))


RULES = [(0, "http", [], ["m."]), (1, "https", ["blog.", "www.", "m."], ["blog.thre", "blog.thth"])]


@query("""WITH p AS (SELECT page_id, split_part(url, '://', 1) AS from_crate, split_part(url, '://', 2) AS path FROM pages)
SELECT page_id, 0 AS rule_ord, 'deny m.' AS rule FROM p WHERE from_crate = 'http' AND starts_with(path, 'm.')
UNION ALL SELECT page_id, 1, CASE WHEN starts_with(path, 'blog.thre') THEN 'deny blog.thre' WHEN starts_with(path, 'blog.thth') THEN 'deny blog.thth' ELSE 'not in allow list' END FROM p
WHERE from_crate = 'https' AND (starts_with(path, 'blog.thre') OR starts_with(path, 'blog.thth') OR NOT (starts_with(path, 'blog.') OR starts_with(path, 'www.') OR starts_with(path, 'm.')))""")
def boundaries(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.substring_index("url", "://", 1).alias("from_crate"), F.regexp_extract("url", "://(.*)$", 1).alias("path"), F.lit("").alias("from_path"))
    rules = spark.createDataFrame(RULES, "rule_ord int, from string, allow array<string>, deny array<string>")
    return detect.boundary_violations(p, rules, scope=F.col("from_crate") == F.col("from")).select("page_id", "rule_ord", "rule")


OWNERS = [(0, "news", "en"), (1, "archive", "en/1"), (2, "german", "de"), (3, "deep", "fr")]


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS path FROM pages), o(ord, crate, prefix) AS (VALUES (0, 'news', 'en'), (1, 'archive', 'en/1'), (2, 'german', 'de'), (3, 'deep', 'fr'))
SELECT page_id, crate FROM (SELECT page_id, crate, row_number() OVER (PARTITION BY page_id, path ORDER BY length(prefix) DESC, ord DESC) AS k FROM p JOIN o ON path = prefix OR starts_with(path, prefix || '/')) WHERE k = 1""")
def owning_crate(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1).alias("path"))
    return detect.first_prefix(p, spark.createDataFrame(OWNERS, "ord int, crate string, prefix string"), "path", "prefix", "ord", ["page_id", "path"], longest=True).select("page_id", "crate")


@query("""SELECT event_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) OR NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND value > 60)""")
def audit_scope(spark, sf):
    e = table(spark, sf, "events")
    return detect.scoped(e, e.where("event_type = 'error' and value > 60").select("user_id"), "user_id").select("event_id", "event_type")


@query("""SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INTEGER) AS loc,
CAST(len(list_distinct(string_split(text, chr(10)))) AS INTEGER) AS n_distinct, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(The|Die|Le|El) '))) AS INTEGER) AS n_marked FROM documents""")
def summarize(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", T.line_count(F.col("text")).alias("loc"), F.size(F.array_distinct(lines)).alias("n_distinct"), F.size(F.filter(lines, lambda x: x.rlike("^(The|Die|Le|El) "))).alias("n_marked"))


@query("""WITH p AS (SELECT DISTINCT p_name AS name, p_brand AS version FROM part), two AS (SELECT name FROM p GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT DISTINCT p_name AS name, CASE WHEN l_tax < 0.005 THEN NULL ELSE p_brand END AS version, s_nationkey AS caller FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT p.name, p.version, coalesce((SELECT string_agg(DISTINCT CAST(caller AS VARCHAR), ',' ORDER BY CAST(caller AS VARCHAR)) FROM c WHERE c.name = p.name AND (c.version IS NULL OR c.version = p.version)), '') AS callers FROM p JOIN two ON two.name = p.name""")
def deps_duplicates(spark, sf):
    p, li, s = table(spark, sf, "part"), table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    c = li.join(p, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    c = c.select(F.col("p_name").alias("name"), F.when(F.col("l_tax") >= 0.005, F.col("p_brand")).alias("version"), F.col("s_nationkey").cast("string").alias("caller")).distinct()
    d = packages.duplicate_versions(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("version")).distinct(), c)
    return d.select("name", "version", F.array_join("callers", ",").alias("callers"))


TERMS = ["Lorem", "@", "http", "secret", "Copyright", "ß", "ción", "xyzzy", "=="]


@query("""WITH t(term) AS (VALUES ('Lorem'), ('@'), ('http'), ('secret'), ('Copyright'), ('ß'), ('ción'), ('xyzzy'), ('==')) SELECT l.lang AS crate, term FROM (SELECT DISTINCT lang FROM documents) l, t WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = l.lang AND contains(d.text, term))""")
def deps_unused_features(spark, sf):
    terms = spark.createDataFrame(list(enumerate(TERMS)), "ord int, term string")
    return packages.unused_terms(table(spark, sf, "documents").select(F.col("lang").alias("crate"), "text"), terms)


@query("""WITH b AS (SELECT p_brand AS name, sum(CAST(l_quantity AS BIGINT)) AS size FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT name, size, round(size * 100.0 / sum(size) OVER (), 6) AS percent FROM b""")
def deps_size(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    b = li.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("name")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    return packages.shares(b).select("name", "size", F.round("percent", 6).alias("percent"))


def findings(spark, sf):
    e = table(spark, sf, "events")
    sev = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("purchase", "click"), "warning")
    return e.select("event_id", F.col("event_type").alias("kind"), F.coalesce(sev, F.lit("note")).alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "value")


_FIND = "f AS (SELECT event_id, event_type AS kind, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase', 'click') THEN 'warning' ELSE 'note' END AS severity, 'u' || user_id AS file, value FROM events)"


@query(f"WITH {_FIND} SELECT kind, count(*) AS n FROM f GROUP BY 1")
def report_by_detector(spark, sf):
    return report.by_detector(findings(spark, sf))


@query(f"WITH {_FIND}, d(ord, severity) AS (VALUES (0, 'error'), (1, 'warning'), (2, 'info')) SELECT d.ord, d.severity, count(f.kind) AS n FROM d LEFT JOIN f ON f.severity = d.severity GROUP BY 1, 2")
def report_severity(spark, sf):
    return report.by_severity(findings(spark, sf))


@query(f"WITH {_FIND} SELECT file, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, file LIMIT 10")
def report_hotspots(spark, sf):
    return report.top_files(findings(spark, sf))


_MEASURES = "m AS (SELECT o_custkey, CAST(count(*) AS INTEGER) AS cyclo, CAST(count(DISTINCT o_orderpriority) * 7 AS INTEGER) AS cog FROM orders GROUP BY 1)"


def measures(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("cyclo"), (F.countDistinct("o_orderpriority") * 7).cast("int").alias("cog"))


@query(f"WITH {_MEASURES} SELECT o_custkey, cyclo, cog FROM m ORDER BY cyclo DESC, cog DESC, o_custkey LIMIT 10")
def report_complexity(spark, sf):
    return report.top_complexity(measures(spark, sf), "o_custkey")


@query(f"WITH {_MEASURES} SELECT o_custkey, cyclo, cog FROM m WHERE cyclo > 15 OR cog > 25")
def health_hotspots(spark, sf):
    return detect.hotspots(measures(spark, sf))


@query(f"WITH {_FIND} SELECT count(*) AS total, count(*) FILTER (kind IN ('error', 'signup')) AS edits, CASE WHEN count(*) > 0 THEN count(*) FILTER (kind IN ('error', 'signup')) * 100 // count(*) ELSE 0 END AS percent FROM f")
def report_fixable(spark, sf):
    return report.fixable(findings(spark, sf), ("error", "signup"))


@query("""WITH k AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' AS old, o_custkey || '|' || o_orderpriority AS identity FROM orders), b AS (SELECT * FROM k WHERE old), h AS (SELECT * FROM k WHERE NOT old)
SELECT o_orderkey, 'resolved' AS state FROM b WHERE identity NOT IN (SELECT identity FROM h) UNION ALL SELECT o_orderkey, CASE WHEN identity IN (SELECT identity FROM b) THEN 'unchanged' ELSE 'introduced' END FROM h""")
def snapshot_diff(spark, sf):
    o = table(spark, sf, "orders").withColumn("identity", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"))
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    return report.snapshot_diff(o.where(old), o.where(~old)).select("o_orderkey", "state")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.file'), json_extract_string(props, '$.path'), '') AS file, CAST(coalesce(json_extract(props, '$.line'), json_extract(props, '$.k'), '0') AS INTEGER) AS line, coalesce(json_extract_string(props, '$.severity'), 'warning') AS severity FROM events""")
def external_json(spark, sf):
    e = table(spark, sf, "events")
    return external.findings(e, "props", line_keys=("line", "k")).select("event_id", "file", "line", "severity")


@query("""WITH f AS (SELECT doc_id AS path, n_chars AS mtime FROM documents WHERE lang IN ('en', 'de')), c AS (SELECT doc_id AS path, (SELECT CAST(avg(n_chars) AS BIGINT) FROM documents) AS mtime FROM documents WHERE lang IN ('de', 'fr'))
SELECT coalesce(f.path, c.path) AS path, CASE WHEN f.path IS NULL THEN 'evict' WHEN c.path IS NOT NULL AND f.mtime <= c.mtime THEN 'hit' ELSE 'miss' END AS state FROM f FULL JOIN c ON f.path = c.path""")
def cache_plan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"), "lang")
    mean = F.broadcast(d.agg(F.round(F.avg("mtime")).cast("long").alias("m")))
    cached = d.where(F.col("lang").isin("de", "fr")).crossJoin(mean).select("path", F.col("m").alias("mtime"))
    return cache_plans.plan(d.where(F.col("lang").isin("en", "de")).select("path", "mtime"), cached).select("path", "state")


@query("""WITH w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]'), lambda x: x = 'the')) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n_renamed, len(text) + n * 2 AS new_length FROM w WHERE n > 0""")
def rename_tokens(spark, sf):
    d = table(spark, sf, "documents").where(T.mentions(F.col("text"), "the"))
    return d.select("doc_id", T.count_word(F.col("text"), "the").alias("n_renamed"), F.length(T.rename_word(F.col("text"), "the", "theta")).cast("long").alias("new_length"))


@query(f"""WITH e AS (SELECT user_id, ts, event_type, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM s GROUP BY user_id, k""")
def watch_sessions(spark, sf):
    e = table(spark, sf, "events")
    s = watch.sessions(e, "30 minutes", "user_id", F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return s.select("user_id", micros("a").alias("first_at"), micros("b").alias("last_at"), "n", "n_errors")


@query("""WITH s AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://(.*)$', 1), '/') AS g FROM pages) SELECT page_id, CAST(i AS INTEGER) AS pos, g[i + 1] AS name, array_to_string(g[1 : i + 1], '::') AS prefix FROM (SELECT page_id, g, unnest(range(1, len(g) - 1)) AS i FROM s)""")
def path_refs(spark, sf):
    s = table(spark, sf, "pages").select("page_id", F.split(F.regexp_extract("url", "^[a-z]+://(.*)$", 1), "/").alias("g"))
    each = s.select("page_id", F.explode(T.path_prefixes(F.col("g"))).alias("p"))
    return each.select("page_id", "p.pos", "p.name", F.array_join("p.prefix", "::").alias("prefix"))


@query(f"""WITH {_FIND} SELECT kind, severity, count(*) AS n, min(event_id) AS first_id FROM f GROUP BY GROUPING SETS ((kind, severity)) """)
def findings_by_kind(spark, sf):
    return report.by_kind(findings(spark, sf), "event_id")


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey), n AS (SELECT n_nationkey, n_regionkey FROM nation),
x AS (SELECT c_custkey, s_suppkey, CASE WHEN s_nationkey = c_nationkey THEN 0 ELSE 1 END AS far FROM r JOIN n ON n.n_nationkey = c_nationkey JOIN s ON s.n_regionkey = n.n_regionkey)
SELECT c_custkey, min_by(s_suppkey, far * 1000000000 + s_suppkey) AS site FROM x GROUP BY 1""")
def scope_resolution(spark, sf):
    """The site a name means: its own file's (nation's) first, else its crate's (region's)."""
    c, s, n = table(spark, sf, "customer"), table(spark, sf, "supplier"), table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    used = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("site").alias("name"), F.col("n_nationkey").alias("file"), F.col("n_regionkey").alias("crate"))
    known = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("site").alias("name"), F.col("n_nationkey").alias("file"), F.col("n_regionkey").alias("crate"), F.col("s_suppkey").alias("site"))
    return resolve.scope_sites(used, known).where("site is not null").select("c_custkey", "site")


@query("""WITH k AS (SELECT p_brand || '/' || p_name AS grp, p_type, p_size, p_partkey FROM part), m AS (SELECT grp, min_by(p_partkey, CASE WHEN p_size < 10 THEN '0' ELSE '1' END || p_type || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS canonical, count(*) AS n, count(DISTINCT p_type) = 1 AS identical, max(CASE WHEN p_size <= 16 THEN 2 WHEN p_size <= 33 THEN 1 ELSE 0 END) AS needed FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT grp, canonical, n, identical, needed FROM m""")
def dedupe_canonical(spark, sf):
    """Canonical member, byte identity and the greatest visibility needed of each group of homonyms."""
    p = table(spark, sf, "part").withColumn("grp", F.concat_ws("/", "p_brand", "p_name"))
    rank = F.when(F.col("p_size") <= 16, 2).when(F.col("p_size") <= 33, 1).otherwise(0)
    members = p.select("grp", F.col("p_partkey").alias("member"), F.col("p_type").alias("body"), rank.alias("needed"), F.struct((F.col("p_size") >= 10).alias("late"), "p_type", "p_partkey").alias("order"))
    return similarity.canonical_members(members).select("grp", F.col("member").alias("canonical"), "n", "identical", "needed")


@query(f"""WITH tok AS ({_TOKENS}), n AS (SELECT doc_id, list_filter(t, lambda x: regexp_full_match(x, '[0-9]{{1,18}}(\\.[0-9]+)?')) AS v FROM tok)
SELECT doc_id, CASE WHEN len(list_filter(v, lambda x: contains(x, '.'))) > 0 THEN CASE WHEN len(list_filter(v, lambda x: CAST(CAST(x AS DOUBLE) AS DECIMAL(38, 0)) > 4294967295)) > 0 THEN 'f64' ELSE 'f32' END WHEN len(list_filter(v, lambda x: CAST(x AS DECIMAL(38, 0)) > 4294967295)) > 0 THEN 'i64' ELSE 'i32' END AS type FROM n WHERE len(v) > 0""")
def literal_types(spark, sf):
    d = bodies(spark, sf).select(F.col("fn_id").alias("doc_id"), F.filter("tokens", lambda x: x.rlike("^[0-9]{1,18}(\\.[0-9]+)?$")).alias("v")).where(F.size("v") > 0)
    return d.select("doc_id", similarity.literal_type(F.col("v")).alias("type"))
