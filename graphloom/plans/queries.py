"""Registered graph queries over the derived graph, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.exprs import common_prefix, edge_key, is_test_path, is_virtual_path, module_key, name_variants, virtual_path
from graphloom.operators.queries import Graph
from graphloom.operators.resolver import resolved
from graphloom.operators.rollup import degrees, first_edges, merged_nodes, module_graph, upserted
from graphloom.operators.traverse import closure
from graphloom.sources.derived import CTES, stored
from graphloom.streaming.changes import coalesced, queued, sessions

SUPPLIER, CUSTOMER, BRAND = "Supplier#000000001", "Customer#000000001", "Brand#2"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEMANTIC = "type IN ('calls', 'imports', 'depends_on')"
WEIGHT = "CAST(CASE type WHEN 'calls' THEN 1.00 WHEN 'depends_on' THEN 0.85 WHEN 'imports' THEN 0.70 WHEN 'defines' THEN 0.35 WHEN 'contains' THEN 0.25 ELSE 0.50 END AS DECIMAL(3,2))"


def query(name: str, sql: str, graph_sql: bool = True):
    """Registers a function of (Graph) and its SQL, which may use the derived nodes and edges."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(*stored(spark, sf_dir)))
        ORACLE_SQL[name] = f"WITH RECURSIVE {CTES}{sql}" if graph_sql else sql
        return f

    return add


def events_query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"))
        ORACLE_SQL[name] = sql
        return f

    return add


@query("a10_read_nodes", "SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM nodes GROUP BY kind")
def read_nodes(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("a10_read_edges", "SELECT type, count(*) AS n, coalesce(min(line), 0) AS first_line, coalesce(max(line), 0) AS last_line FROM edges GROUP BY type")
def read_edges(g: Graph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("line"), F.lit(0)).alias("first_line"), F.coalesce(F.max("line"), F.lit(0)).alias("last_line"))


@query("b3_roots", f"SELECT id, kind, name FROM nodes WHERE name = '{SUPPLIER}' AND kind = 'symbol'")
def roots(g: Graph) -> DataFrame:
    return g.roots(SUPPLIER).select("id", "kind", "name")


@query("b3_roots_any_kind", f"SELECT id, kind, name FROM nodes WHERE name = '{BRAND}'")
def roots_any(g: Graph) -> DataFrame:
    return g.roots(BRAND, "name").select("id", "kind", "name")


REFS = f""", refs AS (
  SELECT e.type AS kind, e.file_path, e.line, e.src AS from_id, e.dst AS to_id, f.name AS from_name, f.file_path AS from_file_path, t.file_path AS to_file_path
  FROM edges e JOIN nodes f ON f.id = e.src JOIN nodes t ON t.id = e.dst
  WHERE {SEMANTIC} AND t.name = '{SUPPLIER}' AND t.kind = 'symbol')"""


@query("g2_symbol_references", REFS + "SELECT kind, file_path, line, from_id, from_name, to_id, 'resolved' AS resolution FROM refs")
def symbol_references(g: Graph) -> DataFrame:
    return g.references(SUPPLIER)["all"].select("kind", "file_path", "line", "from_id", "from_name", "to_id", "resolution")


@query("d1_reference_files", REFS + 'SELECT file_path, count(*) AS "references" FROM refs GROUP BY file_path')
def reference_files(g: Graph) -> DataFrame:
    return g.references(SUPPLIER)["files"]


@query("b7_references_exclude_self", REFS + "SELECT kind, line, from_id FROM refs WHERE from_file_path <> to_file_path")
def references_exclude_self(g: Graph) -> DataFrame:
    return g.references(SUPPLIER, exclude_self=True)["all"].select("kind", "line", "from_id")


@query("f9_reference_page", REFS + "SELECT kind, file_path, line, from_id FROM refs ORDER BY file_path, from_id, to_id, kind, line LIMIT 20 OFFSET 10")
def reference_page(g: Graph) -> DataFrame:
    return g.references(SUPPLIER, limit=20, offset=10)["references"].select("kind", "file_path", "line", "from_id")


@query("d15_reference_summary", REFS + "SELECT count(*) AS total, count(*) > 200 AS has_more FROM refs")
def reference_summary(g: Graph) -> DataFrame:
    return g.references(SUPPLIER)["summary"]


@query("g12_method_usage", REFS + "SELECT kind, line, from_id FROM refs ORDER BY file_path, from_id, to_id, kind, line LIMIT 1000")
def method_usage(g: Graph) -> DataFrame:
    """The name after ``#`` has no root, so the second attempt, with the whole text, gives the rows."""
    return g.method_usage(SUPPLIER)["all"].select("kind", "line", "from_id")


FILE = "AFRICA/NATION_0"
FILE_REFS = f""", own AS (SELECT id FROM nodes WHERE file_path = '{FILE}'),
marked AS (
  SELECT e.*, e.dst IN (SELECT id FROM own) AS into_, f.file_path AS fp, t.file_path AS tp
  FROM edges e JOIN nodes f ON f.id = e.src JOIN nodes t ON t.id = e.dst
  WHERE {SEMANTIC} AND (e.dst IN (SELECT id FROM own) OR e.src IN (SELECT id FROM own))),
others AS (SELECT CASE WHEN into_ THEN fp ELSE tp END AS file_path, into_ FROM marked)
SELECT file_path, CAST(sum(CASE WHEN into_ THEN 1 ELSE 0 END) AS BIGINT) AS inbound, CAST(sum(CASE WHEN into_ THEN 0 ELSE 1 END) AS BIGINT) AS outbound, count(*) AS "references"
FROM others WHERE file_path IS NOT NULL AND file_path <> '{FILE}' GROUP BY file_path"""


@query("g4_file_references", FILE_REFS)
def file_references(g: Graph) -> DataFrame:
    return g.file_references(FILE)["files"]


STEPS = f""", steps AS (
  SELECT src AS a, dst AS b FROM edges WHERE {SEMANTIC} UNION SELECT dst, src FROM edges WHERE {SEMANTIC})"""


def hops(seed: str, depth: int, direction: str) -> str:
    steps = {"outbound": f"SELECT DISTINCT src AS a, dst AS b FROM edges WHERE {SEMANTIC}", "both": f"SELECT src AS a, dst AS b FROM edges WHERE {SEMANTIC} UNION SELECT dst, src FROM edges WHERE {SEMANTIC}"}[direction]
    out = f", steps AS ({steps}), l0 AS ({seed})"
    for k in range(1, depth + 1):
        out += f", l{k} AS (SELECT DISTINCT b AS id FROM l{k - 1} JOIN steps ON a = id)"
    every = " UNION ALL ".join(f"SELECT id, {k} AS hop FROM l{k}" for k in range(depth + 1))
    return out + f", hops AS (SELECT id, CAST(min(hop) AS INT) AS hop FROM ({every}) GROUP BY id)"


CUSTOMER_SEED = f"SELECT id FROM nodes WHERE name = '{CUSTOMER}' AND kind = 'symbol'"


@query("g1_neighborhood_hops", hops(CUSTOMER_SEED, 2, "outbound") + "SELECT id, hop FROM hops")
def neighborhood_hops(g: Graph) -> DataFrame:
    return g.neighborhood(CUSTOMER, depth=2, limit=500, direction="outbound")["hops"]


@query("g1_neighborhood_edges", hops(CUSTOMER_SEED, 2, "outbound") + f"SELECT DISTINCT type, src, dst, e.file_path, line FROM edges e JOIN hops ON src = id WHERE {SEMANTIC} AND hop < 1")
def neighborhood_edges(g: Graph) -> DataFrame:
    return g.neighborhood(CUSTOMER, depth=1, limit=500, edge_limit=2000, direction="outbound")["edges"].select("type", "src", "dst", "file_path", "line")


IMPACT = hops(f"SELECT id FROM nodes WHERE name = '{SUPPLIER}'", 1, "both")


@query("g6_impact_files", IMPACT + "SELECT n.file_path, count(*) AS hits FROM hops JOIN nodes n ON n.id = hops.id WHERE n.kind <> 'external' AND n.file_path IS NOT NULL GROUP BY n.file_path")
def impact_files(g: Graph) -> DataFrame:
    return g.impact(symbols=[SUPPLIER], depth=1, limit=500)["files"]


@query("d5_external_touchpoints", f""", touched AS (
  SELECT DISTINCT e.type, src, dst, e.file_path, line, n.name FROM edges e JOIN nodes s ON s.id = src JOIN nodes n ON n.id = dst
  WHERE {SEMANTIC} AND s.name = '{SUPPLIER}' AND n.kind = 'external')
SELECT dst AS symbol_id, name AS symbol, count(*) AS "references", CAST(0 AS BIGINT) AS inbound, count(*) AS outbound FROM touched GROUP BY dst, name""")
def touchpoints(g: Graph) -> DataFrame:
    return g.impact(symbols=[SUPPLIER], depth=1)["touchpoints"].drop("files")


def walk(query_: str, depth: int) -> str:
    q = query_.lower()
    lex = f"CASE WHEN lower(name) = '{q}' OR lower(id) = '{q}' THEN 1 WHEN starts_with(lower(name), '{q}') OR starts_with(lower(id), '{q}') THEN 0.9 WHEN contains(lower(name), '{q}') OR contains(lower(id), '{q}') THEN 0.75 WHEN contains(coalesce(lower(file_path), ''), '{q}') THEN 0.45 ELSE 0 END"
    out = f""", named AS (SELECT id, name, kind, file_path, CAST({lex} AS DECIMAL(10,6)) AS lexical FROM nodes WHERE kind IN ('symbol', 'external')),
both_ AS (SELECT src AS a, dst AS b, {WEIGHT} AS w FROM edges WHERE {SEMANTIC} UNION ALL SELECT dst, src, {WEIGHT} FROM edges WHERE {SEMANTIC}),
steps AS (SELECT a, b, max(w) AS w FROM both_ GROUP BY a, b), degree AS (SELECT a AS id, sum(w) AS degree FROM both_ GROUP BY a),
w0 AS (SELECT id, lexical AS score FROM named WHERE lexical > 0)"""
    for k in range(1, depth + 1):
        out += f", w{k} AS (SELECT b AS id, max(CAST(round(score * CAST(0.75 AS DECIMAL(3,2)) * w, 6) AS DECIMAL(10,6))) AS score FROM w{k - 1} JOIN steps ON a = id GROUP BY b)"
    every = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, depth + 1))
    return out + f""", near AS (SELECT id, max(score) AS proximity FROM ({every}) GROUP BY id),
hits AS (SELECT named.id, name, lexical, coalesce(proximity, 0) AS proximity,
  CAST(round(least(CAST(1 AS DECIMAL(18,6)), CAST(coalesce(degree, 0) AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(3,2))), 6) AS DECIMAL(10,6)) AS semantic
  FROM named LEFT JOIN near ON near.id = named.id LEFT JOIN degree ON degree.id = named.id)
SELECT id, name, CAST(lexical AS DOUBLE) AS lexical, CAST(proximity AS DOUBLE) AS proximity, CAST(semantic AS DOUBLE) AS semantic,
  CAST(CAST(round(lexical * CAST(0.55 AS DECIMAL(3,2)) + proximity * CAST(0.30 AS DECIMAL(3,2)) + semantic * CAST(0.15 AS DECIMAL(3,2)), 6) AS DECIMAL(10,6)) AS DOUBLE) AS score
FROM hits WHERE lexical > 0 OR proximity > 0"""


@query("g5_hybrid_hits", walk("brand#2", 2))
def hybrid_hits(g: Graph) -> DataFrame:
    out = g.hybrid("brand#2", depth=2, limit=1000)["all"]
    return out.select("id", "name", *(F.col(c).cast("double").alias(c) for c in ("lexical", "proximity", "semantic", "score")))


@query("d6_weighted_degree", f", ends AS (SELECT src AS id, {WEIGHT} AS w FROM edges WHERE {SEMANTIC} UNION ALL SELECT dst, {WEIGHT} FROM edges WHERE {SEMANTIC}) SELECT id, CAST(sum(w) AS DOUBLE) AS degree FROM ends GROUP BY id")
def weighted_degree(g: Graph) -> DataFrame:
    return degrees(g.edges, weighted=True).withColumn("degree", F.col("degree").cast("double"))


@query("f10_degree_topk", ", ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT id, count(*) AS degree FROM ends GROUP BY id) SELECT n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN d ON d.id = n.id ORDER BY degree DESC, n.id COLLATE en LIMIT 25")
def degree_topk(g: Graph) -> DataFrame:
    return g.sample(25)["nodes"].select("id", "degree")


@query("d8_name_counts", "SELECT name, count(*) AS n FROM nodes WHERE kind = 'symbol' GROUP BY name")
def name_counts(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'symbol'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("d11_module_rollup", """, m AS (SELECT id, CASE WHEN file_path IS NULL OR file_path = '' THEN '(virtual)' WHEN NOT contains(file_path, '/') THEN '(root)' ELSE split_part(file_path, '/', 1) END AS m FROM nodes)
SELECT a.m AS src_module, b.m AS dst_module, type, count(*) AS weight FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.m <> b.m GROUP BY ALL""")
def module_rollup(g: Graph) -> DataFrame:
    return module_graph(g.nodes, g.edges)


@query("d13_edge_dedupe", "SELECT type, src, dst, file_path, coalesce(line, 0) AS line FROM edges")
def edge_dedupe(g: Graph) -> DataFrame:
    twice = g.edges.withColumn("seq", F.lit(0)).unionByName(g.edges.withColumn("seq", F.lit(1)))
    return first_edges(twice).drop("seq").fillna(0, ["line"])


@query("d12_node_merge", "SELECT id, kind, concat(name, '!') AS name, language, file_path FROM nodes")
def node_merge(g: Graph) -> DataFrame:
    later = g.nodes.select("id", F.lit(None).cast("string").alias("kind"), F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("file_path"))
    return merged_nodes(g.nodes.withColumn("seq", F.lit(0)).unionByName(later.withColumn("seq", F.lit(1))))


@query("g8_clusters", f""", inner_ AS (SELECT id FROM nodes WHERE kind IN ('symbol', 'external')),
e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE {SEMANTIC} AND src <> dst AND src IN (SELECT id FROM inner_) AND dst IN (SELECT id FROM inner_)),
s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT min(id) AS root FROM inner_ WHERE id IN (SELECT x FROM s)),
c AS (SELECT id FROM inner_ WHERE id = (SELECT root FROM r) UNION SELECT y FROM c JOIN s ON s.x = c.id),
sizes AS (SELECT (SELECT root FROM r) AS root, count(*) AS size, (SELECT count(*) FROM e WHERE a IN (SELECT id FROM c)) AS internal_edges FROM c)
SELECT root, size, internal_edges FROM sizes UNION ALL SELECT id, 1, 0 FROM inner_ WHERE id NOT IN (SELECT id FROM c)""")
def clusters(g: Graph) -> DataFrame:
    return g.clusters()[0].drop("density")


@query("g11_process_flow", f"SELECT type, src, dst, e.file_path, line FROM edges e JOIN nodes n ON n.id = src WHERE {SEMANTIC} AND n.name = '{CUSTOMER}' AND n.kind = 'symbol'")
def process_flow(g: Graph) -> DataFrame:
    return g.process_flow([CUSTOMER])["all_edges"].select("type", "src", "dst", "file_path", "line")


@query("g3_alias_closure", f", s AS (SELECT src, dst FROM edges WHERE type = 'depends_on' AND dst = 'external:{BRAND}') SELECT DISTINCT src AS id FROM s UNION SELECT 'external:{BRAND}'")
def alias_closure(g: Graph) -> DataFrame:
    seeds = g.nodes.filter(F.col("id") == f"external:{BRAND}").select("id")
    pairs = g.edges.filter(f"type = 'depends_on' and dst = 'external:{BRAND}'").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return closure(seeds, pairs)


@query("c6_induced_edges", "SELECT type, src, dst, line FROM edges WHERE src IN (SELECT id FROM sup) AND dst IN (SELECT concat('external:Brand#', CAST(k AS VARCHAR(5))) FROM geo)")
def induced(g: Graph) -> DataFrame:
    own = g.nodes.filter("(kind = 'symbol' and name like 'Supplier%') or (kind = 'external' and cast(substring(name, 7) as int) < 25)").select("id")
    return g.edges.filter("type = 'depends_on'").join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select("type", "src", "dst", "line")


@query("k3_incremental_upsert", f"""SELECT type, count(*) AS n FROM edges e JOIN nodes f ON f.id = src JOIN nodes t ON t.id = dst
WHERE coalesce(e.file_path, '') <> '{FILE}' AND coalesce(f.file_path, '') <> '{FILE}' AND coalesce(t.file_path, '') <> '{FILE}' GROUP BY type""")
def incremental(g: Graph) -> DataFrame:
    changed = g.spark.range(1).select(F.lit(FILE).alias("file_path"))
    return upserted(g.nodes, g.edges, g.nodes.limit(0), g.edges.limit(0), changed)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("f2_edge_keys", "SELECT concat_ws('|', type, src, dst, coalesce(file_path, ''), coalesce(CAST(line AS VARCHAR(20)), '')) AS k FROM edges WHERE type IN ('imports', 'contains')")
def edge_keys(g: Graph) -> DataFrame:
    return g.edges.filter("type in ('imports', 'contains')").select(edge_key().alias("k"))


@query("h4_name_variants", "SELECT id, len(list_distinct([name, split_part(name, '.', -1)])) AS n, list_distinct([name])[1] AS first FROM nodes WHERE kind = 'external'")
def variants(g: Graph) -> DataFrame:
    v = name_variants(F.col("name"))
    return g.nodes.filter("kind = 'external'").select("id", F.size(v).cast("long").alias("n"), v[0].alias("first"))


@query("h9_common_prefix", "SELECT a.path AS a, b.path AS b, CASE WHEN a.path = b.path THEN 2 WHEN a.r_name = b.r_name THEN 1 ELSE 0 END AS n FROM geo a CROSS JOIN geo b")
def prefixes(g: Graph) -> DataFrame:
    paths = g.nodes.filter("kind = 'file'").select("file_path")
    every = paths.agg(F.collect_list("file_path").alias("all"))  # 25 files; a fixture for the expression
    return paths.crossJoin(every).select(F.col("file_path").alias("a"), F.explode("all").alias("b")).withColumn("n", common_prefix(F.col("a"), F.col("b")))


@query("b8_test_paths", "SELECT id, regexp_matches(lower(file_path), '(^|/)(tests?|specs?|__tests__|__mocks__)(/|$)|[.-](test|spec)[.]') AS is_test FROM nodes WHERE kind = 'file'")
def test_paths(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'file'").select("id", is_test_path(F.col("file_path")).alias("is_test"))


@query("h19_module_key", "SELECT id, CASE WHEN file_path IS NULL THEN '(virtual)' ELSE split_part(file_path, '/', 1) END AS module FROM nodes")
def module_keys(g: Graph) -> DataFrame:
    return g.nodes.select("id", module_key(F.col("file_path")).alias("module"))


@query("h14_virtual_paths", "SELECT id, '__virtual__/' || kind || '/' || replace(replace(id, chr(92), '/'), ':', '_') AS path, TRUE AS virtual FROM nodes WHERE file_path IS NULL")
def virtual_paths(g: Graph) -> DataFrame:
    made = g.nodes.filter("file_path IS NULL").select("id", virtual_path(F.col("kind"), F.col("id")).alias("path"))
    return made.withColumn("virtual", is_virtual_path(F.col("path")))


def parts_query(name: str, sql: str):
    """Registers a function of the part table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/part.parquet"))
        ORACLE_SQL[name] = sql
        return f

    return add


@parts_query("r8_resolver_decisions", """WITH p AS (SELECT p_name, concat('symbol:', p_brand, '/', p_type, '.cs#', p_name, '@', CAST(p_partkey AS VARCHAR(20))) AS id,
  count(*) OVER (PARTITION BY p_name) AS candidates, count(*) OVER (PARTITION BY p_name, p_brand, p_type) AS alike FROM part)
SELECT id, candidates, CASE WHEN alike = 1 THEN 'ranked_auto_resolved' ELSE 'ranked_low_confidence' END AS decision,
  CAST(CASE WHEN alike = 1 THEN 0.85 ELSE 0.0975 END AS DOUBLE) AS confidence, CASE WHEN alike = 1 THEN id ELSE concat('external:', p_name) END AS target FROM p""")
def resolver_decisions(part: DataFrame) -> DataFrame:
    """Every part is a symbol of the file <brand>/<type>.cs and calls the external that bears its own name."""
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit(".cs"))
    symbol = part.select(F.concat(F.lit("symbol:"), path, F.lit("#"), "p_name", F.lit("@"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), path.alias("file_path"), F.create_map(F.lit("containingType"), "p_brand").alias("metadata"))
    outside = part.select(F.concat(F.lit("external:"), "p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    nodes = symbol.select("*", F.lit("symbol").alias("kind"), F.lit("csharp").alias("language")).unionByName(outside.withColumn("kind", F.lit("external")), allowMissingColumns=True)
    calls = symbol.select(F.lit("calls").alias("type"), F.col("id").alias("src"), F.concat(F.lit("external:"), "name").alias("dst"), "file_path", F.lit(1).alias("line"))
    value = F.col("metadata")
    return resolved(nodes, calls).select(F.col("src").alias("id"), value["resolverCandidateCount"].cast("long").alias("candidates"), value["resolverDecision"].alias("decision"), value["resolverConfidence"].cast("double").alias("confidence"), F.col("dst").alias("target"))


CHANGES = "e AS (SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR(20)) AS file_path, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'change' END AS change_type FROM events)"


def changes_of(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add").otherwise("change")
    return events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("file_path"), kind.alias("change_type"))


@events_query("l2_change_coalesce", f"""WITH {CHANGES}, g AS (SELECT file_path, arg_max(change_type, (ts, seq)) AS latest, bool_or(change_type = 'delete') AS deleted, min(ts) AS detected_at FROM e GROUP BY file_path)
SELECT file_path, CASE WHEN deleted AND latest <> 'delete' THEN 'change' ELSE latest END AS change_type, epoch_us(detected_at) AS detected_us FROM g""")
def change_coalesce(events: DataFrame) -> DataFrame:
    return coalesced(changes_of(events), ["file_path"]).select("file_path", "change_type", F.unix_micros("detected_at").alias("detected_us"))


@events_query("l3_session_debounce", f"""WITH {CHANGES}, o AS (SELECT ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 60000000 THEN 1 ELSE 0 END AS opens, seq FROM e WINDOW w AS (ORDER BY ts)),
b AS (SELECT ts, CAST(sum(opens) OVER (ORDER BY ts) AS BIGINT) AS batch FROM o) SELECT batch, count(*) AS n, epoch_us(min(ts)) AS first_us FROM b GROUP BY batch""")
def session_debounce(events: DataFrame) -> DataFrame:
    return sessions(changes_of(events), 60_000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_us"))


@events_query("l4_queue_min", f"WITH {CHANGES} SELECT file_path, epoch_us(min(ts)) AS detected_us FROM e GROUP BY file_path")
def queue_min(events: DataFrame) -> DataFrame:
    return queued(changes_of(events), "file_path", "ts").select("file_path", F.unix_micros("ts").alias("detected_us"))
