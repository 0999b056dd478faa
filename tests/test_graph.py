import pytest

from graphloom.functions.exprs import is_test_path, is_virtual_path, method_name, virtual_path
from graphloom.operators import queries
from graphloom.operators.queries import Graph
from graphloom.operators.rollup import first_edges, upserted
from graphloom.operators.traverse import reached
from graphloom.schema import clamp, symbol_id
from graphloom.sources import derived
from graphloom.sources.scan import normal_changes, scan
from graphloom.sources.store import Store
from graphloom.streaming.changes import Runtime

NODE = "id string, kind string, name string, language string, file_path string"
EDGE = "type string, src string, dst string, file_path string, line int"


def symbol(name, path):
    return (f"symbol:{name}", "symbol", name, "typescript", path)


def external(name):
    return (f"external:{name}", "external", name, None, None)


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def test_references_and_paging(spark):
    g = graph(spark, [symbol("t", "a.ts"), symbol("x", "b.ts"), symbol("y", "test/c.ts")], [("calls", "symbol:x", "symbol:t", "b.ts", 10), ("calls", "symbol:y", "symbol:t", "test/c.ts", 12), ("calls", "symbol:t", "symbol:t", "a.ts", 1)])
    out = g.references("t", limit=1)
    assert out["summary"].first().asDict() == {"total": 3, "has_more": True}
    assert [r.line for r in g.references("t", limit=1, offset=1)["references"].collect()] == [10]
    assert g.references("t", exclude_self=True)["all"].count() == 2
    assert [r.line for r in g.references("t", test_only=True)["all"].collect()] == [12]


def test_alias_closure_and_ambiguity(spark):
    nodes = [symbol("Impl", "i.cs"), symbol("Use", "u.cs"), external("Impl"), external("IImpl")]
    edges = [("depends_on", "external:IImpl", "external:Impl", "di.cs", 1), ("depends_on", "symbol:Use", "external:IImpl", "u.cs", 5)]
    found = graph(spark, nodes, edges).references("Impl")["all"].collect()
    assert len(found) == 2 and {r.resolution for r in found} == {"unresolved", "alias_expanded"}
    twice = graph(spark, [*nodes, ("symbol:Impl2", "symbol", "Impl", "csharp", "j.cs")], edges).references("Impl")["all"].collect()
    assert {r.from_id for r in twice} == {"external:IImpl"}


def test_clusters(spark):
    nodes = [symbol(n, "a.ts") for n in "abcde"]
    found = graph(spark, nodes, [("calls", "symbol:a", "symbol:b", "a.ts", 1), ("calls", "symbol:b", "symbol:c", "a.ts", 2), ("calls", "symbol:d", "symbol:e", "a.ts", 3)]).clusters()[0]
    assert sorted((r["root"], r["size"], r["internal_edges"]) for r in found.collect()) == [("symbol:a", 3, 2), ("symbol:d", 2, 1)]


def test_impact_stops_at_externals(spark):
    g = graph(spark, [symbol("c", "a.ts"), symbol("d", "b.ts"), external("H")], [("calls", "symbol:c", "external:H", "a.ts", 1), ("calls", "external:H", "symbol:d", "b.ts", 2)])
    out = g.impact(files=["a.ts"], depth=3)
    assert [r.id for r in out["visited"].collect()] == ["symbol:c"]
    t = out["touchpoints"].first()
    assert (t["symbol"], t["references"], t["outbound"], t["inbound"]) == ("H", 1, 1, 0)


def test_store_incremental(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    g = graph(spark, [symbol("a", "src/a.ts"), symbol("b", "src/b.ts")], [("calls", "symbol:a", "symbol:b", "src/a.ts", 1)])
    first = store.write(g.nodes, g.edges)
    new = graph(spark, [symbol("a2", "src/a.ts")], [("calls", "symbol:a2", "symbol:b", "src/a.ts", 2), ("calls", "symbol:a2", "symbol:none", "src/a.ts", 3)])
    assert store.write(new.nodes, new.edges, ["src/a.ts"]) != first
    nodes, edges = store.read()
    assert sorted(r.id for r in nodes.collect()) == ["symbol:a2", "symbol:b"]
    assert [(r.src, r.line) for r in edges.collect()] == [("symbol:a2", 2)]


def test_scan(spark, tmp_path):
    for p in ("src/a b.ts", "node_modules/x.ts", "worktrees/y.ts", "src/c.cs", "src/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r.relative_path for r in scan(spark, str(tmp_path)).collect()) == ["src/a b.ts", "src/c.cs"]
    assert scan(spark, str(tmp_path), changed=[]).count() == 0
    assert [r.relative_path for r in scan(spark, str(tmp_path), changed=["src/c.cs", "gone.ts"]).collect()] == ["src/c.cs"]
    assert normal_changes("/r", ["src\\a.ts", "/r/src/a.ts", "/out/b.ts", "../c.ts", "worktrees/d.ts"]) == ["src/a.ts"]


def test_small_functions():
    assert clamp("7.9", 1, 6, 2) == 6 and clamp("x", 1, 6, 2) == 2 and clamp(-1.5, -3, 6, 2) == -1
    assert symbol_id("a\\b.ts", "f", 3) == "symbol:a/b.ts#f@3"
    assert method_name("symbol:a.cs#App.Run<T>(x)@12") == "Run"
    assert [method_name(x) for x in ("Foo#", "@Foo", "Foo.", "A.b#", "$foo", "")] == ["Foo", "Foo", "Foo", "b", "foo", ""]


def test_runtime():
    r = Runtime().to("starting").to("running").enqueue(["b", "a"], 100).enqueue(["a"], 50)
    assert r.queue == {"b": 100, "a": 50} and not r.ready(150) and r.ready(200)
    failed = r.begin().fail(300, "x")
    assert set(failed.queue) == {"a", "b"} and failed.lifecycle == "failed"
    done = failed.begin().complete(400)
    assert done.freshness(500) == "fresh" and done.freshness(70_000) == "stale" and Runtime().freshness(1) == "unknown"


def test_virtual_paths(spark):
    rows = spark.createDataFrame([("external", "external:a\\b:c"), ("module", "module:m"), (None, "x"), ("file", None)], "kind string, id string")
    made = rows.select(virtual_path(rows.kind, rows.id).alias("p"))
    assert [r.p for r in made.collect()] == ["__virtual__/external/external_a/b_c", "__virtual__/module/module_m", None, None]
    assert [r.v for r in made.select(is_virtual_path(made.p).alias("v")).collect()] == [True, True, False, False]


def test_touchpoints_are_ordered(spark):
    nodes = [symbol("s", "a.ts"), *(external(x) for x in ("zed", "Beta", "alpha"))]
    edges = [("calls", "symbol:s", f"external:{x}", "a.ts", k) for k, x in enumerate(["zed", "zed", "Beta", "alpha"])]
    touch = graph(spark, nodes, edges).impact(files=["a.ts"])["touchpoints"].collect()
    assert [(r.symbol, r.references) for r in touch] == [("zed", 2), ("alpha", 1), ("Beta", 1)]


def test_related_clusters(spark):
    nodes = [symbol("a", "x.ts"), symbol("B", "x.ts"), symbol("c", "y.ts"), external("e"), symbol("p", "z.ts"), symbol("q", "z.ts"), symbol("alone", "w.ts")]
    edges = [("calls", f"symbol:{u}", v, None, 1) for u, v in (("a", "symbol:B"), ("B", "symbol:c"), ("c", "external:e"), ("p", "symbol:q"))]
    g = graph(spark, nodes, edges)
    out = g.related_clusters(member_limit=3)
    assert [(r["size"], r.seed_hits) for r in out["clusters"].collect()] == [(4, 0), (2, 0)]
    assert [(r.file_path, r.hits) for r in out["files"].collect()][:2] == [("x.ts", 2), ("y.ts", 1)]
    assert [r.id for r in out["members"].orderBy("root", "place").collect()] == ["external:e", "symbol:a", "symbol:B", "symbol:p", "symbol:q"]
    assert [(r["size"], r.seed_hits) for r in g.related_clusters(files=["z.ts"])["clusters"].collect()] == [(2, 2)]
    assert g.related_clusters(symbols=["nobody"])["clusters"].count() == 2


def test_only_double_underscored_mocks_are_tests(spark):
    rows = spark.createDataFrame([("mocks/a.ts", False), ("__mocks__/a.ts", True), ("src/a-spec.ts", True), (None, False)], "path string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", is_test_path(rows.path).alias("got")).collect())


TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "R")]), "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 0)]),
    "part": ("p_partkey long, p_brand string", [(1, "B1"), (301, "B1"), (2, None)]), "orders": ("o_orderkey long, o_custkey long", [(1, 1), (501, 1), (2, 2), (3, None)]),
    "lineitem": ("l_orderkey long, l_suppkey long, l_partkey long", [(1, 1, 1), (501, 1, 301), (2, 1, 2), (2, 1, 2), (3, 1, 1), (2, None, 1)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "C1", 0, "S"), (1, "C1", 1, "S"), (2, "C2", 0, None), (2, "C2", 0, None)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "S1", 1)]),
}


@pytest.mark.parametrize("name", ["S2", None])
def test_derived_edges_are_those_of_the_sql(spark, tmp_path, monkeypatch, name):
    for table, (schema, rows) in TABLES.items():
        more = [(2, name, 0)] if table == "supplier" else [(2, 2, 2), (1, 2, 301)] if table == "lineitem" else []
        spark.createDataFrame(rows + more, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    monkeypatch.setattr(derived, "SCAN_ROWS", 4)
    edges, want = derived.stored(spark, str(tmp_path))[1], derived.graph(spark, str(tmp_path))[1]
    assert sorted(map(str, edges.collect())) == sorted(map(str, want.collect()))
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Relation") > 1  # of bounded rows each


def test_few_nodes_leave_edges_where_they_are(spark):
    steps = spark.createDataFrame([(f"{a}", f"{a % 3 + 1}") for a in range(1, 2000)] + [(None, "1"), ("1", None)], "a string, b string")
    hops = reached(spark.createDataFrame([("1",)], "id string"), steps, 4)
    assert sorted(hops.collect(), key=str) == sorted([("1", 0), ("2", 1), (None, 1), ("3", 2)], key=str)
    assert "Exchange" not in hops._jdf.queryExecution().executedPlan().toString()  # levels are computed, the steps not shuffled again
    g = graph(spark, [symbol("t", "a.ts"), symbol("x", "b.ts")], [("calls", "symbol:x", "symbol:t", "b.ts", 10)])
    assert "Exchange" not in g.impact(symbols=["t"])["visited"]._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


@pytest.mark.parametrize("few", [0, 500_000])
def test_clusters_beside_the_largest(spark, monkeypatch, few):
    monkeypatch.setattr(queries, "FEW", few)
    pairs = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("b", "y"), ("y", "b"), ("p", "q"), ("q", "p"), ("a", "gone"), ("a", "a"), ("c", "p")]
    nodes = [symbol(n, "a.ts") for n in "abcdxypqz"] + [("module:m", "module", "m", None, None)]
    edges = [("calls", f"symbol:{s}", f"symbol:{d}", "a.ts", k) for k, (s, d) in enumerate(pairs)] + [("imports", "symbol:z", "module:m", "a.ts", 1)]
    cut = [graph(spark, nodes, e).clusters()[0].collect() for e in (edges, [e for e in edges if e[4] != 10])]
    assert [sorted((r["root"][7:], r["size"], r["internal_edges"]) for r in found) for found in cut] == [[("a", 8, 7), ("z", 1, 0)], [("a", 6, 5), ("p", 2, 1), ("z", 1, 0)]]


def test_dedupe_sorts_after_its_exchange_alone(spark):
    edges = spark.createDataFrame([("calls", "a", "b", p, n, k) for k, (p, n) in enumerate([(None, 1), ("", 1), ("f", None), ("f", 0), ("f", 2)])], EDGE + ", seq int")
    found = first_edges(edges)
    assert sorted(r.seq for r in found.collect()) == [0, 2, 4]
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.rindex("Exchange hashpartitioning"):]


def test_update_drops_edges_without_ends(spark):
    g = graph(spark, [symbol("a", "a.ts"), symbol("b", "b.ts")], [("calls", "symbol:a", "symbol:b", None, 1), ("calls", "symbol:a", "symbol:c", None, 1), ("calls", None, "symbol:b", None, 2), ("calls", "symbol:b", None, None, 3)])
    kept = upserted(g.nodes, g.edges, g.nodes.limit(0), g.edges.limit(0), None)[1]
    assert [(r.src, r.dst) for r in kept.collect()] == [("symbol:a", "symbol:b")]
