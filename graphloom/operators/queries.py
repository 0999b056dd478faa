"""The graph queries. Options are clamped as stated; results are lazy frames in a dict, ``summary`` being one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.exprs import collated, edge_key, is_test_path, lexical_score, method_name, normal_path, weight
from graphloom.operators.frames import FEW, by_id, handed, page, pinned
from graphloom.operators.traverse import closure, connected, reached, steps_of, walk_scores
from graphloom.schema import ENTRY_NAMES, allowed, clamp


class Graph:
    """nodes(id, kind, name, language, file_path, ...) and edges(type, src, dst, file_path, line, ...)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    def semantic(self, structural: bool = False) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*allowed(structural)))

    def roots(self, symbol: str, matching: str = "prefer_qualified") -> DataFrame:
        """Nodes with that id; else symbols with that name; else, for ``name`` only, other nodes with it."""
        s = symbol.strip()
        tier = F.when(F.col("id") == s, 1)
        if matching != "qualified_only":
            tier = tier.when((F.col("name") == s) & (F.col("kind") == "symbol"), 2)
        if matching == "name":
            tier = tier.when(F.col("name") == s, 3)
        found = self.nodes.withColumn("tier", tier).filter(F.col("tier").isNotNull() & F.lit(bool(s)))
        best = found.agg(F.min("tier").alias("best"))
        return found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")

    def unique_names(self, among: DataFrame) -> DataFrame:
        """Names of exactly one symbol, of those that among(name) has."""
        return self.nodes.filter("kind = 'symbol'").join(among.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("name")

    def expanded(self, targets: DataFrame) -> DataFrame:
        """The alias closure over depends_on: with a in the target set its neighbour b joins it, if b is an external with a unique symbol's name, or any external beside a target that is one."""
        external = self.nodes.filter("kind = 'external'").select("id", "name")
        unique = pinned(external.join(self.unique_names(external), "name", "left_semi").select("id"))
        anchored = pinned(targets.select("id").join(unique, "id", "left_semi"))
        d = self.edges.filter("type = 'depends_on'").select("src", "dst")
        both = d.select(F.col("dst").alias("a"), F.col("src").alias("b")).unionByName(d.select(F.col("src").alias("a"), F.col("dst").alias("b")))

        def kept(led: DataFrame) -> DataFrame:
            led = pinned(led)
            strong = led.join(unique.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
            weak = led.join(anchored.withColumnRenamed("id", "a"), "a", "left_semi").join(external.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
            return strong.unionByName(weak)

        return closure(targets, both, kept)

    def items(self, edges: DataFrame, flow: str | None = None) -> DataFrame:
        """Edges with both ends' name, kind and path; unknown ends show their id."""
        ends = self.nodes.select("id", "name", "kind", "file_path")
        f = ends.select(*(F.col(c).alias(f"from_{c}") for c in ends.columns))
        t = ends.select(*(F.col(c).alias(f"to_{c}") for c in ends.columns))
        out = edges if flow is None else edges.withColumn("flow", F.lit(flow))
        out = out.join(f, F.col("src") == F.col("from_id"), "left").join(t, F.col("dst") == F.col("to_id"), "left")
        return out.select(
            F.col("type").alias("kind"), "file_path", "line", "flow", F.col("src").alias("from_id"), F.coalesce("from_name", "src").alias("from_name"),
            F.coalesce("from_kind", F.lit("unknown")).alias("from_kind"), "from_file_path", F.col("dst").alias("to_id"), F.coalesce("to_name", "dst").alias("to_name"),
            F.coalesce("to_kind", F.lit("unknown")).alias("to_kind"), "to_file_path",
            F.when(F.col("to_kind") == "external", "unresolved").otherwise("resolved").alias("resolution"),
        )

    REFERENCE_ORDER = ("file_path", "from_id", "to_id", "kind", "line", "flow")

    def references(self, symbol: str, limit: int = 200, offset: int = 0, structural: bool = False, matching: str = "prefer_qualified", external_names: bool = True, aliases: bool = True, exclude_self: bool = False, test_only: bool = False) -> dict[str, DataFrame]:
        """Edges into a symbol: roots, externals with a root's name, their aliases."""
        limit, offset = clamp(limit, 1, 1000, 200), clamp(offset, 0, 100_000, 0)
        roots = self.roots(symbol, matching)
        seeds = roots.select("id")
        if external_names or aliases:
            seeds = seeds.unionByName(self.nodes.filter("kind = 'external'").join(roots.select("name").distinct(), "name", "left_semi").select("id")).distinct()
        targets = self.expanded(seeds) if aliases else pinned(seeds)
        found = self.items(self.semantic(structural).join(handed(targets.withColumnRenamed("id", "dst")), "dst", "left_semi"), "inbound")
        if aliases:
            direct = seeds.select(F.col("id").alias("to_id"), F.lit(True).alias("direct"))
            found = found.join(direct, "to_id", "left").withColumn("resolution", F.when(F.col("direct").isNull(), "alias_expanded").otherwise(F.col("resolution"))).drop("direct")
        if exclude_self:
            found = found.filter(F.coalesce(F.col("from_file_path") != F.col("to_file_path"), F.lit(True)))
        if test_only:
            found = found.filter(is_test_path(F.coalesce("file_path", "from_file_path")))
        files = found.groupBy(F.coalesce("file_path", "from_file_path", "to_file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("references")).filter("file_path is not null")
        rank = [collated(F.coalesce(c, F.lit(""))) if c != "line" else F.coalesce(c, F.lit(0)) for c in self.REFERENCE_ORDER]
        return {"roots": roots, "all": found, "references": page(found, rank, offset, limit), "files": files.orderBy(F.desc("references"), by_id("file_path")), "summary": found.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)}

    USAGE_KEY = ("kind", "file_path", "line", "from_id", "to_id", "flow", "resolution")

    def method_usage(self, text: str, limit: int = 200, offset: int = 0, **options: object) -> dict[str, DataFrame]:
        """References of the method a text speaks of and, where that gives none, of the text itself; at most 1000 an attempt.

        Attempts are merged: of references equal in USAGE_KEY the last attempt's stays. A reference without a line comes last in its file.
        """
        limit, offset, name = clamp(limit, 1, 1000, 200), clamp(offset, 0, 100_000, 0), method_name(text)
        tries = [self.references(name, limit=1000, matching="name", **options)]  # type: ignore[arg-type]
        if name != text.strip() and (tries[0]["roots"].isEmpty() or tries[0]["references"].isEmpty()):
            tries.append(self.references(text, limit=1000, **options))  # type: ignore[arg-type]
        roots, found = tries[0]["roots"], tries[0]["references"].withColumn("attempt", F.lit(0))
        for k, t in enumerate(tries[1:], 1):
            roots, found = roots.unionByName(t["roots"]), found.unionByName(t["references"].withColumn("attempt", F.lit(k)))
        columns = tries[0]["references"].columns
        rest = [c for c in columns if c not in self.USAGE_KEY]
        merged = found.groupBy(*self.USAGE_KEY).agg(F.max_by(F.struct(*rest), "attempt").alias("last")).select(*self.USAGE_KEY, "last.*").select(columns)
        at = F.coalesce("file_path", "from_file_path", "to_file_path")
        files = merged.groupBy(at.alias("file_path")).agg(F.count(F.lit(1)).alias("references")).filter("file_path is not null")
        rank = [collated(F.coalesce(at, F.lit(""))), F.col("line").asc_nulls_last(), *(collated(F.col(c)) for c in ("from_id", "to_id", "kind", "flow", "resolution"))]
        summary = merged.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)
        return {"roots": roots.dropDuplicates(["id"]), "all": merged, "references": page(merged, rank, offset, limit), "files": files.orderBy(F.desc("references"), by_id("file_path")), "summary": summary}

    def file_references(self, path: str, direction: str = "both", structural: bool = False, external_names: bool = True, aliases: bool = True, test_only: bool = False) -> dict[str, DataFrame]:
        """Other files that this one uses or is used by, with counts each way."""
        own = self.nodes.filter(F.col("file_path") == path)
        seeds = own.select("id")
        if external_names:
            named = own.filter("kind = 'symbol'").select("name").join(self.unique_names(own), "name", "left_semi")
            seeds = seeds.unionByName(self.nodes.filter("kind = 'external'").join(named, "name", "left_semi").select("id")).distinct()
        if aliases:
            seeds = self.expanded(seeds)
        mark = handed(pinned(seeds.distinct()))
        e = self.semantic(structural)
        e = e.join(mark.select(F.col("id").alias("dst"), F.lit(True).alias("into")), "dst", "left").join(mark.select(F.col("id").alias("src"), F.lit(True).alias("out")), "src", "left")
        e = e.filter("into or out").withColumn("flow", F.when(F.col("into"), "inbound").otherwise("outbound")).drop("into", "out")
        if direction in ("inbound", "outbound"):
            e = e.filter(F.col("flow") == direction)
        found = self.items(e).withColumn("other", F.when(F.col("flow") == "inbound", F.coalesce("from_file_path", "file_path")).otherwise(F.col("to_file_path")))
        found = found.filter(F.col("other").isNotNull() & (F.col("other") != path))
        if test_only:
            found = found.filter(is_test_path(F.col("other")))
        n = {f: F.sum((F.col("flow") == f).cast("long")).alias(f) for f in ("inbound", "outbound")}
        return {"references": found, "files": found.groupBy(F.col("other").alias("file_path")).agg(n["inbound"], n["outbound"], F.count(F.lit(1)).alias("references"))}

    def neighborhood(self, symbol: str, depth: int = 2, limit: int = 100, offset: int = 0, edge_limit: int = 500, direction: str = "both", structural: bool = False) -> dict[str, DataFrame]:
        """The first root's surroundings: nodes by id, and touched edges with both ends on the page."""
        depth, limit, offset, edge_limit = clamp(depth, 1, 6, 2), clamp(limit, 1, 500, 100), clamp(offset, 0, 100_000, 0), clamp(edge_limit, 1, 2000, 500)
        root = self.roots(symbol).orderBy(by_id()).limit(1).select("id")
        hops = reached(root, steps_of(self.edges, direction, structural), depth, clamp(offset + limit + 200, 100, 5000, 100))
        nodes = page(self.nodes.join(F.broadcast(hops), "id"), [by_id()], offset, limit)
        near = F.broadcast(hops.filter(F.col("hop") < depth).select("id"))
        e = self.semantic(structural)
        out, into = e.join(near.withColumnRenamed("id", "src"), "src", "left_semi"), e.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
        cols = e.columns
        touched = {"outbound": out, "inbound": into}.get(direction, out.select(cols).unionByName(into.select(cols)).distinct())
        own = F.broadcast(nodes.select("id"))
        shown = touched.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return {"hops": hops, "nodes": nodes, "edges": page(shown.select(cols), [collated(edge_key())], 0, edge_limit)}

    def hybrid(self, query: str, depth: int = 2, limit: int = 50, offset: int = 0, structural: bool = False) -> dict[str, DataFrame]:
        """Symbols and externals by words, nearness to worded ones, and weighted degree."""
        depth, limit, offset = clamp(depth, 1, 4, 2), clamp(limit, 1, 1000, 50), clamp(offset, 0, 100_000, 0)
        sig = F.col("signature") if "signature" in self.nodes.columns else F.lit(None).cast("string")
        named = self.nodes.filter(F.col("kind").isin("symbol", "external")).withColumn("lexical", lexical_score(query, F.col("name"), F.col("id"), F.col("file_path"), sig))
        near = walk_scores(named.filter("lexical > 0").select("id", F.col("lexical").alias("score")), self.edges, depth, structural)
        e = self.semantic(structural).select("src", "dst", weight(F.col("type")).alias("w"))
        degree = e.select(F.col("src").alias("id"), "w").unionByName(e.select(F.col("dst").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("degree"))
        zero = F.lit("0").cast("decimal(10,6)")
        all_ = named.join(near, "id", "left").join(degree, "id", "left").select(
            "id", "name", "kind", "file_path", "lexical", F.coalesce("proximity", zero).alias("proximity"),
            F.round(F.least(F.lit("1").cast("decimal(10,6)"), F.coalesce("degree", zero).cast("decimal(18,2)") / F.lit("4").cast("decimal(3,0)")), 6).cast("decimal(10,6)").alias("semantic"),
        ).filter("lexical > 0 or proximity > 0")
        part = {c: F.col(c) * F.lit(w).cast("decimal(3,2)") for c, w in (("lexical", "0.55"), ("proximity", "0.30"), ("semantic", "0.15"))}
        hits = all_.withColumn("score", F.round(part["lexical"] + part["proximity"] + part["semantic"], 6).cast("decimal(10,6)"))
        files = hits.filter("file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("max_score"))
        return {"all": hits, "hits": page(hits, [F.desc("score"), F.desc("lexical"), F.desc("proximity"), by_id()], offset, limit), "files": files}

    def impact(self, files: list[str] = (), symbols: list[str] = (), depth: int = 2, limit: int = 100, offset: int = 0, edge_limit: int = 500, direction: str = "both", structural: bool = False) -> dict[str, DataFrame]:  # type: ignore[assignment]
        """What changed files or symbols reach; externals are touched but not passed."""
        depth, limit, offset, edge_limit = clamp(depth, 1, 6, 2), clamp(limit, 1, 500, 100), clamp(offset, 0, 100_000, 0), clamp(edge_limit, 1, 2000, 500)
        seeds = self.nodes.filter(F.col("file_path").isin(list(files)) | F.col("name").isin(list(symbols)) | F.col("id").isin(list(symbols))).select("id", "kind")
        inner = self.nodes.filter("kind <> 'external'").select("id")
        hops = F.broadcast(reached(seeds.select("id"), steps_of(self.edges, direction, structural), depth, clamp(offset + limit + 400, 200, 5000, 200), inner))
        visited = self.nodes.join(hops, "id")
        near = F.broadcast(visited.filter((F.col("hop") < depth) & (F.col("kind") != "external")).select("id"))
        e = self.semantic(structural)
        cols = e.columns
        out, into = e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").select(cols), e.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(cols)
        touched = {"outbound": out, "inbound": into}.get(direction, out.unionByName(into).distinct())
        ends = self.nodes.select("id", F.col("kind").alias("k"), F.col("name").alias("nm"), F.col("file_path").alias("fp"))
        f, t = ends.select(*(F.col(c).alias(f"f_{c}") for c in ends.columns)), ends.select(*(F.col(c).alias(f"t_{c}") for c in ends.columns))
        both = touched.join(f, F.col("src") == F.col("f_id")).join(t, F.col("dst") == F.col("t_id"))
        outward = (F.col("t_k") == "external") & (F.col("f_k") != "external")
        inward = (F.col("f_k") == "external") & (F.col("t_k") != "external")
        beside = both.filter(outward | inward).select(
            F.when(outward, F.col("t_id")).otherwise(F.col("f_id")).alias("symbol_id"), F.when(outward, F.col("t_nm")).otherwise(F.col("f_nm")).alias("symbol"), outward.alias("o"),
            F.when(outward, F.col("f_id")).otherwise(F.col("t_id")).alias("inside"), F.coalesce("file_path", F.when(outward, F.col("f_fp")).otherwise(F.col("t_fp"))).alias("at"),
        ).join(visited.select(F.col("id").alias("inside")), "inside", "left_semi")
        per = beside.groupBy("symbol_id", "symbol", "at").agg(F.count(F.lit(1)).alias("references"), F.sum(F.col("o").cast("long")).alias("outbound"))
        touch = per.groupBy("symbol_id", "symbol").agg(
            F.sum("references").alias("references"), (F.sum("references") - F.sum("outbound")).alias("inbound"), F.sum("outbound").alias("outbound"),
            F.array_sort(F.collect_list(F.when(F.col("at") != "", F.struct((-F.col("references")).alias("neg"), F.col("at").alias("file_path"))))).alias("files"),
        )
        n = visited.filter("file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("hits"))
        inner_edges = touched.join(visited.select(F.col("id").alias("src")), "src", "left_semi").join(visited.select(F.col("id").alias("dst")), "dst", "left_semi").select(cols)
        return {"visited": visited, "nodes": page(visited, [by_id()], offset, limit), "edges": page(inner_edges, [collated(edge_key())], 0, edge_limit), "files": n, "touchpoints": touch.orderBy(F.desc("references"), collated(F.col("symbol")), by_id("symbol_id"))}

    def clusters(self) -> tuple[DataFrame, DataFrame]:
        """(clusters: root, size, internal_edges, density; members: id, root) over symbols, externals and semantic edges.

        Each node's smallest neighbour either way links most nodes; pairs between two nodes of the largest cluster so found
        need no further look but to be counted. The others are those with an end outside it: if such ends are few, they
        are broadcast to find them; if they are many, all pairs go through the components.
        """
        inner = self.nodes.filter(F.col("kind").isin("symbol", "external")).select("id").distinct()
        e = self.semantic().filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))

        def known(pairs: DataFrame) -> DataFrame:
            return pairs.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")

        hooks = pinned(known(e.groupBy("a").agg(F.min("b").alias("b")).unionByName(e.groupBy("b").agg(F.min("a").alias("a")))).distinct())
        members = pinned(connected(inner, hooks))
        top = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").first()
        root = top["root"] if top else None
        ends = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
        outside = pinned(ends.join(members.filter(F.col("root") == root).select("id"), "id", "left_anti"))
        if outside.count() <= FEW:
            a, b = (F.broadcast(outside.withColumnRenamed("id", c)) for c in ("a", "b"))
            core = e.join(a, "a", "left_anti").join(b, "b", "left_anti").distinct()
            rest = pinned(known(e.join(a, "a", "left_semi").select("a", "b").unionByName(e.join(b, "b", "left_semi").select("a", "b")).distinct()))
            if not rest.isEmpty():
                members = pinned(connected(inner, hooks.unionByName(rest)))
            counts = rest.join(members, F.col("a") == F.col("id")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
            counts = counts.unionByName(members.filter(F.col("id") == root).select("root").crossJoin(core.agg(F.count(F.lit(1)).alias("n"))))
        else:
            every = known(e.distinct())
            members = pinned(connected(inner, every))
            counts = every.join(members, F.col("a") == F.col("id")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        within = counts.groupBy("root").agg(F.sum("n").alias("internal_edges"))
        pairs = F.col("size") * (F.col("size") - 1) / 2
        found = sizes.join(within, "root", "left").select("root", "size", F.coalesce("internal_edges", F.lit(0).cast("long")).alias("internal_edges"))
        return found.withColumn("density", F.when(F.col("size") < 2, F.lit(0.0)).otherwise(F.round(F.col("internal_edges") / pairs, 4))), members

    def related_clusters(self, files: list[str] = (), symbols: list[str] = (), min_size: int = 2, limit: int = 20, offset: int = 0, member_limit: int = 25) -> dict[str, DataFrame]:  # type: ignore[assignment]
        """clusters: by seed hits, size, density; without any seed found, all of them. files: root, file_path, hits. members: the first of each cluster.

        Files and members are found for the clusters of the page only, at most 1000, whose roots are broadcast.
        """
        found, members = self.clusters()
        seeds = self.nodes.filter(F.col("kind").isin("symbol", "external") & (F.col("file_path").isin(list(files)) | F.col("name").isin(list(symbols)) | F.col("id").isin(list(symbols)))).select("id").distinct()
        hits = members.join(seeds, "id", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("seed_hits"))
        out = found.filter(F.col("size") >= clamp(min_size, 1, 10_000, 2)).join(hits, "root", "left").withColumn("seed_hits", F.coalesce("seed_hits", F.lit(0).cast("long")))
        if not seeds.isEmpty():
            out = out.filter("seed_hits > 0")
        top = pinned(page(out, [F.desc("seed_hits"), F.desc("size"), F.desc("density"), by_id("root")], clamp(offset, 0, 100_000, 0), clamp(limit, 1, 1000, 20)))
        inside = members.join(F.broadcast(top.select("root")), "root")
        placed = self.nodes.filter("file_path <> ''").select("id", normal_path(F.col("file_path")).alias("file_path"))
        rank = F.row_number().over(Window.partitionBy("root").orderBy(by_id(), "id"))
        return {
            "clusters": top,
            "files": inside.join(placed, "id").groupBy("root", "file_path").agg(F.count(F.lit(1)).alias("hits")).orderBy("root", F.desc("hits"), collated(F.col("file_path"))),
            "members": inside.select("root", "id", rank.alias("place")).filter(F.col("place") <= clamp(member_limit, 1, 500, 25)),
        }

    def process_flow(self, entries: list[str] = (), limit: int = 100, offset: int = 0, edge_limit: int = 500, structural: bool = False) -> dict[str, DataFrame]:  # type: ignore[assignment]
        """Entry points and one outbound step from them."""
        named = F.col("id").isin(list(entries)) | F.col("name").isin(list(entries)) if entries else F.col("name").isin(*ENTRY_NAMES)
        entry = self.nodes.filter((F.col("kind") == "symbol") & named)
        e = self.semantic(structural).join(entry.select(F.col("id").alias("src")), "src", "left_semi").select(self.edges.columns)
        seen = entry.select("id").unionByName(e.select(F.col("dst").alias("id"))).distinct()
        nodes = self.nodes.join(seen, "id", "left_semi")
        return {"entries": entry, "all_edges": e, "all_nodes": nodes, "nodes": page(nodes, [by_id()], clamp(offset, 0, 100_000, 0), clamp(limit, 1, 1000, 100)), "edges": page(e, [collated(edge_key())], 0, clamp(edge_limit, 1, 2000, 500))}

    def sample(self, limit: int = 400) -> dict[str, DataFrame]:
        """The nodes of largest degree and the edges between them."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        nodes = page(self.nodes.join(ends, "id", "left").fillna(0, ["degree"]), [F.desc("degree"), by_id()], 0, clamp(limit, 25, 5000, 400))
        own = nodes.select("id")
        e = self.edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return {"nodes": nodes, "edges": e.select(self.edges.columns)}
