"""Queries over a call graph: edges (source, target, file, line) and tables of nodes, references and files.

Walks are frontier loops: a join and an anti-join per level, each level checkpointed, so
the work is bounded by the edges of the levels and nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths, text

from .iterate import settled

MAX_DEPTH = 16
HUB, HUB_SHOWN = 20, 15
#: Fixed value: paths that an interactive caller lets a level expand.
EXPANSIONS = 10_000
#: Names that are too common to match by name alone.
DENIED = ("new", "get", "set", "push", "len", "map", "iter", "next", "clone", "to_string", "toString", "unwrap", "into", "from", "default")


def direct_callers(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Call sites with caller and, if its file still exists, target."""
    known = nodes.join(files.select("file"), "file", "left_semi")
    caller = known.select(F.col("node").alias("source"), F.col("name").alias("caller"))
    target = known.select(F.col("node").alias("target"), F.col("name").alias("callee"))
    return edges.join(caller, "source").join(target, "target", "left").select("source", "caller", "target", "callee", F.col("file"), "line")


def caller_counts(edges: DataFrame, requested: DataFrame) -> DataFrame:
    """(target, n): distinct call sites of each requested target, 0 included."""
    sites = edges.select("target", "file", "line").distinct()
    return requested.join(sites, "target", "left").groupBy("target").agg(F.count("file").alias("n"))


def unresolved(refs: DataFrame, edges: DataFrame) -> DataFrame:
    return refs.join(edges.select("ref_id"), "ref_id", "left_anti")


def dependents(refs: DataFrame, dependencies: DataFrame, file: Column | int) -> DataFrame:
    """References from files that depend on a file, or that point into it."""
    users = dependencies.where(F.col("dep_file") == file).select(F.col("file").alias("caller_file"))
    return refs.join(users, "caller_file", "left_semi").unionByName(refs.where(F.col("target_file") == file)).distinct()


def outbound_calls(refs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, caller, target): references with their caller and target names, the written name where nothing is resolved."""
    caller = nodes.select(F.col("node").alias("caller_node"), F.col("name").alias("caller"))
    target = nodes.select(F.col("node").alias("target"), F.col("name").alias("resolved"))
    rows = refs.join(caller, "caller_node", "left").join(edges.select("ref_id", "target"), "ref_id", "left").join(target, "target", "left")
    return rows.select("ref_id", "caller", F.coalesce("resolved", "name").alias("target"))


def forward_calls(refs: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolved and unresolved calls of some nodes, as (source, line, target), unresolved ones with a null target."""
    own = refs.join(sources.select(F.col("source").alias("caller_node")), "caller_node", "left_semi")
    hit = own.join(edges.select("ref_id", "target"), "ref_id").select(F.col("caller_node").alias("source"), "line", "target")
    miss = unresolved(own, edges).select(F.col("caller_node").alias("source"), "line", F.lit(None).cast("long").alias("target"))
    return hit.unionByName(miss)


def walk(edges: DataFrame, start: DataFrame, depth: int | None, forward: bool = True) -> DataFrame:
    """(node, depth): what start (node) reaches, with the least number of steps; without a limit if depth is None."""
    a, b = ("source", "target") if forward else ("target", "source")
    steps = settled(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    seen = settled(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        new = frontier.join(steps, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        frontier = settled(new)  # the one table of a level: what was seen is the union of the levels' tables
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 32 == 0:  # of deep walks, so that the union stays short
            seen = settled(seen)
    return seen


def callers(edges: DataFrame, target: int, depth: int) -> DataFrame:
    """(node, depth) of the direct and indirect callers, by the shortest way."""
    start = edges.select(F.lit(target).cast("long").alias("node")).limit(1)
    return walk(edges, start, min(depth, MAX_DEPTH), forward=False).where("depth > 0")


def impact(edges: DataFrame, target: int, depth: int, lines: DataFrame | None = None) -> DataFrame:
    """Call sites (file, line, source, target, depth) that a change of target may touch, with the source line if lines (file, line, text) are given."""
    near = callers(edges, target, depth).select(F.col("node").alias("source"), "depth")
    reached = near.select(F.col("source").alias("target")).union(near.sparkSession.createDataFrame([(target,)], "target long"))
    sites = edges.join(near, "source").join(reached, "target", "left_semi").select("file", "line", "source", "target", "depth").distinct()
    return sites if lines is None else sites.join(lines, ["file", "line"], "left")


def hub_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows, or the first of each key of a hub: (rows that show, n)."""
    w = Window.partitionBy("target")
    out = rows.withColumn("n", F.count("*").over(w)).dropDuplicates(["target", *keys, "n"])
    return out.withColumn("nth", F.row_number().over(w.orderBy(*keys))).where((F.col("n") <= HUB) | (F.col("nth") <= HUB_SHOWN)).drop("nth")


def simple_paths(edges: DataFrame, start: DataFrame, depth: int, forward: bool = True, budget: int | None = None) -> DataFrame:
    """(path, depth, truncated): all paths without a repeated node from start, up to a depth.

    A budget, as EXPANSIONS, keeps only so many paths of a level, the smallest; truncated says whether it took any away."""
    a, b = ("source", "target") if forward else ("target", "source")
    steps = settled(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    level = settled(start.select("node", F.array("node").alias("path")).distinct())
    out, truncated = [level.select("path", F.lit(0).alias("depth"))], False
    for d in range(1, depth + 1):
        level = settled(level.join(steps, "node").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        n = level.count()
        if not n:
            break
        if budget is not None and n > budget:
            level, truncated = settled(level.orderBy("path").limit(budget)), True
        out.append(level.select("path", F.lit(d).alias("depth")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.withColumn("truncated", F.lit(truncated))


def call_tree(edges: DataFrame, root: int, depth: int, budget: int | None = None) -> DataFrame:
    """(path, depth, hidden, truncated): the tree of calls as paths; a node already on its path is a leaf; hidden counts children below the limit."""
    start = edges.select(F.lit(root).cast("long").alias("node")).limit(1)
    tree = simple_paths(edges, start, depth, budget=budget)
    fan = edges.select("source", "target").distinct().groupBy("source").agg(F.count("*").alias("n"))
    last = F.element_at("path", -1)
    return tree.join(fan, last == F.col("source"), "left").select("path", "depth", F.when(F.col("depth") == depth, F.coalesce("n", F.lit(0))).otherwise(0).alias("hidden"), "truncated")


def trace_paths(edges: DataFrame, target: int, entries: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(path, depth, truncated): from each entry (node) to target, without a repeated node."""
    start = edges.select(F.lit(target).cast("long").alias("node")).limit(1)
    rows = simple_paths(edges, start, depth, False, budget).where("depth > 0")
    return rows.join(entries.select(F.col("node").alias("e")), F.element_at("path", -1) == F.col("e"), "left_semi").select(F.reverse("path").alias("path"), "depth", "truncated")


def shortest_path(edges: DataFrame, a: int, b: int, depth: int = MAX_DEPTH) -> DataFrame:
    """(path, depth): the shortest path from a to b, of several the smallest; empty if there is none within the depth."""
    steps = settled(edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    level = edges.select(F.lit(a).cast("long").alias("node"), F.array(F.lit(a).cast("long")).alias("path")).limit(1)
    seen = level.select("node")
    for d in range(depth + 1):
        level = settled(level)
        hit = level.where(F.col("node") == b)
        if d == depth or level.isEmpty() or not hit.isEmpty():
            return hit.select("path", F.lit(d).alias("depth"))
        level = level.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path")).join(seen, "node", "left_anti")
        seen = settled(seen.union(level.select("node")))
    raise AssertionError


def reachable(edges: DataFrame, roots: DataFrame, *more: DataFrame) -> DataFrame:
    """(node): what roots reach over the union of edge sets (source, target)."""
    whole = edges.select("source", "target")
    for x in more:
        whole = whole.unionByName(x.select("source", "target"))
    return walk(whole, roots, None).select("node")


def dead_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (node, ...) that no root reaches."""
    return nodes.join(reachable(edges, roots), "node", "left_anti")


def _propagated(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest label among a node and all that reach it over edges (source, target)."""
    while True:
        new = edges.join(labels.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), "label").unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        new = settled(new)
        if new.join(labels, ["node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the strongly connected component, for components of two or more nodes and loops.

    Nodes without a way in or out are trimmed; then each node takes the smallest label that
    reaches it, and what reaches that label's own node with the same label is its component."""
    loops = edges.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    left = settled(edges.where("source <> target").select("source", "target").distinct())
    found = None
    while True:
        while True:  # trim
            n = left.count()
            left = settled(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            if left.count() == n:
                break
        if not n:
            break
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        labels = _propagated(settled(nodes.withColumn("label", F.col("node"))), left)
        a, b = labels.toDF("source", "ls"), labels.toDF("target", "lt")
        inside = settled(left.join(a, "source").join(b, "target").where("ls = lt").select("source", "target"))
        back = walk(inside.select(F.col("target").alias("source"), F.col("source").alias("target")), labels.where("node = label").select("node"), None).select("node")
        own = settled(labels.join(back, "node", "left_semi").select("node", F.col("label").alias("component")))
        found = own if found is None else settled(found.unionByName(own))
        left = settled(left.join(own.select(F.col("node").alias("source")), "source", "left_anti").join(own.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"))
    if found is None:
        return loops.distinct()
    sized = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(sized, "component", "left_semi").select("node", "component").union(loops.join(found, "node", "left_anti")).distinct()


def cycle_report(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, size, members, inner_edges) of each cycle."""
    c = components.withColumnRenamed("node", "source")
    inner = edges.select("source", "target").distinct().join(c, "source").join(components.toDF("target", "ct"), "target").where("component = ct").groupBy("component").agg(F.count("*").alias("inner_edges"))
    return components.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members")).join(inner, "component")


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """exports (file, symbol) that no import (from_file, file, symbol) names, with whether a '*' import makes that uncertain."""
    named = imports.where("symbol <> '*'").select("file", "symbol")
    star = imports.where("symbol = '*'").select("file").distinct().withColumn("uncertain", F.lit(True))
    return exports.join(named, ["file", "symbol"], "left_anti").join(star, "file", "left").select("file", "symbol", F.coalesce("uncertain", F.lit(False)).alias("uncertain"))


def resolve_refs(refs: DataFrame, exports: DataFrame, imports: DataFrame, reexports: DataFrame, depth: int = 8) -> DataFrame:
    """(ref_id, target_file, target_symbol, how): same file first, then imports, followed through re-exports (file, symbol → to_file) up to a depth."""
    here = exports.select(F.col("file").alias("caller_file"), F.col("symbol").alias("name"), F.lit(True).alias("own"))
    via = imports.select(F.col("from_file").alias("caller_file"), F.col("symbol").alias("name"), F.col("file").alias("at"))
    rows = refs.join(here, ["caller_file", "name"], "left").join(via, ["caller_file", "name"], "left")
    done = rows.where("own").select("ref_id", F.col("caller_file").alias("target_file"), F.col("name").alias("target_symbol"), F.lit("same_file").alias("how"))
    todo = rows.where("own is null and at is not null").select("ref_id", "at", "name")
    is_real = exports.select(F.col("file").alias("at"), F.col("symbol").alias("name"))
    hop = reexports.select(F.col("file").alias("at"), F.col("symbol").alias("name"), "to_file")
    for i in range(depth):
        real = todo.join(is_real, ["at", "name"], "left_semi")
        done = done.unionByName(real.select("ref_id", F.col("at").alias("target_file"), F.col("name").alias("target_symbol"), F.lit("import" if i == 0 else "reexport").alias("how")))
        todo = settled(todo.join(is_real, ["at", "name"], "left_anti").join(hop, ["at", "name"]).select("ref_id", F.col("to_file").alias("at"), "name").distinct())
        if todo.isEmpty():
            break
    return done


def type_matches(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, node): method references whose receiver type and name end exactly one candidate's scoped name."""
    c = refs.join(nodes.select("node", "short", "scoped"), F.col("method") == F.col("short"))
    c = c.where(F.col("receiver").isNotNull() & ((F.col("scoped") == F.concat_ws("::", "receiver", "method")) | F.col("scoped").endswith(F.concat(F.lit("::"), F.concat_ws("::", "receiver", "method")))))
    return c.withColumn("n", F.count("*").over(Window.partitionBy("ref_id"))).where("n = 1").select("ref_id", "node")


def name_matches(refs: DataFrame, nodes: DataFrame, least: float = 2.0) -> DataFrame:
    """(ref_id, node, score): method references by common words of scope and receiver, 1, and nearness of paths; the best from 2 on, unless tied."""
    c = refs.where(~F.col("method").isin(*DENIED)).join(nodes.select("node", "short", "scoped", F.col("path").alias("node_path"), F.col("lang").alias("node_lang")), (F.col("method") == F.col("short")) & (F.col("lang") == F.col("node_lang")))
    words = F.size(F.array_intersect(text.split_camel(F.coalesce("receiver", F.lit(""))), text.split_camel(F.col("scoped"))))
    c = c.withColumn("score", words + 1.0 + paths.proximity(F.col("path"), F.col("node_path")))
    best = c.where(F.col("score") >= least).withColumn("r", F.rank().over(Window.partitionBy("ref_id").orderBy(F.desc("score"))))
    return best.where("r = 1").withColumn("n", F.count("*").over(Window.partitionBy("ref_id"))).where("n = 1").select("ref_id", "node", "score")


def dispatch_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, node, provenance): by type first, then by name."""
    typed = type_matches(refs, nodes)
    named = name_matches(refs.join(typed, "ref_id", "left_anti"), nodes)
    return typed.withColumn("provenance", F.lit("type_match")).unionByName(named.select("ref_id", "node").withColumn("provenance", F.lit("name_match")))


def arguments_to_parameters(calls: DataFrame, functions_: DataFrame) -> DataFrame:
    """(call_id, argument, parameter, approximate): by position; what follows a spread argument is approximate."""
    a = calls.select("call_id", "callee", F.posexplode("arguments").alias("pos", "argument"), "arguments")
    p = functions_.select(F.col("name").alias("callee"), F.posexplode("parameters").alias("pos", "parameter"))
    spread = F.exists(F.slice("arguments", F.lit(1), F.col("pos") + 1), lambda x: x.startswith("..."))
    return a.withColumn("approximate", spread).join(p, ["callee", "pos"]).select("call_id", "argument", "parameter", "approximate")


def parameters(signature: Column) -> Column:
    """Parameter names of a signature without nested brackets: receivers, types and defaults go."""
    inner = F.regexp_extract(signature, r"\(([^()]*)\)", 1)
    names = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s*[:=].*$", ""), r"^(?:mut|const|let|final|\.\.\.|\*+|&)\s*", ""))
    return F.filter(names, lambda x: (x != "") & ~x.isin("self", "this", "cls"))


def dedup_sites(sites: DataFrame) -> DataFrame:
    """Call sites (file, line, target_file, target_symbol, ...), each once: of equal ones the smallest row."""
    key = ["file", "line", "target_file", "target_symbol"]
    rest = [c for c in sites.columns if c not in key]
    return sites.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*") if rest else sites.distinct()


def dispatched_names(refs: DataFrame) -> DataFrame:
    """(lang, names): the method names that references (lang, method) of a language dispatch, sorted."""
    return refs.select("lang", "method").distinct().groupBy("lang").agg(F.sort_array(F.collect_list("method")).alias("names"))


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, dep_file): the files that hold the targets of a file's calls."""
    return edges.select("file", "target").distinct().join(nodes.select(F.col("node").alias("target"), F.col("file").alias("dep_file")), "target").select("file", "dep_file").distinct()


def edge_snapshot(edges: DataFrame) -> DataFrame:
    """(source, target, sites): the distinct edges, with how many call sites each has."""
    return edges.groupBy("source", "target").agg(F.count_distinct("file", "line").alias("sites"))


def graph_counts(edges: DataFrame) -> DataFrame:
    """(edges, files, sources, targets), one row: edges and nodes counted once each."""
    return edges.agg(F.count_distinct("source", "target").alias("edges"), F.count_distinct("file").alias("files"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def trace_candidates(edges: DataFrame) -> DataFrame:
    """(target, file, line, n): where each file calls a target first, and how often."""
    return edges.groupBy("target", "file").agg(F.min("line").alias("line"), F.count("*").alias("n"))


def dead_tiers(dead: DataFrame, generated: Column, test_only: Column) -> DataFrame:
    """dead nodes with their tier: in generated files, used by tests alone, or worth a headline."""
    return dead.withColumn("tier", F.when(generated, "generated").when(test_only, "test_only").otherwise("headline"))


def fold_calls(calls: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, first position, extra): repeated calls of a name count as extras of the first."""
    return calls.groupBy(*keys, "name").agg(F.min("pos").alias("pos"), (F.count("*") - 1).alias("extra"))


def blast_radius(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, callers, first_files): direct call sites and the first two calling files."""
    sites = edges.select("target", "file", "line").distinct()
    return nodes.select(F.col("node").alias("target")).join(sites, "target", "left").groupBy("target").agg(F.count("file").alias("callers"), F.array_join(F.slice(F.sort_array(F.collect_set("file")), 1, 2), ",").alias("first_files"))


def liveness(exports: DataFrame, imports: DataFrame, reexports: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, symbol, verdict): used, uncertain or unused, for module facts reached from entry files.

    imports (from_file, file, symbol, kind): '*' and dynamic imports make a file uncertain; kind 'unused' is ignored."""
    live = imports.where("kind <> 'unused'")
    steps = live.select(F.col("from_file").alias("source"), F.col("file").alias("target")).unionByName(reexports.select(F.col("file").alias("source"), F.col("to_file").alias("target")))
    modules = settled(reachable(steps, entries.select(F.col("file").alias("node"))))
    live = live.join(modules.withColumnRenamed("node", "from_file"), "from_file", "left_semi")
    named = live.where("symbol <> '*' and kind <> 'dynamic'").select("file", "symbol").distinct()
    seen = settled(named)
    while True:
        new = settled(named.join(reexports, ["file", "symbol"]).select(F.col("to_file").alias("file"), "symbol").distinct().join(seen, ["file", "symbol"], "left_anti"))
        if new.isEmpty():
            break
        named, seen = new, settled(seen.unionByName(new))
    cloud = live.where("symbol = '*' or kind = 'dynamic'").select("file").distinct().withColumn("c", F.lit(True))
    rows = exports.join(seen.withColumn("u", F.lit(True)), ["file", "symbol"], "left").join(cloud, "file", "left").join(entries.select("file").distinct().withColumn("e", F.lit(True)), "file", "left")
    return rows.select("file", "symbol", F.when(F.col("u") | F.col("e"), "used").when(F.col("c"), "uncertain").otherwise("unused").alias("verdict"))
