"""Graph queries. A call edge joins the parts of consecutive lines of an order: the order is the file, the line number the line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph

from .registry import query, stored_table, table

PAIRS_SQL = """pairs AS (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target, a.l_orderkey AS file, a.l_linenumber::BIGINT AS line, a.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
cyc AS (SELECT * FROM pairs), hub AS (SELECT target AS node FROM cyc GROUP BY 1 ORDER BY count(DISTINCT source) DESC, 1 LIMIT 1), fan AS (SELECT source AS node FROM cyc GROUP BY 1 ORDER BY count(DISTINCT target) DESC, 1 LIMIT 1), acyc AS (SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target, file, line FROM pairs WHERE source <> target),
refs AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS ref_id, l_partkey AS caller_node, l_orderkey AS caller_file, l_linenumber::BIGINT AS line, 'p' || l_suppkey AS name FROM lineitem WHERE l_partkey = (SELECT max(l_partkey) FROM lineitem i WHERE i.l_orderkey = lineitem.l_orderkey AND i.l_linenumber = lineitem.l_linenumber)),
redges AS (SELECT ref_id, min(target) AS target FROM refs JOIN pairs ON source = caller_node AND file = caller_file AND pairs.line = refs.line GROUP BY 1)"""


def _pairs(spark, sf_dir):
    return stored_table(spark, sf_dir, "pairs", lambda: _paired(spark, sf_dir))


def _paired(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("q"))
    b = li.select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).cast("long").alias("line"))
    return a.join(b, ["file", "line"]).select("source", "target", "file", "line", "q").distinct()


def _cyclic(spark, sf_dir):
    return _pairs(spark, sf_dir).drop("q")


def _most(edges, end, other):
    """The node with the most distinct others."""
    return edges.groupBy(end).agg(F.count_distinct(other).alias("n")).orderBy(F.desc("n"), end).first()[0]


def _acyclic(spark, sf_dir):
    """All pairs, turned so that calls go to larger numbers."""
    return _pairs(spark, sf_dir).where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "file", "line").distinct()


def _refs(spark, sf_dir):
    return stored_table(spark, sf_dir, "refs", lambda: _referring(spark, sf_dir))


def _referring(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_partkey", "l_suppkey")).alias("m"), F.max("l_partkey").alias("p"))
    li = table(spark, sf_dir, "lineitem").join(rows.select("l_orderkey", "l_linenumber", F.col("p").alias("l_partkey")), ["l_orderkey", "l_linenumber", "l_partkey"])
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ref_id"), F.col("l_partkey").alias("caller_node"), F.col("l_orderkey").alias("caller_file"), F.col("l_linenumber").cast("long").alias("line"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("name")).distinct()


def _ref_edges(spark, sf_dir):
    return stored_table(spark, sf_dir, "ref_edges", lambda: _resolved(spark, sf_dir))


def _resolved(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(F.col("source").alias("caller_node"), F.col("file").alias("caller_file"), "line", "target").distinct()
    return _refs(spark, sf_dir).join(p, ["caller_node", "caller_file", "line"]).groupBy("ref_id").agg(F.min("target").alias("target"))


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), (F.col("p_partkey") % 50).alias("file"), F.col("p_brand").alias("brand"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("file")).distinct().where("file % 10 <> 3")


@query("WITH " + PAIRS_SQL + """, n AS (SELECT p_partkey AS node, p_name AS name FROM part WHERE p_partkey % 50 % 10 <> 3)
 SELECT source, a.name AS caller, target, b.name AS callee, file, line FROM cyc JOIN n a ON a.node = source LEFT JOIN n b ON b.node = target""")
def direct_callers(spark, sf_dir):
    return graph.direct_callers(_cyclic(spark, sf_dir), _nodes(spark, sf_dir), _files(spark, sf_dir))


@query("WITH " + PAIRS_SQL + " SELECT p_partkey AS target, count(DISTINCT (file, line)) FILTER (file IS NOT NULL) AS n FROM part LEFT JOIN pairs ON target = p_partkey GROUP BY 1")
def caller_counts(spark, sf_dir):
    return graph.caller_counts(_pairs(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")))


@query("WITH " + PAIRS_SQL + " SELECT ref_id, caller_node, line FROM refs WHERE NOT EXISTS (SELECT 1 FROM redges e WHERE e.ref_id = refs.ref_id)")
def unresolved_calls(spark, sf_dir):
    return graph.unresolved(_refs(spark, sf_dir), _ref_edges(spark, sf_dir)).select("ref_id", "caller_node", "line")


@query("WITH " + PAIRS_SQL + " SELECT ref_id, c.p_name AS caller, coalesce(t.p_name, name) AS target FROM refs LEFT JOIN part c ON c.p_partkey = caller_node LEFT JOIN redges USING (ref_id) LEFT JOIN part t ON t.p_partkey = redges.target")
def outbound_calls(spark, sf_dir):
    return graph.outbound_calls(_refs(spark, sf_dir), _ref_edges(spark, sf_dir), _nodes(spark, sf_dir))


@query("WITH " + PAIRS_SQL + " SELECT caller_node AS source, line, redges.target FROM refs LEFT JOIN redges USING (ref_id)")
def forward_calls(spark, sf_dir):
    return graph.forward_calls(_refs(spark, sf_dir), _ref_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source")))


@query("WITH " + PAIRS_SQL + """, dep AS (SELECT DISTINCT file, target % 50 AS dep_file FROM pairs) SELECT DISTINCT ref_id, caller_file FROM refs LEFT JOIN redges USING (ref_id) WHERE caller_file IN (SELECT file FROM dep WHERE dep_file = 7) OR redges.target % 50 = 7""")
def dependents(spark, sf_dir):
    dep = _pairs(spark, sf_dir).select("file", (F.col("target") % 50).alias("dep_file")).distinct()
    refs = _refs(spark, sf_dir).join(_ref_edges(spark, sf_dir), "ref_id", "left").withColumn("target_file", F.col("target") % 50)
    return graph.dependents(refs, dep, 7).select("ref_id", "caller_file")


@query("WITH RECURSIVE " + PAIRS_SQL + """, w AS (SELECT node, 0 AS depth FROM hub UNION SELECT source, depth + 1 FROM w JOIN cyc ON target = node WHERE depth < 4) SELECT node, min(depth)::INTEGER AS depth FROM w WHERE node <> (SELECT node FROM hub) GROUP BY 1""")
def callers_khop(spark, sf_dir):
    return graph.callers(_cyclic(spark, sf_dir), _most(_cyclic(spark, sf_dir), "target", "source"), 4)


@query("WITH RECURSIVE " + PAIRS_SQL + """, w AS (SELECT node, 0 AS depth FROM hub UNION SELECT source, depth + 1 FROM w JOIN cyc ON target = node WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
 SELECT DISTINCT file, cyc.line, source, target, m.depth::INTEGER AS depth, l_shipmode AS text FROM cyc JOIN m ON m.node = source AND m.depth > 0 JOIN m t ON t.node = target LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS l_shipmode FROM lineitem GROUP BY 1, 2) x ON l_orderkey = file AND l_linenumber = cyc.line""")
def impact(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("text"))
    return graph.impact(_cyclic(spark, sf_dir), _most(_cyclic(spark, sf_dir), "target", "source"), 3, lines)


@query("WITH RECURSIVE " + PAIRS_SQL + """, s AS (SELECT DISTINCT source, target FROM acyc), r AS (SELECT min(source) AS root FROM s),
 w AS (SELECT [root] AS path, 0 AS depth FROM r UNION ALL SELECT list_append(path, target), depth + 1 FROM w JOIN s ON source = path[-1] WHERE depth < 3 AND NOT list_contains(path, target))
 SELECT array_to_string(path, '>') AS path, depth::INTEGER AS depth, CASE WHEN depth = 3 THEN coalesce(n, 0) ELSE 0 END AS hidden, false AS truncated FROM w LEFT JOIN (SELECT source AS e, count(*) AS n FROM s GROUP BY 1) ON e = path[-1]""")
def call_tree(spark, sf_dir):
    e = _acyclic(spark, sf_dir)
    root = e.agg(F.min("source")).first()[0]
    return graph.call_tree(e, root, 3).select(F.array_join("path", ">").alias("path"), "depth", F.col("hidden").cast("long").alias("hidden"), "truncated")


@query("WITH RECURSIVE " + PAIRS_SQL + """, s AS (SELECT DISTINCT source, target FROM acyc), w AS (SELECT [(SELECT min(source) FROM s)] AS path, 0 AS depth UNION ALL SELECT list_append(path, target), depth + 1 FROM w JOIN s ON source = path[-1] WHERE depth < 1)
 SELECT array_to_string(path, '>') AS path, depth::INTEGER AS depth, (SELECT count(*) FROM w WHERE depth = 1) > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY path) AS nth FROM w) WHERE nth <= 5""")
def call_tree_within_budget(spark, sf_dir):
    """Of a level only the five smallest paths, and a flag that there were more."""
    e = _acyclic(spark, sf_dir)
    return graph.call_tree(e, e.agg(F.min("source")).first()[0], 1, budget=5).select(F.array_join("path", ">").alias("path"), "depth", "truncated")


@query("WITH RECURSIVE " + PAIRS_SQL + """, s AS (SELECT DISTINCT source, target FROM acyc), r AS (SELECT max(target) AS root FROM s),
 w AS (SELECT [root] AS path, 0 AS depth FROM r UNION ALL SELECT list_prepend(source, path), depth + 1 FROM w JOIN s ON target = path[1] WHERE depth < 3 AND NOT list_contains(path, source))
 SELECT array_to_string(path, '>') AS path, depth::INTEGER AS depth, false AS truncated FROM w WHERE depth > 0 AND path[1] % 10 = 3""")
def trace_paths(spark, sf_dir):
    e = _acyclic(spark, sf_dir)
    root = e.agg(F.max("target")).first()[0]
    entries = e.select(F.col("source").alias("node")).distinct().where("node % 10 = 3")
    return graph.trace_paths(e, root, entries, 3).select(F.array_join("path", ">").alias("path"), "depth", "truncated")


@query("WITH RECURSIVE " + PAIRS_SQL + """, s AS (SELECT DISTINCT source, target FROM cyc), l AS (SELECT node, 0 AS depth FROM fan UNION SELECT target, depth + 1 FROM l JOIN s ON source = node WHERE depth < 6), m AS (SELECT node, min(depth) AS depth FROM l GROUP BY 1),
 e AS (SELECT max(depth) AS d, arg_max(node, (depth, node)) AS b FROM m), w AS (SELECT [node] AS path, 0 AS depth FROM fan UNION ALL SELECT list_append(path, target), w.depth + 1 FROM w JOIN s ON source = path[-1] JOIN m ON m.node = target AND m.depth = w.depth + 1, e WHERE w.depth < d)
 SELECT array_to_string(min(path), '>') AS path, any_value(d)::INTEGER AS depth FROM w, e WHERE path[-1] = b AND depth = d""")
def shortest_path(spark, sf_dir):
    """From the node that calls most others to the one that is farthest from it, of several the largest."""
    e = _cyclic(spark, sf_dir)
    fan = _most(e, "source", "target")
    far = graph.callers(e.select(F.col("target").alias("source"), F.col("source").alias("target")), fan, 6).agg(F.max(F.struct("depth", "node")).alias("m")).first().m
    return graph.shortest_path(e, fan, far.node).select(F.array_join("path", ">").alias("path"), "depth")


@query("WITH RECURSIVE " + PAIRS_SQL + """, w AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 97 = 0 UNION SELECT target FROM w JOIN acyc ON source = node) SELECT p_partkey AS node, p_brand AS brand FROM part WHERE p_partkey NOT IN (SELECT node FROM w)""")
def dead_nodes(spark, sf_dir):
    roots = table(spark, sf_dir, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"))
    return graph.dead_nodes(_nodes(spark, sf_dir), _acyclic(spark, sf_dir), roots).select("node", "brand")


DEAD_SQL = "WITH RECURSIVE " + PAIRS_SQL + """, w AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 97 = 0 UNION SELECT target FROM w JOIN acyc ON source = node),
 d AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'generated' WHEN p_partkey % 7 = 0 THEN 'test_only' ELSE 'headline' END AS tier FROM part WHERE p_partkey NOT IN (SELECT node FROM w)) SELECT tier, p_brand AS brand, count(*) AS n FROM d GROUP BY 1, 2"""


@query(DEAD_SQL)
def dead_code_tiers(spark, sf_dir):
    roots = table(spark, sf_dir, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"))
    dead = graph.dead_nodes(_nodes(spark, sf_dir), _acyclic(spark, sf_dir), roots)
    return graph.dead_tiers(dead, F.col("node") % 11 == 0, F.col("node") % 7 == 0).groupBy("tier", "brand").agg(F.count("*").alias("n"))


#: What the hub reaches and is reached by is its component; the closure of the (few) other nodes gives theirs.
SCC_SQL = PAIRS_SQL + """, s AS (SELECT DISTINCT source, target FROM cyc), f AS (SELECT node FROM hub UNION SELECT target FROM f JOIN s ON source = node), g AS (SELECT node FROM hub UNION SELECT source FROM g JOIN s ON target = node), big AS (SELECT node FROM f WHERE node IN (SELECT node FROM g)),
 o AS (SELECT source, target FROM s WHERE source NOT IN (SELECT node FROM big) AND target NOT IN (SELECT node FROM big)), w AS (SELECT source AS a, target AS b FROM o UNION SELECT a, target FROM w JOIN o ON source = b),
 c AS (SELECT x.a AS node, least(min(x.b), x.a) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY x.a UNION ALL SELECT node, (SELECT min(node) FROM big) FROM big WHERE (SELECT count(*) FROM big) > 1 OR node IN (SELECT source FROM s WHERE source = target))"""


@query("WITH RECURSIVE " + SCC_SQL + " SELECT node, component FROM c")
def scc(spark, sf_dir):
    return graph.strong_components(_cyclic(spark, sf_dir))


@query("WITH RECURSIVE " + SCC_SQL + """ SELECT component, count(*) AS size, array_to_string(list_sort(list(node)), ',') AS members, (SELECT count(*) FROM s JOIN c a ON a.node = source JOIN c b ON b.node = target WHERE a.component = b.component AND a.component = c.component) AS inner_edges FROM c GROUP BY 1""")
def cycle_report(spark, sf_dir):
    e = _cyclic(spark, sf_dir)
    return graph.cycle_report(e, graph.strong_components(e)).withColumn("members", F.array_join("members", ","))


@query("WITH " + PAIRS_SQL + """ SELECT p_partkey AS target, count(DISTINCT (file, line)) FILTER (file IS NOT NULL) AS callers, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(file::VARCHAR) FILTER (file IS NOT NULL))), 1, 2), ','), '') AS first_files FROM part LEFT JOIN pairs ON target = p_partkey GROUP BY 1""")
def blast_radius(spark, sf_dir):
    return graph.blast_radius(_pairs(spark, sf_dir).withColumn("file", F.col("file").cast("string")), _nodes(spark, sf_dir))


@query("WITH " + PAIRS_SQL + """, n AS (SELECT DISTINCT target, source, count(*) OVER (PARTITION BY target) AS n FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS nth FROM n) SELECT target, source, n FROM r WHERE n <= 20 OR nth <= 15""")
def hub_summary(spark, sf_dir):
    return graph.hub_summary(_pairs(spark, sf_dir).select("target", "source"), "source")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS file, 's' || o_orderkey % 200 AS symbol FROM orders), i AS (SELECT DISTINCT l_suppkey % 100 AS file, CASE WHEN l_quantity = 50 AND l_suppkey < 5 THEN '*' ELSE 's' || l_orderkey % 200 END AS symbol FROM lineitem)
 SELECT file, symbol, file IN (SELECT file FROM i WHERE symbol = '*') AS uncertain FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.file = e.file AND i.symbol = e.symbol AND i.symbol <> '*')""")
def unused_exports(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.concat(F.lit("s"), (F.col("o_orderkey") % 200).cast("string")).alias("symbol")).distinct()
    sym = F.when((F.col("l_quantity") == 50) & (F.col("l_suppkey") < 5), "*").otherwise(F.concat(F.lit("s"), (F.col("l_orderkey") % 200).cast("string")))
    i = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("file"), sym.alias("symbol")).distinct()
    return graph.unused_exports(e, i)


@query("""SELECT l_orderkey AS file, 'n' || l_suppkey % 5 AS name, min(l_linenumber)::BIGINT AS pos, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2""")
def fold_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("n"), (F.col("l_suppkey") % 5).cast("string")).alias("name"), F.col("l_linenumber").cast("long").alias("pos"))
    return graph.fold_calls(rows, "file")


@query("WITH " + PAIRS_SQL + " SELECT DISTINCT pairs.file, p_partkey % 50 AS dep_file FROM pairs JOIN part ON p_partkey = target")
def file_dependencies(spark, sf_dir):
    return graph.file_dependencies(_pairs(spark, sf_dir), _nodes(spark, sf_dir))


@query("WITH " + PAIRS_SQL + " SELECT target, file, min(line) AS line, count(*) AS n FROM (SELECT DISTINCT source, target, file, line FROM pairs) GROUP BY 1, 2")
def trace_candidates(spark, sf_dir):
    return graph.trace_candidates(_cyclic(spark, sf_dir).distinct())


@query("WITH " + PAIRS_SQL + " SELECT source, target, count(DISTINCT (file, line)) AS sites FROM pairs GROUP BY 1, 2")
def edge_snapshot(spark, sf_dir):
    return graph.edge_snapshot(_pairs(spark, sf_dir))


@query("WITH " + PAIRS_SQL + " SELECT count(DISTINCT (source, target)) AS edges, count(DISTINCT file) AS files, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM pairs")
def graph_counts(spark, sf_dir):
    return graph.graph_counts(_pairs(spark, sf_dir))


@query("SELECT l_orderkey AS file, l_suppkey % 7 AS line, l_partkey % 5 AS target_file, 's' || l_partkey % 3 AS target_symbol, min(l_linenumber)::BIGINT AS nth FROM lineitem GROUP BY 1, 2, 3, 4")
def dedup_call_sites(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 7).alias("line"), (F.col("l_partkey") % 5).alias("target_file"), F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string")).alias("target_symbol"), F.col("l_linenumber").cast("long").alias("nth"))
    return graph.dedup_sites(rows)


@query("SELECT l_shipmode AS lang, array_to_string(list_sort(list_distinct(list('m' || l_suppkey % 30))), ',') AS names FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_suppkey FROM lineitem) GROUP BY 1")
def dispatched_names(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("lang"), F.concat(F.lit("m"), (F.col("l_suppkey") % 30).cast("string")).alias("method"))
    return graph.dispatched_names(rows).withColumn("names", F.array_join("names", ","))
