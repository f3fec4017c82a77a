"""Event sums, sets, freshness, windows, streams, sources and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import convert, events, graph, inspect, iterate, search
from tessera.sources import files as fsrc
from tessera.sources import html
from tessera.streaming import watch

from .registry import FILES_SQL, LINES_SQL, documents, files, query, table

EV_SQL = "ev AS (SELECT event_id AS id, user_id % 10 AS project, user_id AS session, event_type AS tool, (value * 10)::BIGINT AS original, (value * 3)::BIGINT + event_id % 5 AS compressed FROM events)"


def _events(spark, sf_dir):
    scaled = lambda x: F.round(F.col("value") * x).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("project"), F.col("user_id").alias("session"), F.col("event_type").alias("tool"), scaled(10).alias("original"), (scaled(3) + F.col("event_id") % 5).alias("compressed"))


SAVE_SQL = EV_SQL.replace("(value * 10)::BIGINT", "round(value * 10)::BIGINT").replace("(value * 3)::BIGINT", "round(value * 3)::BIGINT")


@query("WITH " + SAVE_SQL + " SELECT project, count(*) AS events, sum(original)::BIGINT AS original, sum(compressed)::BIGINT AS compressed, greatest(sum(original) - sum(compressed), 0)::BIGINT AS saved FROM ev GROUP BY 1")
def token_savings(spark, sf_dir):
    return events.savings(_events(spark, sf_dir), "project")


@query("WITH " + SAVE_SQL + " SELECT project, session, count(*) AS events, sum(original)::BIGINT AS original, sum(compressed)::BIGINT AS compressed, greatest(sum(original) - sum(compressed), 0)::BIGINT AS saved FROM ev GROUP BY 1, 2")
def token_savings_by_session(spark, sf_dir):
    return events.savings(_events(spark, sf_dir), "project", "session")


@query("SELECT max(event_id) AS watermark FROM events")
def event_watermark(spark, sf_dir):
    return events.watermark(_events(spark, sf_dir))


@query("WITH " + SAVE_SQL + " SELECT project, count(*) AS events, sum(original)::BIGINT AS original, sum(compressed)::BIGINT AS compressed, greatest(sum(original) - sum(compressed), 0)::BIGINT AS saved, max(id) AS watermark FROM ev GROUP BY 1")
def incremental_savings(spark, sf_dir):
    e = _events(spark, sf_dir)
    old = e.where("id < 4000")
    cached = events.savings(old, "project").join(old.groupBy("project").agg(F.max("id").alias("watermark")), "project")
    return events.advance(cached, e.where("id >= 3000"), "project")


@query("SELECT event_id AS id, user_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CASE WHEN value > 50 THEN NULL ELSE props END ORDER BY event_id) AS n FROM events) WHERE n = 1")
def identity_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "props", F.when(F.col("value") <= 50, F.col("props")).alias("p"))
    return events.identity_dedup(rows, [F.col("user_id"), F.col("event_type"), F.col("p")]).drop("p")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return events.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), "event_id", "user_id", "event_type")


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 50 = 0")
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    changes = base.where("k % 3 = 0").select("k", F.lit("new").alias("v")).union(base.where("k % 50 = 0").select(-F.col("k") - 1, F.lit("new")))
    return events.upsert(base, changes, "k")


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 50 = 0")
def insert_new(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    changes = base.where("k % 3 = 0").select("k", F.lit("new").alias("v")).union(base.where("k % 50 = 0").select(-F.col("k") - 1, F.lit("new")))
    return events.insert_new(base, changes, "k")


@query("""SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN o_orderkey % 13 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'content_fresh' WHEN o_orderkey % 7 = 0 THEN 'stale' ELSE 'hot' END AS verdict FROM orders""")
def freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(1).alias("mtime"), F.col("o_custkey").alias("size"), F.lit("h").alias("hash"), F.col("o_orderkey").alias("k"))
    touched, changed = (F.col("k") % 5 == 0), (F.col("k") % 7 == 0) & (F.col("k") % 5 != 0)
    now = o.where("k % 11 <> 0").withColumn("mtime", F.when(touched | changed, 2).otherwise(1)).withColumn("hash", F.when(changed, "g").otherwise("h"))
    return events.freshness(o.where("k % 13 <> 0 or k % 11 = 0").drop("k"), now.drop("k"))


@query("SELECT o_custkey::VARCHAR AS path, o_orderkey AS version, o_orderstatus AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 20")
def undo_history(spark, sf_dir):
    return events.history(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state")))


@query("SELECT o_custkey::VARCHAR AS path, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS state FROM orders WHERE o_orderkey <= 5000 GROUP BY 1")
def checkpoint_restore(spark, sf_dir):
    return events.as_of(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state")), 5000)


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, CASE WHEN count(*) >= 5000 OR sum(n_chars) >= 134217728 THEN 'hard' WHEN count(*) >= 1000 OR sum(n_chars) >= 33554432 THEN 'soft' ELSE 'none' END AS due FROM documents")
def compaction_due(spark, sf_dir):
    return events.compaction_due(documents(spark, sf_dir).select(F.col("n_chars").alias("size")))


@query("WITH c AS (SELECT doc_id, md5(text) AS hash FROM documents) SELECT count(*) FILTER (hash IN (SELECT hash FROM c WHERE doc_id % 4 = 0)) AS reused, count(*) FILTER (hash NOT IN (SELECT hash FROM c WHERE doc_id % 4 = 0)) AS fresh FROM c")
def semantic_refresh(spark, sf_dir):
    c = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("hash"))
    reused, fresh = events.to_embed(c, c.where("doc_id % 4 = 0").withColumn("vector", F.array(F.lit(0.0))))
    return reused.agg(F.count("*").alias("reused")).crossJoin(fresh.agg(F.count("*").alias("fresh")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return watch.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def sessions(spark, sf_dir):
    return watch.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query()
def pattern_watch(spark, sf_dir):
    """Conversations as streams of text, a turn at a time."""
    path = f"{sf_dir}/conversations.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", "1").option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else path + "*")
    rows = stream.select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("chunk"))
    out = watch.watch(rows, [("the", r"\bthe [a-z]+ing\b", False, False), ("first", "and", True, True)])
    return watch.run_all(out, iterate.temporary(spark, "watch"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1)
 SELECT user_id AS task_id, ts, epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS seconds FROM s, n WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL) AND ts <= now - INTERVAL 30 SECOND""")
def overdue_tasks(spark, sf_dir):
    """Users are tasks, an error ends one, and it is the time of the last event."""
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    own = e.where("event_type <> 'error'").select(F.col("user_id").alias("task_id"), "ts")
    return watch.overdue(own, e.where("event_type = 'error'").select(F.col("user_id").alias("task_id")), now).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT 'documents' AS subsystem, count(*) AS rows, sum(coalesce(strlen(text), 0) + 8)::BIGINT AS bytes FROM documents UNION ALL SELECT 'embeddings', count(*), sum(coalesce(len(embedding), 0) * 8 + 8)::BIGINT FROM embeddings UNION ALL SELECT 'conversations', count(*), sum(coalesce(strlen(text), 0) + coalesce(strlen(role), 0) + 16)::BIGINT FROM conversations")
def memory_estimates(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return inspect.memory_estimates(documents=t("documents").select("doc_id", "text"), embeddings=t("embeddings").select("vec_id", "embedding"), conversations=t("conversations").select("conv_id", "turn", "role", "text"))


@query("""WITH c AS (SELECT l_orderkey % 30 AS file, l_partkey AS source, l_suppkey AS target FROM lineitem), dep AS (SELECT DISTINCT file, target % 30 AS dep_file FROM c WHERE source % 97 = 0),
 stale AS (SELECT 3 AS file UNION SELECT 4 UNION SELECT file FROM dep WHERE dep_file = 3) SELECT file, count(*) AS n, sum(CASE WHEN file IN (SELECT file FROM stale) THEN source + 1 ELSE source END)::BIGINT AS s FROM c GROUP BY 1""")
def incremental_refresh(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 30).alias("file"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    dep = c.where("source % 97 = 0").select("file", (F.col("target") % 30).alias("dep_file")).distinct()
    changed = spark.createDataFrame([(3, True), (4, False)], "file long, surface_changed boolean")
    return watch.refresh_graph(c, dep, changed, c.withColumn("source", F.col("source") + 1)).groupBy("file").agg(F.count("*").alias("n"), F.sum("source").alias("s"))


@query()
def html_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("markdown"))


@query(r"""WITH h AS (SELECT page_id, '# ' || page_id || ' Title' || chr(10) || 'x' || chr(10) || '## Été & more' || chr(10) || '### a-b' AS text FROM pages), l AS (SELECT page_id, unnest(range(1, 5))::BIGINT AS line, unnest(string_split(text, chr(10))) AS t FROM h)
SELECT page_id, line, length(regexp_extract(t, '^#+'))::BIGINT AS level, regexp_replace(t, '^#+ +', '') AS title, regexp_replace(regexp_replace(lower(regexp_replace(t, '^#+ +', '')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM l WHERE t LIKE '#%'""")
def headings(spark, sf_dir):
    body = F.concat(F.lit("# "), F.col("page_id").cast("string"), F.lit(" Title\nx\n## Été & more\n### a-b"))
    return convert.headings(table(spark, sf_dir, "pages").select("page_id", body.alias("text")), "page_id")


@query("""WITH l AS (SELECT page_id, [1 + page_id % 3, 1 + page_id // 3 % 4, 1 + page_id // 12 % 3, 1 + page_id // 36 % 4] AS v FROM pages), h AS (SELECT page_id, unnest([1, 2, 4, 5])::BIGINT AS line, unnest(v)::BIGINT AS level, unnest(['a', 'b', 'c', 'd']) || page_id AS title FROM l)
 SELECT *, coalesce((SELECT max(p.line) FROM h p WHERE p.page_id = h.page_id AND p.line < h.line AND p.level < h.level), 0) AS parent FROM h""")
def outline(spark, sf_dir):
    """Headings of levels that the page's number gives."""
    n = F.col("page_id")
    mark = lambda level, title: F.concat(F.call_function("repeat", F.lit("#"), (level + 1).cast("int")), F.lit(f" {title}"), n.cast("string"))
    third = lambda x: F.floor(n / x)
    body = F.concat_ws("\n", mark(n % 3, "a"), mark(third(3) % 4, "b"), F.lit("text #"), mark(third(12) % 3, "c"), mark(third(36) % 4, "d"))
    return convert.outline(convert.headings(table(spark, sf_dir, "pages").select("page_id", body.alias("text")), "page_id"), "page_id")


@query("WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN text WHEN len(x) = 1 THEN 'A' ELSE array_to_string(list_concat(['A', 'B' || doc_id], x[3:]), chr(10)) END AS text, doc_id % 10 <> 0 AS applied FROM l")
def apply_patch(spark, sf_dir):
    """The first two lines of every document; of every tenth the second hunk fits nowhere."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    x = d.select("path", F.split("text", "\n").alias("x"))
    first = x.select("path", F.lit(1).alias("nth"), F.get("x", F.lit(0)).alias("old"), F.lit("A").alias("new"))
    second = x.where("size(x) > 1 or path % 10 = 0").select("path", F.lit(2), F.when(F.col("path") % 10 == 0, "no such line in any text").otherwise(F.get("x", F.lit(1))), F.concat(F.lit("B"), F.col("path").cast("string")))
    return convert.apply_patch(d, first.union(second))


@query("WITH " + FILES_SQL + """ SELECT path, lang, size, length(text) - length(replace(text, chr(10), '')) AS breaks FROM files ORDER BY path""")
def outline_files(spark, sf_dir):
    return convert.outline_files(files(spark, sf_dir)).orderBy("path")


@query("WITH " + LINES_SQL + " SELECT doc_id, line, substr(line_text, 1, 80) AS text FROM lines WHERE line BETWEEN 2 AND 6")
def read_slice(spark, sf_dir):
    return fsrc.read_slice(documents(spark, sf_dir).withColumn("path", F.col("doc_id")), 2, 6, 80).withColumnRenamed("path", "doc_id")


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 60) || chr(10) || '[...]' || chr(10) || right(text, 40) END AS text FROM documents")
def head_tail(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.head_tail(F.col("text"), 200, 60, 40).alias("text"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'))::BIGINT AS tokens FROM documents""")
def token_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.count_pretokens(F.col("text")).alias("tokens"))


NAMES = ("parseHTTPResponse2", "snake_case_name", "A", "getX", "utf8Decode", "")


@query("""SELECT event_id, ['parse http response', 'snake case name', '', 'get', 'utf decode', ''][event_id % 6 + 1] AS words, props::VARCHAR LIKE '{%' AS is_json, CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'foo' ELSE 'T' END AS local, CASE event_id % 3 WHEN 0 THEN 'make' WHEN 1 THEN 'eslint' ELSE 'cargo' END AS program, 'a "b" - c...' AS plain FROM events""")
def scalar_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    return e.select(
        "event_id",
        F.array_join(tx.split_camel(pick(NAMES)), " ").alias("words"),
        tx.looks_json(F.col("props")).alias("is_json"),
        tx.specifier_local_name(pick(("a as b", "foo", "type T"))).alias("local"),
        tx.program_name(pick(("FOO=1 BAR=2 make all", "/x/.bin/eslint .", "cargo b"))).alias("program"),
        tx.normalize_unicode(F.lit("a “b” – c…")).alias("plain"),
    )


@query("WITH " + LINES_SQL + """ SELECT doc_id AS file, line, 0 AS pass FROM lines WHERE line_text = 'This work is licensed under the GNU General Public License, version 3.' UNION ALL SELECT doc_id, min(line), 1 FROM lines WHERE false GROUP BY 1""")
def fuzzy_find(spark, sf_dir):
    rows = search.line_table(documents(spark, sf_dir), "doc_id").withColumnRenamed("doc_id", "file")
    return convert.find_lines(rows, ["This work is licensed under the GNU General Public License, version 3."])


@query()
def nearest_miss(spark, sf_dir):
    rows = search.line_table(documents(spark, sf_dir), "doc_id").withColumnRenamed("doc_id", "file")
    return convert.nearest_miss(rows, ["The and attion to thanedble the, anea. Eriner thanea.", "And ornd."])


@query()
def diff_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    pairs = d.alias("a").join(d.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.col("a.doc_id").alias("doc_id"), convert.diff_counts(F.col("a.text"), F.col("b.text")).alias("d"))
    return pairs.select("doc_id", "d.added", "d.removed")


def _python(spark, sf_dir):
    """A module for each part: two of three have a class, names and arguments follow the number, one in 50 does not parse."""
    n = F.col("p_partkey")
    arg = F.concat(F.lit("a"), (n % 5).cast("string"))
    cls = F.concat(F.lit("class C"), n.cast("string"), F.lit(":\n    def run(self, "), arg, F.lit(", b=1):\n        return os.path.join("), arg, F.lit(", b)\n"))
    code = F.concat(F.lit("import os\n"), F.when(n % 3 != 0, cls).otherwise(""), F.lit("\ndef _f"), (n % 4).cast("string"), F.lit("():\n    return print(1)\n"), F.when(n % 50 == 7, "def (:\n").otherwise(""))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("text"))


@query("SELECT 'm' || p_partkey || '.py' AS path, s.name AS name, s.kind AS kind, s.a::BIGINT AS start_line, s.z::BIGINT AS end_line FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [{'name': '_f' || p_partkey % 4, 'kind': 'function', 'a': 3, 'z': 4}] ELSE [{'name': 'C' || p_partkey, 'kind': 'class', 'a': 2, 'z': 4}, {'name': 'run', 'kind': 'method', 'a': 3, 'z': 4}, {'name': '_f' || p_partkey % 4, 'kind': 'function', 'a': 6, 'z': 7}] END) AS s FROM part WHERE p_partkey % 50 <> 7)")
def symbols(spark, sf_dir):
    return convert.symbols(_python(spark, sf_dir)).select("path", "name", "kind", "start_line", "end_line")


@query()
def embedding_chunks(spark, sf_dir):
    f = _python(spark, sf_dir)
    c = convert.chunks(f, convert.symbols(f))
    return c.select("path", "name", "kind", convert.embed_text(F.col("path"), F.col("name"), F.col("kind"), F.coalesce("signature", F.lit("")), F.col("body")).alias("text"))


@query("SELECT 'm' || p_partkey || '.py' AS path, 3::BIGINT + i AS line, ['    def run(self, a' || p_partkey % 5 || ', b=1):', '        return os.path.join(a' || p_partkey % 5 || ', b)'][i + 1] AS text FROM part, range(2) t(i) WHERE p_partkey % 3 <> 0 AND p_partkey % 50 <> 7")
def zoom(spark, sf_dir):
    f = _python(spark, sf_dir)
    return convert.zoom(f, convert.symbols(f), "run").select("path", "line", "text")


@query("SELECT 'm' || p_partkey || '.py' AS path, 4::BIGINT AS line, 'os.path.join(a' || p_partkey % 5 || ', b)' AS code, 'a' || p_partkey % 5 AS first FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 50 <> 7")
def ast_search(spark, sf_dir):
    return convert.ast_search(_python(spark, sf_dir), "os.path.join($A, $$$R)").select("path", "line", "code", F.col("captures")["A"].alias("first"))


@query("SELECT 'm' || p_partkey || '.py' AS path, (p_partkey % 3 <> 0 AND p_partkey % 50 <> 7)::BIGINT AS n, p_partkey % 3 <> 0 AND p_partkey % 50 <> 7 AS changed FROM part")
def ast_replace(spark, sf_dir):
    return convert.ast_replace(_python(spark, sf_dir), "os.path.join($A, $$$R)", "($A / $$$R)").select("path", "n", F.col("text").rlike("return a[0-9] / b").alias("changed"))


@query("SELECT doc_id, CASE WHEN (length(text) - length(replace(text, 'GNU', ''))) = 3 THEN replace(text, 'GNU', 'X') ELSE text END AS text FROM documents")
def edit_match(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", convert.replace_exact(F.col("text"), "GNU", "X").alias("text"))


@query("SELECT 'p' || l_orderkey % 50 AS path, m.module AS module, 'n' || l_suppkey % 3 AS name, m.internal AS internal, m.grp::INTEGER AS grp FROM (SELECT DISTINCT l_orderkey % 50 AS l_orderkey, l_suppkey % 3 AS l_suppkey, [{'module': 'os.path', 'internal': false, 'grp': 0}, {'module': 'numpy', 'internal': false, 'grp': 1}, {'module': 'my.own', 'internal': true, 'grp': 2}][l_partkey % 3 + 1] AS m FROM lineitem)")
def organize_imports(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), (F.col("l_orderkey") % 50).cast("string")).alias("path"), pick(("os.path", "numpy", "my.own")).alias("module"), F.concat(F.lit("n"), (F.col("l_suppkey") % 3).cast("string")).alias("name"), (F.col("l_partkey") % 3 == 2).alias("internal"))
    return convert.organize_imports(rows)


@query("SELECT l_orderkey * 10 + l_linenumber AS call_id, unnest(['x', '...y', 'z']) AS argument, unnest(['a', 'b', 'c']) AS parameter, unnest([false, true, true]) AS approximate FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def argument_flow(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id")).distinct().withColumn("callee", F.lit("f")).withColumn("arguments", F.array(F.lit("x"), F.lit("...y"), F.lit("z")))
    f = spark.range(1).select(F.lit("f").alias("name"), graph.parameters(F.lit("fn f(self, a: int, mut b = 2, c)")).alias("parameters"))
    return graph.arguments_to_parameters(calls, f)


def _methods(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.lit("rust").alias("lang"), F.lit("a/b/x.rs").alias("path"), F.when(F.col("l_partkey") % 3 == 0, "HttpClient").when(F.col("l_partkey") % 3 == 1, "http_pool").alias("receiver"), F.when(F.col("l_suppkey") % 2 == 0, "send").otherwise("get").alias("method")).dropDuplicates(["ref_id"])
    nodes = spark.createDataFrame([(1, "send", "HttpClient::send", "a/b/y.rs", "rust"), (2, "send", "HttpPool::send", "c/d/z.rs", "rust"), (3, "get", "HttpPool::get", "c/d/z.rs", "rust")], "node long, short string, scoped string, path string, lang string")
    return refs, nodes


@query()
def method_dispatch(spark, sf_dir):
    return graph.dispatch_edges(*_methods(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 400 AS file, 's' || o_orderkey % 200 AS symbol FROM orders), i AS (SELECT DISTINCT l_orderkey % 400 AS f, (l_suppkey * 7 + l_linenumber) % 400 AS file, CASE WHEN l_partkey % 1999 = 0 THEN '*' ELSE 's' || l_partkey % 200 END AS symbol, CASE WHEN l_partkey % 5 = 0 THEN 'unused' ELSE 'named' END AS kind FROM lineitem),
 live AS (SELECT * FROM i WHERE kind <> 'unused'), r AS (SELECT 0::BIGINT AS file UNION SELECT live.file FROM r JOIN live ON live.f = r.file), l2 AS (SELECT * FROM live WHERE f IN (SELECT file FROM r))
 SELECT file, symbol, CASE WHEN EXISTS (SELECT 1 FROM l2 WHERE l2.file = e.file AND l2.symbol = e.symbol) OR file = 0 THEN 'used' WHEN EXISTS (SELECT 1 FROM l2 WHERE l2.file = e.file AND l2.symbol = '*') THEN 'uncertain' ELSE 'unused' END AS verdict FROM e""")
def liveness(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("file"), F.concat(F.lit("s"), (F.col("o_orderkey") % 200).cast("string")).alias("symbol")).distinct()
    i = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 400).alias("from_file"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 400).alias("file"), F.when(F.col("l_partkey") % 1999 == 0, "*").otherwise(F.concat(F.lit("s"), (F.col("l_partkey") % 200).cast("string"))).alias("symbol"), F.when(F.col("l_partkey") % 5 == 0, "unused").otherwise("named").alias("kind")).distinct()
    none = e.limit(0).withColumn("to_file", F.col("file"))
    return graph.liveness(e, i, none, spark.createDataFrame([(0,)], "file long"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_partkey % 3 = 0 THEN 'main' WHEN l_partkey % 3 = 1 THEN 'lib' ELSE 'deep' END AS target_file, ['here', 'there', 'far'][l_partkey % 3 + 1] AS target_symbol, ['same_file', 'import', 'reexport'][l_partkey % 3 + 1] AS how FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)""")
def ref_resolution(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.lit("main").alias("caller_file"), F.element_at(F.array(F.lit("here"), F.lit("there"), F.lit("far")), (F.col("p") % 3 + 1).cast("int")).alias("name"))
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    exports = frame([("main", "here"), ("lib", "there"), ("deep", "far")], "file string, symbol string")
    imports = frame([("main", "lib", "there"), ("main", "lib", "far")], "from_file string, file string, symbol string")
    reexports = frame([("lib", "far", "deep"), ("deep", "far", "lib")], "file string, symbol string, to_file string")
    return graph.resolve_refs(refs, exports, imports, reexports)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 = 1 THEN true WHEN p_size % 4 = 2 THEN p_size > 25 ELSE false END AS is_entry FROM part""")
def entry_points(spark, sf_dir):
    from tessera.functions import paths

    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", paths.is_entry_point(pick("Main", "test_x", "helper", "helper"), pick("variable", "function", "function", "method"), F.col("p_size") > 25, pick("go", "python", "rust", "python")).alias("is_entry"))
