"""Line-stream reduction and corpus inspections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import inspect, reduce, search

from .registry import FILES_SQL, LINES_SQL, documents, files, query, table

RUNS_SQL = """r0 AS (SELECT *, CASE WHEN line_text IS NOT DISTINCT FROM lag(line_text) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM r0), r2 AS (SELECT doc_id, run, min(line) AS pos, any_value(line_text) AS text, count(*) AS n FROM r1 GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    return search.line_table(documents(spark, sf_dir), "doc_id").select("doc_id", F.col("line").alias("pos"), F.col("line_text").alias("text"))


@query("WITH " + LINES_SQL + ", " + RUNS_SQL + """ SELECT doc_id, pos, CASE WHEN n >= 4 THEN text || chr(10) || '... (' || (n - 1) || ' more)' ELSE repeat(text || chr(10), n - 1) || text END AS text, n FROM r2""")
def dedup_runs(spark, sf_dir):
    return reduce.dedup_runs(_lines(spark, sf_dir), "doc_id")


def _blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cls = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "list").when(F.col("event_type") == "click", "warning")
    return e.select((F.col("user_id") % 50).alias("stream"), F.col("event_id").alias("pos"), cls.alias("cls"), F.concat_ws(" ", "event_type", "props").alias("text"))


BLOCKS_SQL = "b AS (SELECT user_id % 50 AS stream, event_id AS pos, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'list' WHEN 'click' THEN 'warning' END AS cls, event_type || ' ' || props AS text FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY stream, cls ORDER BY pos) AS nth, CASE cls WHEN 'warning' THEN 10 ELSE 20 END AS cap FROM b)"


@query("WITH " + BLOCKS_SQL + " SELECT stream, pos, cls, text FROM n WHERE cls IS NULL OR nth <= cap")
def class_cap(spark, sf_dir):
    return reduce.class_cap(_blocks(spark, sf_dir), "stream")


@query("WITH " + BLOCKS_SQL + " SELECT stream, cls, count(*) - any_value(cap) AS dropped FROM n WHERE cls IS NOT NULL GROUP BY stream, cls HAVING count(*) > any_value(cap)")
def class_drops(spark, sf_dir):
    return reduce.class_drops(_blocks(spark, sf_dir), "stream")


@query("WITH " + LINES_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
 SELECT 'head' AS keep, doc_id, line AS pos, line_text AS text FROM n WHERE n <= 10 OR nth <= 10 UNION ALL SELECT 'tail', doc_id, line, line_text FROM n WHERE n <= 10 OR nth > n - 10 UNION ALL SELECT 'middle', doc_id, line, line_text FROM n WHERE n <= 10 OR nth <= 5 OR nth > n - 5""")
def line_cap(spark, sf_dir):
    parts = [reduce.line_cap(_lines(spark, sf_dir), 10, k, "doc_id").withColumn("keep", F.lit(k)) for k in ("head", "tail", "middle")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(r"""WITH e AS (SELECT user_id % 20 AS stream, event_id AS pos, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS dir, 'part-' || (CASE WHEN event_id % 40 < 25 THEN event_id ELSE user_id END) || '.log' AS name FROM (SELECT * FROM events ORDER BY event_type)),
s AS (SELECT *, CASE WHEN dir = '' THEN '' ELSE dir || '|' END || regexp_replace(name, '[0-9]+', '#', 'g') AS shape, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS shown FROM e),
r0 AS (SELECT *, CASE WHEN shape = lag(shape) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY stream ORDER BY dir, pos)), r1 AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY dir, pos) AS run, row_number() OVER (PARTITION BY stream ORDER BY dir, pos) AS p FROM r0),
g AS (SELECT stream, run, min(p) AS p, count(*) AS n, arg_min(shown, p) AS a, arg_max(shown, p) AS z, any_value(dir) AS dir FROM r1 GROUP BY 1, 2)
SELECT stream, p AS pos, CASE WHEN dir = '' THEN '' ELSE dir || '/' END || 'part-*.log — ' || n || ' files (' || a || ' … ' || z || ')' AS line FROM g WHERE n >= 8 UNION ALL SELECT r1.stream, r1.p, shown FROM r1 JOIN g USING (stream, run) WHERE n < 8""")
def listing_fold(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 40 < 25, F.col("event_id")).otherwise(F.col("user_id"))
    rows = e.select((F.col("user_id") % 20).alias("stream"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("dir"), F.concat(F.lit("part-"), number.cast("string"), F.lit(".log")).alias("name"), "event_id")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("stream").orderBy("dir", "event_id")).cast("long")).drop("event_id")
    return reduce.listing_fold(rows, "stream")


@query("""SELECT event_id, 'x' || event_type || 'y' AS plain, CASE WHEN length(props) <= 9 THEN props ELSE substr(props, 1, 3) || '…' || right(props, 3) END AS short, CASE WHEN length(event_type || props) <= 12 THEN event_type || props ELSE substr(event_type || props, 1, 6) || chr(10) || '...<truncated ' || (length(event_type || props) - 9) || ' bytes>...' || chr(10) || right(event_type || props, 3) END AS middle FROM events""")
def scalar_truncation(spark, sf_dir):
    both = F.concat("event_type", "props")
    coloured = F.concat(F.lit("x\x1b[31;1m"), "event_type", F.lit("\x1b[0m\x1bMy"))
    return table(spark, sf_dir, "events").select("event_id", tx.strip_ansi(coloured).alias("plain"), tx.truncate_line(F.col("props"), 9).alias("short"), tx.middle_truncate(both, 12, 6, 3).alias("middle"))


def _outputs(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 60).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.concat_ws(" ", "event_type", "props", F.col("value").cast("string")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return e.withColumn("exit_code", (F.col("id") % 3).cast("int")).withColumn("command", F.when(F.col("id") % 4 == 0, "FOO=1 /usr/bin/event --all # x").when(F.col("id") % 4 == 1, "ls | wc").when(F.col("id") % 4 == 2, "df -h").otherwise("other"))


OUTPUT_SQL = """o AS (SELECT user_id % 60 AS id, event_id, event_type || ' ' || props AS t FROM events)"""


@query("WITH " + OUTPUT_SQL + """, k AS (SELECT *, CASE WHEN length(t) <= 20 THEN t ELSE substr(t, 1, 8) || '…' || right(t, 8) END AS s FROM o WHERE NOT starts_with(t, 'view')),
 n AS (SELECT *, row_number() OVER (PARTITION BY id, starts_with(t, 'click') ORDER BY event_id) AS nth FROM k) SELECT id, array_to_string(list(s ORDER BY event_id), chr(10)) AS text FROM n WHERE NOT starts_with(t, 'click') OR nth <= 20 GROUP BY 1""")
def filter_pipeline(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 60).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.concat_ws(" ", "event_type", "props").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    f = reduce.Filter("event", strip=(r"^view",), line_max=20, cls="list", cls_pattern=r"^click")
    return reduce.filtered(e.withColumn("exit_code", F.lit(0)), f)


@query()
def compress_outputs(spark, sf_dir):
    return reduce.compress(_outputs(spark, sf_dir))


#: Lines of every kind with counts of their own; the oracle takes zero counts away before it looks for words of failure.
SIGNALS = ("build failed", " failed", "no_failure here", "failover done", " failures, 2 passed", "failure in step", "tests failed: 3", "FAILED x", "Undefined: y", "all good", "found  failures", "a fail.")


@query("""WITH s AS (SELECT event_id, event_id % 12 AS k, event_id // 12 % 3 AS c FROM events), t AS (SELECT event_id, CASE WHEN k IN (1, 4) THEN c::VARCHAR ELSE '' END || ['build failed', ' failed', 'no_failure here', 'failover done', ' failures, 2 passed', 'failure in step', 'tests failed: 3', 'FAILED x', 'Undefined: y', 'all good', 'found ' || c || ' failures', 'a fail.'][k + 1] AS line FROM s),
 u AS (SELECT *, regexp_replace(lower(line), '(^|[^0-9])0+ *(fail|failed|failure|failures)($|[^a-z0-9_])', '\\1\\3', 'g') AS plain FROM t)
 SELECT event_id, line, regexp_matches(plain, '(^|[^a-z0-9_])(fail|failed|failure|failures)($|[^a-z0-9_])') OR contains(line, 'FAIL') OR contains(lower(line), 'undefined:') AS fails FROM u""")
def failure_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).alias("k"), (F.floor(F.col("event_id") / 12) % 3).cast("string").alias("c"))
    body = F.replace(F.element_at(F.array(*map(F.lit, SIGNALS)), (F.col("k") + 1).cast("int")), F.lit("found "), F.concat(F.lit("found "), F.col("c")))
    line = F.concat(F.when(F.col("k").isin(1, 4), F.col("c")).otherwise(""), body)
    return e.select("event_id", line.alias("line"), reduce.fails(line).alias("fails"))


@query("WITH " + LINES_SQL + """, f AS (SELECT doc_id, trim(line_text) AS t, min(line) AS line FROM lines WHERE regexp_matches(lower(line_text), '(^|[^a-z0-9_])(fail|failed|failure|failures)($|[^a-z0-9_])') OR contains(lower(line_text), 'error:') OR contains(lower(line_text), 'exception') OR contains(lower(line_text), 'traceback') OR contains(line_text, 'Error') OR contains(line_text, 'ERROR') OR contains(line_text, 'FAIL') OR contains(lower(line_text), 'panic') OR contains(lower(line_text), 'not found') OR contains(lower(line_text), 'no such') OR contains(lower(line_text), 'cannot find') GROUP BY 1, 2)
 SELECT doc_id, count(*) AS n FROM f WHERE t <> '' GROUP BY 1""")
def failure_lines(spark, sf_dir):
    lost = reduce.missing_failures(F.col("text"), F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.size(lost).cast("long").alias("n")).where("n > 0")


@query("""WITH l AS (SELECT event_id, event_type, ['// TODO(ann): fix', '# FIXME later', '-- HACK', 'x // BUG: y', 'noTODO here', 'url://TODO', '/* XXX */'][event_id % 7 + 1] AS line_text FROM events), m AS (SELECT event_type, regexp_extract(line_text, '(?:^|\\s)(?://+|#+|--|/\\*+|<!--|\\*)\\s*(TODO|FIXME|HACK|XXX|BUG)\\b', 1) AS marker FROM l)
 SELECT event_type, count(*) FILTER (marker = 'TODO') AS todo, count(*) FILTER (marker = 'FIXME') AS fixme, count(*) FILTER (marker = 'HACK') AS hack, count(*) FILTER (marker = 'XXX') AS xxx, count(*) FILTER (marker = 'BUG') AS bug, count(*) AS total FROM m WHERE marker <> '' GROUP BY 1""")
def marker_counts(spark, sf_dir):
    samples = F.array(*map(F.lit, ("// TODO(ann): fix", "# FIXME later", "-- HACK", "x // BUG: y", "noTODO here", "url://TODO", "/* XXX */")))
    rows = table(spark, sf_dir, "events").select("event_type", F.element_at(samples, (F.col("event_id") % 7 + 1).cast("int")).alias("line_text"))
    return inspect.marker_counts(inspect.marker_items(rows), "event_type")


@query("WITH " + FILES_SQL + """ SELECT lang, count(*) AS files, sum(size)::BIGINT AS bytes, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM files GROUP BY ROLLUP (lang)""")
def metrics_rollup(spark, sf_dir):
    return inspect.metrics(files(spark, sf_dir))


@query("WITH " + FILES_SQL + """ SELECT path, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM files ORDER BY loc DESC, path LIMIT 20""")
def largest_files(spark, sf_dir):
    return inspect.largest_files(files(spark, sf_dir))


FRAG_SQL = LINES_SQL + """, fr AS (SELECT doc_id AS file, line AS start, line + 2 AS "end", line_text || chr(10) || lead(line_text) OVER w || chr(10) || lead(line_text, 2) OVER w AS h FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
d AS (SELECT * FROM fr WHERE h IS NOT NULL AND h IN (SELECT h FROM fr WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) >= 2))"""


def _fragments(spark, sf_dir):
    return inspect.fragments(_lines(spark, sf_dir).select(F.col("doc_id").alias("file"), F.col("pos").alias("line"), F.col("text").alias("line_text")), 3)


def _shared(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    return f.join(inspect.duplicate_groups(f).select("hash"), "hash", "left_semi")


@query("WITH " + FRAG_SQL + """ SELECT count(*) AS n, min((file, start, "end")).file AS file, min((file, start, "end")).start AS start, min((file, start, "end"))."end" AS "end" FROM (SELECT h, {'file': file, 'start': start, 'end': "end"} AS s, file, start, "end" FROM d) GROUP BY h""".replace("min((file, start, \"end\"))", "min(s)"))
def duplicate_groups(spark, sf_dir):
    return inspect.duplicate_groups(_fragments(spark, sf_dir)).drop("hash")


@query("WITH " + FRAG_SQL + """, b AS (SELECT file, start, "end", max("end") OVER (PARTITION BY file ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d) SELECT file, start, "end" FROM b WHERE before IS NULL OR before < start""")
def maximal_spans(spark, sf_dir):
    return inspect.maximal(_shared(spark, sf_dir)).select("file", "start", "end")


@query("WITH " + FRAG_SQL + """, x AS (SELECT DISTINCT file, unnest(range(start, "end" + 1)) AS line FROM d), n AS (SELECT file, count(*) AS duplicated FROM x GROUP BY 1), t AS (SELECT doc_id AS file, count(*) AS total FROM lines GROUP BY 1)
 SELECT file, coalesce(duplicated, 0) AS duplicated, total, 100.0::DOUBLE * coalesce(duplicated, 0) / total AS percent FROM t LEFT JOIN n USING (file)""")
def duplicated_lines(spark, sf_dir):
    totals = _lines(spark, sf_dir).groupBy(F.col("doc_id").alias("file")).agg(F.count("*").alias("total"))
    return inspect.duplicated_lines(_shared(spark, sf_dir), totals)


CONF_SQL = "l AS (SELECT user_id % 40 AS file, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS line, CASE WHEN event_type = 'error' THEN '<<<<<<< a' WHEN event_type = 'click' THEN '>>>>>>> b' ELSE event_type END AS line_text FROM events)"
REG_SQL = CONF_SQL + """, m AS (SELECT *, max(CASE WHEN line_text LIKE '<<<%' THEN line END) OVER w AS o, max(CASE WHEN line_text LIKE '>>>%' THEN line END) OVER w AS c FROM l WINDOW w AS (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reg AS (SELECT file, o AS start, line AS "end" FROM m WHERE line_text LIKE '>>>%' AND o IS NOT NULL AND (c IS NULL OR c < o))"""


def _conflict_lines(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("file", F.col("user_id") % 40)
    body = F.when(F.col("event_type") == "error", "<<<<<<< a").when(F.col("event_type") == "click", ">>>>>>> b").otherwise(F.col("event_type"))
    return e.select("file", F.row_number().over(Window.partitionBy("file").orderBy("event_id")).cast("long").alias("line"), body.alias("line_text"))


@query("WITH " + REG_SQL + """ SELECT file, start, "end" FROM reg""")
def conflict_regions(spark, sf_dir):
    return inspect.conflict_regions(_conflict_lines(spark, sf_dir))


@query("WITH " + REG_SQL + """ SELECT DISTINCT l.file, l.line, l.line_text FROM l JOIN reg ON l.file = reg.file AND l.line BETWEEN start - 1 AND "end" + 1""")
def conflict_context(spark, sf_dir):
    rows = _conflict_lines(spark, sf_dir)
    return inspect.conflict_context(rows, inspect.conflict_regions(rows), 1)


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS hash, l_partkey % 4 AS file FROM lineitem), p AS (SELECT hash FROM g GROUP BY 1 HAVING list_sort(list(file)) IN ([0, 1], [2, 3])) SELECT DISTINCT hash FROM g WHERE hash NOT IN (SELECT hash FROM p)""")
def mirror_suppression(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), (F.col("l_partkey") % 4).alias("file")).distinct()
    return inspect.without_mirrors(g, spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"))


@query("""SELECT role, pos FROM (SELECT CASE event_type WHEN 'click' THEN 'product' WHEN 'view' THEN 'test' ELSE 'tooling' END AS role, event_id AS pos FROM events) ORDER BY CASE role WHEN 'product' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, pos LIMIT 100""")
def ranked_items(spark, sf_dir):
    role = F.when(F.col("event_type") == "click", "product").when(F.col("event_type") == "view", "test").otherwise("tooling")
    return inspect.ranked_items(table(spark, sf_dir, "events").select(role.alias("role"), F.col("event_id").alias("pos")))


@query("""WITH d AS (SELECT DISTINCT user_id AS file, event_id % 50 AS line, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, props AS message FROM events WHERE value < 90) SELECT file, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM d GROUP BY 1""")
def diagnostics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 50).alias("line"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"), F.col("props").alias("message"), F.lit("lsp").alias("source"), (F.col("value") >= 90).alias("stale"))
    return inspect.diagnostics(rows)
