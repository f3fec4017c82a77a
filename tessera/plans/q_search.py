"""Pattern search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grams, paths
from tessera.operators import search

from .registry import FILES_SQL, LINES_SQL, documents, files, index, query

GREP_SQL = "WITH " + LINES_SQL + r""" SELECT doc_id, line, position({text} IN {line})::BIGINT AS "column", line_text, {match} AS match_text FROM lines WHERE {hit}"""


@query("WITH " + LINES_SQL + """ SELECT doc_id, line, strpos(line_text, 'tion the')::BIGINT AS "column", line_text, 'tion the' AS match_text FROM lines WHERE contains(line_text, 'tion the')""")
def grep_literal(spark, sf_dir):
    return search.grep(documents(spark, sf_dir), "tion the", literal=True)


@query("WITH " + LINES_SQL + """ SELECT doc_id, line, strpos(line_text, regexp_extract(line_text, 'anth[a-z]+ing'))::BIGINT AS "column", line_text, regexp_extract(line_text, 'anth[a-z]+ing') AS match_text FROM lines WHERE regexp_matches(line_text, 'anth[a-z]+ing')""")
def grep_regex(spark, sf_dir):
    return search.grep(documents(spark, sf_dir), "anth[a-z]+ing")


@query("WITH " + LINES_SQL + """ SELECT doc_id, line, strpos(lower(line_text), 'license')::BIGINT AS "column", line_text, substr(line_text, strpos(lower(line_text), 'license'), 7) AS match_text FROM lines WHERE contains(lower(line_text), 'license')""")
def grep_ignore_case(spark, sf_dir):
    return search.grep(documents(spark, sf_dir), "LICENSE", literal=True, ignore_case=True)


@query("WITH " + LINES_SQL + """ SELECT doc_id, line, strpos(line_text, regexp_extract(line_text, '(?:License|Copyright)[ ,]'))::BIGINT AS "column", line_text, regexp_extract(line_text, '(?:License|Copyright)[ ,]') AS match_text FROM lines WHERE regexp_matches(line_text, '(?:License|Copyright)[ ,]')""")
def grep_indexed(spark, sf_dir):
    pattern = "(?:License|Copyright)[ ,]"
    stored, _ = index(spark, sf_dir, search.plan_trigrams(search.trigram_plan(pattern)))
    return search.grep(documents(spark, sf_dir), pattern, index=stored)


@query("WITH " + LINES_SQL + """, m AS (SELECT doc_id, line, strpos(line_text, 'the')::BIGINT AS "column", line_text, 'the' AS match_text, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM lines WHERE contains(line_text, 'the'))
 SELECT doc_id, line, "column", line_text, match_text, CASE WHEN n > 10 THEN n - 5 ELSE 0 END::BIGINT AS remaining FROM m WHERE n <= 10 OR nth <= 5""")
def grep_display_cap(spark, sf_dir):
    return search.display_cap(search.grep(documents(spark, sf_dir), "the", literal=True))


@query("WITH " + LINES_SQL + """ SELECT doc_id, line, strpos(line_text, 'der')::BIGINT AS "column", line_text, 'der' AS match_text FROM lines WHERE contains(line_text, 'der') ORDER BY doc_id, line LIMIT 100""")
def grep_capped(spark, sf_dir):
    return search.capped(search.grep(documents(spark, sf_dir), "der", literal=True))


@query("WITH " + LINES_SQL + """ SELECT DISTINCT doc_id, line, strpos(line_text, 'edoution')::BIGINT AS "column", line_text FROM lines WHERE contains(line_text, 'edoution')""")
def grep_multi_root(spark, sf_dir):
    docs = documents(spark, sf_dir)
    roots = [search.grep(docs.where(c), "edoution", literal=True) for c in (F.col("source") <= "src5", F.col("source") >= "src3", F.col("source").between("src0", "src9"))]
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return search.merge_roots(out).drop("match_text")


@query("WITH " + FILES_SQL + ", " + LINES_SQL + """, m AS (SELECT doc_id, line, strpos(line_text, 'http')::BIGINT AS "column" FROM lines WHERE contains(line_text, 'http'))
 SELECT m.*, path, mtime, row_number() OVER (ORDER BY mtime DESC, path, line, "column")::INTEGER AS pos FROM m JOIN files USING (doc_id) ORDER BY pos LIMIT 100""")
def grep_by_mtime(spark, sf_dir):
    from pyspark.sql import Window

    f = files(spark, sf_dir)
    top = search.by_mtime(search.grep(f, "http", literal=True).select("doc_id", "line", "column"), f).limit(100)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("mtime"), "path", "line", "column")))


@query("WITH " + FILES_SQL + """ SELECT path FROM files WHERE regexp_matches(path, '^src[0-9]*/(lib|tests)/f[^/]*\\.(ts|py)$') AND (path = 'src3' OR starts_with(path, 'src3/')) ORDER BY path LIMIT 100""")
def glob_path(spark, sf_dir):
    return search.glob(files(spark, sf_dir), "src*/{lib,tests}/f*.{ts,py}", root="src3")


@query("WITH " + FILES_SQL + """ SELECT regexp_replace(path, '/[^/]*$', '') AS dir, array_to_string(list_sort(list(regexp_extract(path, '[^/]*$'))), ',') AS names, count(*) AS n FROM files GROUP BY 1""")
def files_by_directory(spark, sf_dir):
    return search.by_directory(files(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query("WITH " + FILES_SQL + """ SELECT path, contains(path, '/tests/') AS is_test, contains(path, '/fixtures/') AS is_support, contains(path, '/generated/') AS is_generated,
 CASE regexp_extract(path, '[^.]*$') WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' ELSE 'markdown' END AS language FROM files""")
def path_classes(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", paths.is_test(p).alias("is_test"), paths.is_test_support(p).alias("is_support"), paths.is_generated(p, F.col("text")).alias("is_generated"), paths.language(p).alias("language"))


@query("""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
 SELECT dir, files, artifacts FROM (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, count(*) AS files, count(*) FILTER (regexp_matches(lower(path), '(\\.min\\.js|\\.min\\.css|\\.map|\\.html)$')) AS artifacts FROM p GROUP BY 1) WHERE artifacts >= 0.6 * files""")
def artifact_directories(spark, sf_dir):
    from .registry import table

    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return search.artifact_directories(table(spark, sf_dir, "pages").select(path.alias("path")))


@query("""WITH f AS (SELECT DISTINCT source AS path, true AS is_dir FROM documents UNION ALL SELECT DISTINCT source || '/lib' , true FROM documents UNION ALL SELECT source || '/lib/f' || doc_id, false FROM documents)
 SELECT DISTINCT path, is_dir FROM f WHERE NOT is_dir OR NOT contains(path, '/')""")
def nested_roots(spark, sf_dir):
    d = documents(spark, sf_dir)
    rows = d.select(F.col("source").alias("path"), F.lit(True).alias("is_dir"))
    rows = rows.union(d.select(F.concat("source", F.lit("/lib")), F.lit(True))).union(d.select(F.concat("source", F.lit("/lib/f"), F.col("doc_id").cast("string")), F.lit(False)))
    return search.nested_roots(rows)


@query("""WITH t AS (SELECT DISTINCT doc_id, translate(substr(text, i, 3), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents))
 SELECT g AS trigram, count(*)::BIGINT AS postings, min(doc_id) AS first_doc FROM t GROUP BY 1""")
def trigram_index(spark, sf_dir):
    """The stored index, read back whole."""
    rows = index(spark, sf_dir)[0].groupBy("trigram").agg(F.count("*").alias("postings"), F.min("doc_id").alias("first_doc"))
    return rows.withColumn("trigram", grams.shown(F.col("trigram")))


@query("""WITH c AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'license'))
 SELECT doc_id FROM c WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id + 1000000000 FROM c WHERE doc_id % 10 = 3""")
def index_snapshot(spark, sf_dir):
    """The base without superseded documents, and a delta under new ids; candidates verified by the text."""
    d = documents(spark, sf_dir)
    gone = d.where("doc_id % 10 = 3").select("doc_id")
    delta = d.where("doc_id % 10 = 3").withColumn("doc_id", F.col("doc_id") + 1000000000)
    whole = search.snapshot(search.postings(d), search.postings(delta), gone)
    found = search.candidates(whole, search.trigram_plan("license", literal=True))
    return found.join(d.unionByName(delta).where(search.predicate(F.col("text"), "license", True, True)), "doc_id", "left_semi")
