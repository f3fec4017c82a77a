"""Ranking, fusion, query shapes and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import shape, text
from tessera.operators import evalmetrics, ranking

from .registry import documents, index, query, table

LICENSE = ["lic", "ice", "cen", "ens", "nse"]
GRAMS_SQL = """g AS (SELECT DISTINCT doc_id, translate(substr(text, i, 3), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents)),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (t IN ('lic', 'ice', 'cen', 'ens', 'nse')) AS hits FROM g GROUP BY 1)"""
COS_SQL = """q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
c AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding::DOUBLE[], e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(e, lambda x: x * x)))) AS score FROM embeddings, q)"""
LEX_SQL = GRAMS_SQL + """, r AS (SELECT t FROM (SELECT t, count(*) AS c FROM g WHERE t IN ('lic', 'ice', 'cen', 'ens', 'nse') GROUP BY 1) ORDER BY c, t LIMIT 3),
cand AS (SELECT DISTINCT doc_id FROM g WHERE t IN (SELECT t FROM r) ORDER BY doc_id LIMIT 200),
lex AS (SELECT doc_id, hits / (1 + ln(n)) AS score FROM cand JOIN n USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50)"""


@query("WITH " + GRAMS_SQL + " SELECT d.doc_id, coalesce(hits, 0)::BIGINT AS hits, round(coalesce(hits / (1 + ln(n)), 0), 6) AS score FROM documents d LEFT JOIN n USING (doc_id)")
def lexical_score(spark, sf_dir):
    return ranking.lexical_score(documents(spark, sf_dir), LICENSE).withColumn("score", F.round("score", 6))


@query("WITH " + LEX_SQL + " SELECT doc_id, round(score, 6) AS score FROM lex")
def lexical_rank(spark, sf_dir):
    return ranking.lexical_rank_indexed(*index(spark, sf_dir, set(LICENSE)), LICENSE).withColumn("score", F.round("score", 6))


@query("WITH " + LEX_SQL + " SELECT doc_id, round(score, 6) AS score FROM lex")
def lexical_rank_scan(spark, sf_dir):
    """Without an index: every text is searched."""
    return ranking.lexical_rank(documents(spark, sf_dir), LICENSE).withColumn("score", F.round("score", 6))


@query("WITH " + LEX_SQL + " SELECT doc_id AS file, round(score, 6) AS score, true AS zero_result_escalation FROM lex UNION ALL SELECT doc_id, n_chars::DOUBLE, false FROM documents WHERE doc_id % 50 = 49 AND n_chars < 0")
def zero_result_escalation(spark, sf_dir):
    lexical = ranking.lexical_rank_indexed(*index(spark, sf_dir, set(LICENSE)), LICENSE).withColumnRenamed("doc_id", "file")
    first = documents(spark, sf_dir).where("n_chars < 0").select(F.col("doc_id").alias("file"), F.col("n_chars").cast("double").alias("score"))
    return ranking.escalate(first, lexical).withColumn("score", F.round("score", 6))


def _query_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0])


@query("WITH " + COS_SQL + " SELECT vec_id, round(score, 6) AS score FROM c ORDER BY c.score DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    return ranking.semantic_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def _semantic(spark, sf_dir):
    top = ranking.semantic_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 100).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("function", "variable", "file_summary", "heading"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return top.select("vec_id", F.concat(F.lit("src"), (F.col("vec_id") % 40).cast("string")).alias("file"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"), kind.alias("kind"), "score")


SEM_SQL = COS_SQL + """, top AS (SELECT vec_id, 'src' || (vec_id % 40) AS file, 'n' || label AS name, ['function', 'variable', 'file_summary', 'heading'][vec_id % 4 + 1] AS kind, score FROM c ORDER BY c.score DESC, vec_id LIMIT 100),
rr AS (SELECT *, score * CASE kind WHEN 'function' THEN 1.03 WHEN 'file_summary' THEN 0.9 ELSE 1.0 END::DOUBLE * CASE WHEN kind = 'function' AND name = 'n3' THEN 1.2 ELSE 1.0 END::DOUBLE AS rank_score, kind = 'function' AND name = 'n3' AND score >= 0.35 AS cap_protected FROM top)"""


@query("WITH " + SEM_SQL + """ SELECT vec_id, file, name, kind, round(rank_score, 6) AS rank_score, cap_protected FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY rank_score DESC, file) AS nth FROM rr) WHERE nth <= 2""")
def semantic_rerank(spark, sf_dir):
    out = ranking.diversity_cap(ranking.rerank(_semantic(spark, sf_dir), "mixed", ["N3"]))
    return out.select("vec_id", "file", "name", "kind", F.round("rank_score", 6).alias("rank_score"), "cap_protected")


@query("WITH " + SEM_SQL + ", " + LEX_SQL + """, lf AS (SELECT source AS file, max(score) AS l_score, false AS generated FROM lex JOIN documents USING (doc_id) GROUP BY 1),
j AS (SELECT coalesce(rr.file, lf.file) AS file, coalesce(name, '') AS name, CASE WHEN rr.file IS NULL THEN least(l_score * 0.5, 0.25) WHEN lf.file IS NOT NULL THEN rank_score * 1.1 ELSE rank_score END AS score, coalesce(cap_protected, false) AS cap_protected, coalesce(generated, false) AS generated,
 CASE WHEN rr.file IS NULL THEN 'lexical' WHEN lf.file IS NOT NULL THEN 'hybrid' ELSE 'semantic' END AS source FROM rr FULL JOIN lf ON rr.file = lf.file),
k AS (SELECT *, row_number() OVER (PARTITION BY file, cap_protected ORDER BY generated, score DESC, name) AS nth FROM j)
SELECT file, name, round(score, 6) AS score, cap_protected, generated, source FROM (SELECT * FROM k WHERE cap_protected OR nth <= 2 ORDER BY generated, score DESC, file, name LIMIT 20)""")
def hybrid_fuse(spark, sf_dir):
    d = documents(spark, sf_dir)
    lex = ranking.lexical_rank_indexed(*index(spark, sf_dir, set(LICENSE)), LICENSE).join(d.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("file")).agg(F.max("score").alias("score")).withColumn("generated", F.lit(False))
    return ranking.fuse(ranking.rerank(_semantic(spark, sf_dir), "mixed", ["N3"]), lex, "mixed", 20).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)
 SELECT doc_id, rank::INTEGER AS rank, array_to_string(list_slice(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1, CASE WHEN rank = 0 THEN 20 WHEN rank <= 2 THEN 5 ELSE 0 END), chr(10)) AS snippet FROM r""")
def snippet_budget(spark, sf_dir):
    top = documents(spark, sf_dir).select("doc_id", "n_chars", "text").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1)
    return ranking.snippets(top, text.lines(F.col("text"))).select("doc_id", "rank", "snippet")


#: Queries with the kind that each must have, written down by hand.
SHAPES = {
    "how does it work": "natural_language", "": "natural_language", "parse imports": "natural_language", "a list of 404 things in a row": "natural_language",
    "ERR_TIMEOUT": "error_code", "TS2304": "error_code", "0xdeadBEEF": "error_code", "E1234": "error_code", "error 404": "error_code",
    "why ERR_TIMEOUT here": "mixed", "where is fooBar set": "mixed", "404 not found": "mixed", "why 500": "mixed", "what is http reply code 404 for": "mixed",
    "fooBar": "identifier", "retry": "identifier", "snake_case": "identifier", "HTTPServer": "identifier", "io ab": "identifier", "a$": "identifier", "console.log": "path",
    "a.*b": "regex", "[a-z]+": "regex", "(?=x)": "regex", "foo{2}": "regex", "^main": "regex", "end$": "regex", "(a|b)\\1": "regex", "ab|cd": "regex", "\\bword": "regex",
    "src/lib/a.ts": "path", "/etc/my file": "path", "C:\\src\\main.rs": "path", "src\\lib\\a.rs": "path", "\\\\host\\share": "path", "ftp://a.b/c": "path", "README.md": "path",
}
SHAPES_SQL = ", ".join("('" + q.replace("'", "''") + f"', '{k}')" for q, k in SHAPES.items())
#: Of the tables' texts the kind follows from what they are: two plain words, addresses, sentences, two joined words.
ASKED_SQL = f"""talk AS (SELECT DISTINCT regexp_extract(text, '^[^.]*') AS q FROM conversations), spoken AS (SELECT q, list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '') AS ws FROM talk),
asked AS (SELECT DISTINCT p_name AS q, 'natural_language' AS kind FROM part UNION SELECT DISTINCT url, 'path' FROM pages UNION SELECT DISTINCT event_type || '_' || event_type, 'identifier' FROM events UNION SELECT * FROM (VALUES {SHAPES_SQL})
 UNION SELECT q, CASE WHEN len(ws) = 0 OR len(ws) > 2 OR (len(ws) = 2 AND len(list_filter(ws, lambda w: regexp_full_match(w, '[a-z][a-z][a-z]+'))) = 2) THEN 'natural_language' ELSE 'identifier' END FROM spoken)"""


def _asked(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    q = t("part").select(F.col("p_name").alias("q")).union(t("pages").select("url")).union(t("conversations").select(F.regexp_extract("text", "^[^.]*", 0))).union(t("events").select(F.concat("event_type", F.lit("_"), "event_type")))
    return q.union(spark.createDataFrame([(x,) for x in SHAPES], "q string")).where("q is not null").distinct()


@query(f"""WITH {ASKED_SQL} SELECT q, kind, CASE kind WHEN 'identifier' THEN 0.2 WHEN 'regex' THEN 0.0 WHEN 'natural_language' THEN 0.6 WHEN 'mixed' THEN 0.4 ELSE 0.1 END::DOUBLE AS semantic, CASE kind WHEN 'identifier' THEN 0.8 WHEN 'regex' THEN 1.0 WHEN 'natural_language' THEN 0.4 WHEN 'mixed' THEN 0.6 ELSE 0.9 END::DOUBLE AS lexical,
 kind NOT IN ('regex', 'natural_language') AS use_lexical, CASE kind WHEN 'regex' THEN 'regex' WHEN 'error_code' THEN 'literal' ELSE 'hybrid' END AS mode FROM asked WHERE q IS NOT NULL""")
def query_shapes(spark, sf_dir):
    rows = _asked(spark, sf_dir).withColumn("kind", shape.kind(F.col("q")))
    return rows.withColumn("w", shape.weights(F.col("kind"))).select("q", "kind", "w.semantic", "w.lexical", "w.use_lexical", shape.mode(F.col("kind")).alias("mode"))


#: Prose around numbers of its own, with the code-shaped tokens that must be found in it.
TOKENS_SQL = """SELECT event_id, list_aggregate(list_sort([[], ['fooBar' || event_id], ['a_b', 'x.y'], ['HTTPServer', 'ERR_' || event_id], ['Engine.Index', 'raw text', 'getX']][event_id % 5 + 1]), 'string_agg', '|') AS tokens FROM events"""


@query(TOKENS_SQL)
def code_tokens(spark, sf_dir):
    n = F.col("event_id").cast("string")
    said = (F.lit("nothing to see here"), F.concat(F.lit("where is fooBar"), n, F.lit(" set")), F.lit("why does a_b use x.y so"), F.concat(F.lit("the HTTPServer gave ERR_"), n, F.lit(" again")), F.lit("the Engine Index of 'raw text' and getX"))
    text_ = F.element_at(F.array(*said), (F.col("event_id") % 5 + 1).cast("int"))
    found = F.array_join(F.array_sort(shape.explicit_code_tokens(text_)), "|")
    return table(spark, sf_dir, "events").select("event_id", F.nullif(found, F.lit("")).alias("tokens"))


@query("""WITH n AS (SELECT DISTINCT n_name AS name, contains(lower(n_name), 'nation_1') AS is_match, levenshtein(lower(n_name), 'nation_1')::BIGINT AS distance FROM nation) SELECT * FROM n WHERE is_match OR distance <= 2 ORDER BY is_match DESC, distance, name LIMIT 25""")
def close_names(spark, sf_dir):
    return ranking.close_names(table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name"), "Nation_1", 25)


@query("""WITH c AS (SELECT b.item_id AS query_id, d.doc_id AS item, row_number() OVER (PARTITION BY b.item_id ORDER BY abs(length(d.text) - 10 * length(b.text)), d.doc_id) AS rank FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40),
p AS (SELECT * FROM c WHERE rank <= 10), t AS (SELECT l.doc_id % 40 AS query_id, l.doc_id AS item, (1 + quality)::DOUBLE AS relevance FROM labels l WHERE quality IS NOT NULL),
f AS (SELECT t.*, rank, row_number() OVER (PARTITION BY t.query_id ORDER BY relevance DESC, t.item) AS ideal FROM t LEFT JOIN p ON p.query_id = t.query_id AND p.item = t.item)
SELECT query_id, count(rank) / count(*) AS recall, count(rank) / 10 AS precision, coalesce(1 / min(rank), 0) AS mrr, round(coalesce(sum(relevance / log2(rank + 1)), 0) / sum(relevance / log2(ideal + 1)) FILTER (ideal <= 10), 6) AS ndcg FROM f GROUP BY 1""")
def retrieval_metrics(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), documents(spark, sf_dir)
    near = F.abs(F.length(d["text"]) - 10 * F.length(b["text"]))
    pairs = b.join(d, d["doc_id"] % 40 == b["item_id"] % 40).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item"), near.alias("far"))
    top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "item"))).where("rank <= 10")
    truth = table(spark, sf_dir, "labels").where("quality is not null").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item"), (1.0 + F.col("quality")).alias("relevance"))
    return evalmetrics.at_k(top, truth, 10).withColumn("ndcg", F.round("ndcg", 6))
