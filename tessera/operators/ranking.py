"""Lexical and vector ranking, re-ranking and fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grams, shape

#: Factors by kind of symbol for prose and mixed queries, boosts, caps and floors.
DEFINITIONS = ("function", "class", "method", "struct", "interface", "enum", "type_alias")
KIND_FACTORS = {"natural_language": {"definition": 1.08, "variable": 0.92, "file_summary": 0.80}, "mixed": {"definition": 1.03, "file_summary": 0.90}}
EXACT_NAME, PROTECTED, OVERLAP, LEXICAL_CEILING, EXPORTED = 1.20, 0.35, 1.1, 0.25, 1.1
PER_FILE, PER_NAME = 2, 2
#: Lines of a snippet by rank.
SNIPPET = (20, 5, 5)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def semantic_top_k(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(vec_id, score) of the k rows with the largest cosine, ties to the smaller vec_id. The query is one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def candidate_limit(k: int, tests_hidden: bool = False) -> int:
    return max(100, k) if tests_hidden else max(10, 3 * k)


def lexical_score(docs: DataFrame, query: Sequence[str]) -> DataFrame:
    """(doc_id, hits, score): query trigrams in a document by 1 + ln of its distinct trigrams."""
    rows = docs.select("doc_id", grams.stats(F.col("text"), query).alias("s")).select("doc_id", F.size("s.hits").cast("long").alias("hits"), "s.n")
    return rows.select("doc_id", "hits", F.when(F.col("hits") == 0, 0.0).otherwise(F.col("hits") / (1 + F.log(F.greatest("n", F.lit(1))))).alias("score"))


def lexical_rank_indexed(index: DataFrame, sizes: DataFrame, query: Sequence[str], most: int = 50) -> DataFrame:
    """lexical_rank from stored postings (trigram, doc_id) and sizes (doc_id, n): no text is read."""
    wanted = [grams.packed(t) for t in dict.fromkeys(query)]
    hits = index.where(F.col("trigram").isin(wanted)).select("trigram", "doc_id")
    counts = {r.trigram: r.n for r in hits.groupBy("trigram").agg(F.count("*").alias("n")).collect()}  # a row for each query trigram
    rarest = sorted(counts, key=lambda t: (counts[t], t))[:3]  # packed trigrams are ordered as their texts
    held = hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.max(F.col("trigram").isin(rarest)).alias("rare"))
    some = held.where("rare").orderBy("doc_id").limit(200 if len(rarest) == 3 else 500)
    score = F.col("hits") / (1 + F.log(F.greatest("n", F.lit(1))))
    return sizes.join(F.broadcast(some), "doc_id").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


def escalate(first: DataFrame, lexical: DataFrame) -> DataFrame:
    """(file, score, zero_result_escalation): first's results (file, score), or the lexical lane's, so marked, if there are none."""
    some = first.limit(1).agg(F.count("*").alias("some"))  # one row: no second plan, and no question to the driver
    whole = first.select("file", "score", F.lit(False).alias("zero_result_escalation")).unionByName(lexical.select("file", "score", F.lit(True).alias("zero_result_escalation")))
    return whole.join(F.broadcast(some), (F.col("some") == 0) == F.col("zero_result_escalation")).drop("some")


def lexical_rank(docs: DataFrame, query: Sequence[str], most: int = 50) -> DataFrame:
    """(doc_id, score): documents with one of the three rarest query trigrams, of these the first 200 (500 with fewer trigrams) by id, ranked by score."""
    # which trigrams a text has is a search for each, (?i) folding A-Z only; only the candidates' trigrams are counted
    has = F.array(*[F.when(F.col("text").rlike("(?i)\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"), F.lit(t)) for t in dict.fromkeys(query)]) if query else F.array().cast("array<string>")
    held = docs.select("doc_id", "text", F.array_compact(has).alias("q")).where("size(q) > 0")
    counts = {r.t: r.n for r in held.select(F.explode("q").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row for each query trigram
    rarest = sorted(counts, key=lambda t: (counts[t], t))[:3]
    if not rarest:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    some = held.where(F.arrays_overlap("q", F.array(*map(F.lit, rarest)))).orderBy("doc_id").limit(200 if len(rarest) == 3 else 500)
    score = F.size("q") / (1 + F.log(F.greatest(F.col("s.n"), F.lit(1))))
    some = some.select("doc_id", "q", grams.stats(F.col("text"), query).alias("s"))
    return some.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


def kind_factor(kind: Column, query_kind: str) -> Column:
    factors = KIND_FACTORS.get(query_kind, {})
    return F.when(kind.isin(*DEFINITIONS), factors.get("definition", 1.0)).when(kind == "variable", factors.get("variable", 1.0)).when(kind == "file_summary", factors.get("file_summary", 1.0)).otherwise(1.0)


def rerank(results: DataFrame, query_kind: str, tokens: Sequence[str] = ()) -> DataFrame:
    """rank_score and cap_protected for (name, kind, score, ...): kind factors, and a boost for definitions named in the query."""
    exact = F.col("kind").isin(*DEFINITIONS) & (F.lower("name").isin(*[t.lower() for t in tokens]) if query_kind in ("mixed", "natural_language") else F.col("name").isin(*tokens)) if tokens else F.lit(False)
    return results.withColumn("rank_score", F.col("score") * kind_factor(F.col("kind"), query_kind) * F.when(exact, EXACT_NAME).otherwise(1.0)).withColumn("cap_protected", exact & (F.col("score") >= PROTECTED))


def diversity_cap(results: DataFrame, most: int = PER_NAME) -> DataFrame:
    """At most two of a name and kind, best first."""
    own = Window.partitionBy("name", "kind").orderBy(F.desc("rank_score"), "file")
    return results.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).drop("nth")


def cap_per_file(results: DataFrame, most: int = PER_FILE) -> DataFrame:
    """At most two unprotected results of a file; protected ones stay and don't count."""
    own = Window.partitionBy("file", "cap_protected").orderBy("generated", F.desc("score"), "name")
    return results.withColumn("nth", F.row_number().over(own)).where(F.col("cap_protected") | (F.col("nth") <= most)).drop("nth")


def fuse(semantic: DataFrame, lexical: DataFrame, query_kind: str, k: int) -> DataFrame:
    """(file, name, score, cap_protected, generated, source) from semantic (file, name, rank_score, cap_protected) and lexical (file, score, generated)."""
    lex = lexical.select(F.col("file").alias("l_file"), F.col("score").alias("l_score"), "generated")
    both = semantic.join(lex, F.col("file") == F.col("l_file"), "full_outer")
    only = F.least(F.col("l_score") * shape.LEXICAL_ONLY[query_kind], F.lit(LEXICAL_CEILING))
    out = both.select(
        F.coalesce("file", "l_file").alias("file"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.when(F.col("file").isNull(), only).when(F.col("l_file").isNotNull(), F.col("rank_score") * OVERLAP).otherwise(F.col("rank_score")).alias("score"),
        F.coalesce("cap_protected", F.lit(False)).alias("cap_protected"),
        F.coalesce("generated", F.lit(False)).alias("generated"),
        F.when(F.col("file").isNull(), "lexical").when(F.col("l_file").isNotNull(), "hybrid").otherwise("semantic").alias("source"),
    )
    return cap_per_file(out).orderBy("generated", F.desc("score"), "file", "name").limit(k)


def snippets(ranked: DataFrame, lines_of: Column) -> DataFrame:
    """The first lines of each result, fewer for lower ranks (rank from 0)."""
    budget = F.coalesce(F.get(F.array(*map(F.lit, SNIPPET)), F.col("rank").cast("int")), F.lit(0))
    return ranked.withColumn("snippet", F.array_join(F.slice(lines_of, F.lit(1), budget), "\n"))


def close_names(names: DataFrame, asked: str, k: int) -> DataFrame:
    """(name, is_match, distance): names that hold the query first, else by edit distance up to a third of its length (2 at least)."""
    distance = F.levenshtein(F.lower("name"), F.lit(asked.lower())).cast("long")
    hit = F.lower("name").contains(asked.lower())
    return names.select("name").distinct().select("name", hit.alias("is_match"), distance.alias("distance")).where(F.col("is_match") | (F.col("distance") <= max(2, len(asked) // 3))).orderBy(F.desc("is_match"), "distance", "name").limit(k)
