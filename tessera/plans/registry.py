"""Query key → Spark query and oracle SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import iterate, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its name, with its oracle if SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a source that queries share, as an index or a graph: written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        folder = iterate.temporary(spark, name)
        write(folder)
        _STORED[key] = folder
    return _STORED[key]


def stored_table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(stored(spark, sf_dir, name, lambda folder: build().write.mode("overwrite").parquet(folder)))


def index(spark: SparkSession, sf_dir: str, trigrams: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored trigram index of documents (of some trigrams: their buckets alone are read) and the documents' sizes."""
    folder = stored(spark, sf_dir, "index", lambda f: search.write_index(documents(spark, sf_dir), f))
    sizes = stored_table(spark, sf_dir, "sizes", lambda: search.read_sizes(search.read_index(spark, folder)))
    return search.read_index(spark, folder, trigrams), sizes


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a path from source, number and language, a size and a time."""
    ext = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "rs").otherwise("md")
    folder = F.when(F.col("doc_id") % 7 == 0, "/tests").when(F.col("doc_id") % 11 == 0, "/generated").when(F.col("doc_id") % 13 == 0, "/fixtures").otherwise("/lib")
    path = F.concat("source", folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return documents(spark, sf_dir).select("doc_id", path.alias("path"), "text", "lang", F.col("n_chars").alias("size"), (F.col("doc_id") * 7919 % 100003).alias("mtime"))


#: The same in SQL.
FILES_SQL = """files AS (SELECT doc_id, source || (CASE WHEN doc_id % 7 = 0 THEN '/tests' WHEN doc_id % 11 = 0 THEN '/generated' WHEN doc_id % 13 = 0 THEN '/fixtures' ELSE '/lib' END)
 || '/f' || doc_id::VARCHAR || '.' || (CASE lang WHEN 'en' THEN 'ts' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'rs' ELSE 'md' END) AS path, text, lang, n_chars AS size, doc_id * 7919 % 100003 AS mtime FROM documents)"""
LINES_SQL = r"""lines AS (SELECT doc_id, unnest(range(1, len(l) + 1))::BIGINT AS line, unnest(l) AS line_text FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents))"""
