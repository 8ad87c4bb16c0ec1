"""Chunk tables for retrieval, derived from ``documents`` in the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rank, text
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_path() -> Column:
    """Six kinds of paths, by the id: guides, sources, tests, locale files, plain texts."""
    i = F.col("doc_id")
    n = i.cast("string")
    forms = (("docs/readme_", ".md"), ("src/mod_", ".py"), ("src/mod_", "_test.go"), ("locale/", ".json"), ("notes/", ".txt"), ("src/core_", ".ts"))
    out = None
    for k, (head, tail) in enumerate(forms[:-1]):
        value = F.concat(F.col("source"), F.lit("/" + head), n, F.lit(tail))
        out = F.when(i % 6 == k, value) if out is None else out.when(i % 6 == k, value)
    return out.otherwise(F.concat(F.col("source"), F.lit("/" + forms[-1][0]), n, F.lit(forms[-1][1])))


PATH_SQL = """source || CASE doc_id % 6 WHEN 0 THEN '/docs/readme_' || doc_id || '.md' WHEN 1 THEN '/src/mod_' || doc_id || '.py'
  WHEN 2 THEN '/src/mod_' || doc_id || '_test.go' WHEN 3 THEN '/locale/' || doc_id || '.json'
  WHEN 4 THEN '/notes/' || doc_id || '.txt' ELSE '/src/core_' || doc_id || '.ts' END"""
TYPE_SQL = """CASE doc_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'json' WHEN 4 THEN 'text' ELSE 'typescript' END"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document: id, kb_id, file_path, file_type, content, start_line, end_line, index_text."""
    whole = table(spark, sf_dir, "documents")
    docs = spread(whole.select("doc_id", "text", "lang", "source"), whole)
    return (
        docs.withColumn("file_path", file_path()).withColumn("file_type", rank.file_type(F.col("file_path")))
        .select(
            F.col("doc_id").alias("id"), F.col("lang").alias("kb_id"), "file_path", "file_type",
            F.col("text").alias("content"), F.lit(1).alias("start_line"),
            (F.size(F.split("text", "\n")) + 0).alias("end_line"),
        ).withColumn("index_text", index_text(F.col("file_path"), F.col("file_type"), F.lit(None), F.lit(None), F.col("content")))
    )


def index_text(path: Column, kind: Column, section: Column, symbol: Column, content: Column) -> Column:
    """The text that is indexed: a prefix with path, type, section and symbol, then the content."""
    head = F.concat_ws(
        "\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Type: "), kind),
        F.when(F.length(section) > 0, F.concat(F.lit("Section: "), section)),
        F.when(F.length(symbol) > 0, F.concat(F.lit("Symbol: "), symbol)),
    )
    return F.concat(head, F.lit("\n\n"), content)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of ``benchmark`` as queries: query_id, query (normalised), signals."""
    items = table(spark, sf_dir, "benchmark")
    tokens = text.tokenize(F.col("text"))
    return items.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("raw"), F.array_join(tokens, " ").alias("query"),
        text.signals(tokens).alias("signals"),
    )


#: The same in SQL, as macros of text. RE2 and Java agree on these patterns.
def pretokenize_sql(x: str) -> str:
    for pattern, to in (
        ("([a-z])([A-Z])", "\\1 \\2"), ("([A-Z]+)([A-Z][a-z])", "\\1 \\2"), ("([a-zA-Z])([0-9])", "\\1 \\2"),
        ("([0-9])([a-zA-Z])", "\\1 \\2"), ("([\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}])", " \\1 "), ("\\s+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


def tokenize_sql(x: str) -> str:
    """List of distinct tokens, in no order."""
    quoted = text.SIGNS.replace("'", "''")
    words = f"string_split_regex(regexp_replace(lower({pretokenize_sql(x)}), '{quoted}', ' ', 'g'), '\\s+')"
    typos = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.TYPOS.items()) + " ELSE t END"
    kept = f"list_filter(list_transform({words}, lambda t: {typos}), lambda t: length(t) > 1 OR regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]'))"
    return f"list_distinct({kept})"


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN {t}[:-4]"
        f" WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN {t}[:-3] WHEN length({t}) > 3 AND {t} LIKE '%s' THEN {t}[:-2] ELSE {t} END"
    )


def signals_sql(tokens: str) -> str:
    stops = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return f"list_distinct(list_transform(list_filter({tokens}, lambda t: t NOT IN ({stops})), lambda t: {stem_sql('t')}))"


def index_tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower(translate({x}, '{text.MARKED}', '{text.PLAIN}')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id AS id, lang AS kb_id, {PATH_SQL} AS file_path, {TYPE_SQL} AS file_type, text AS content, 1 AS start_line,
    length(text) - length(replace(text, chr(10), '')) + 1 AS end_line,
    'File: ' || {PATH_SQL} || chr(10) || 'Type: ' || {TYPE_SQL} || chr(10) || chr(10) || text AS index_text
  FROM documents)"""
