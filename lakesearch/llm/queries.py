"""The queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontamination, language_model, minhash_dedup, quality_rules, sentencepiece_codec, sharding, toxicity, url_filter, warc
from ..session import spread
from .common import LOWER, UPPER, materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All documents; a table too small to be split is dealt out to all cores."""
    whole = table(spark, sf_dir, "documents")
    return spread(whole.select(*columns), whole)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    seen = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("leak.items")
    return seen.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) >= 2).alias("contaminated"),
    )


def op1_sql() -> str:
    words = lambda x: f"coalesce(regexp_extract_all(translate({x}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    k = decontamination.WINDOW
    return f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, {k} AS size, array_to_string(w[p : p + {k - 1}], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - {k - 2})) AS p FROM i WHERE len(w) >= {k})
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND {k - 1}
), d AS (SELECT doc_id, row_number() OVER () AS r, {words("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT r, size, p, array_to_string(w[p : p + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d JOIN sizes ON len(w) >= size)),
hits AS (SELECT r, p, size, item FROM grams JOIN windows USING (size, gram)),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS place FROM hits) GROUP BY r),
seen AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN seen USING (r)"""


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.learn_and_score(documents(spark, sf_dir, "doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sql() -> str:
    base32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest FROM h),
r AS (SELECT *, CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest AND n >= {warc.MIN_PAYLOAD} THEN newest END AS refers_to FROM l)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr({base32}, 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INT), 5) AS INT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return sentencepiece_codec.digests(docs).select("doc_id", "coded.*")


#: A conversation of control strings only, added to the table.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    made = chat_format.format_conversations(rows.unionByName(probe))
    turns, loss = F.col("turns"), F.array_join("loss", "")
    nl = F.lit("\n")
    return (
        made.withColumn("turns", chat_format.parse(F.col("formatted")))
        .withColumn("loss", chat_format.under_mask(F.col("formatted"), F.col("loss_runs")))
        .select(
            "conv_id", F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, nl, t.text, nl)), ""), 256).alias("turns_sha256"),
            F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op5_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def escaped(col: str) -> str:
        out = f"replace({col}, '\\', '\\\\')"
        for c in chat_format.CONTROLS:
            out = f"replace({out}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
        return out

    head = len(chat_format.TURN + chat_format.BODY)
    tail = len(chat_format.END) + 1
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {quoted(PROBE)} UNION ALL SELECT -1, 1, 'assistant', {quoted(PROBE)}
), seen AS (
  SELECT *, lag(role) OVER w AS was, row_number() OVER w AS n FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(length({escaped("text")}) + CASE WHEN was IS DISTINCT FROM role
    THEN length({escaped("role")}) + {head + tail} ELSE {len(chat_format.PART)} END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    measured = materialize(quality_rules.measures(docs).drop("text"), "measures")
    judged = quality_rules.judge(measured, table(spark, sf_dir, "labels"))
    counts = [f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.key))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda out, other: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{out(r)}'" for r in rules) + f" ELSE {other} END"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path, {case(lambda r: r.key, "NULL")} AS rule, {case(lambda r: r.verdict, "'allow'")} AS verdict FROM parsed"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return sharding.shard(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = minhash_dedup.cluster(docs, k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_sql() -> str:
    """For tables of some thousand documents: pairs meet by shared shingles, components by reach along links."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, r, array_to_string(w[p : p + 2], ' ') AS s FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
), sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
smallest AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN smallest USING (r) LEFT JOIN sizes USING (r)"""


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_language_model": op2_language_model,
        "op3_warc": op3_warc,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_chat_format": op5_chat_format,
        "op6_quality_rules": op6_quality_rules,
        "op7_url_filter": op7_url_filter,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_minhash_dedup": op10_minhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": op1_sql(), "op3_warc": op3_sql(), "op5_chat_format": op5_sql(), "op7_url_filter": op7_sql(),
        "op10_minhash_dedup": op10_sql(),
    }
