"""Line deduplication over a corpus, in DataFrame operations only.

Lines are exploded with their position and hashed; documents are counted per hash; the lines
of keys over the threshold are dropped everywhere but in one document; what stays is put
together again by position. Texts move through one shuffle only (the join with the positions to
drop); counting and matching see hashes, ids and positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACES, UPPER, materialize, spare, table, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _key_hash(key: Column) -> list[Column]:
    """128 bits in two columns, so that no two keys of a corpus of any size share them in practice."""
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Positions of the lines to drop, one row per (id, text hash) that loses any: ``_id, _h, _drop``."""
    keyed = materialize(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"),
            F.xxhash64(text_or_empty()).alias("_h"),
            F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"),
        )
        .select("_id", "_h", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("_id", "_h", "pos", *_key_hash(F.col("key"))),
        "lines",
    )
    # Documents of a hot line are first counted apart (the exchange is by line and document),
    # then summed from partial counts.
    per_doc = keyed.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
    hot = materialize(
        per_doc.groupBy("h1", "h2")
        .agg(F.count("one").alias("n_docs"), F.max("_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper"),
        "hot",
    )
    # Both sides are tables, so the partition of a very common line is split between tasks.
    gone = keyed.join(hot, ["h1", "h2"]).where(F.col("_id") != F.col("keeper"))
    return gone.groupBy("_id", "_h").agg(F.collect_set("pos").alias("_drop"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its text reduced to the lines that stay, and ``_n_lines``, ``_n_dropped``.

    * A text is split at ``\\n``; null or empty: one empty line, which stays (text ``""``).
    * A key shorter than ``min_chars`` code points, or in fewer than ``min_docs`` documents, keeps
      all its lines. Any other key keeps its lines in the largest doc_id that holds it alone.
    * A document whose every line goes has the empty text. Rows that share a doc_id are one
      document when documents are counted; each of them loses its own lines. A null doc_id
      counts as the smallest id and stays null.
    * A text of any length is one row of its lines; only ids, hashes and positions of lines are compared.
    * Other columns are passed on, but for any of the names of the two counts, which are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("_n_lines", "_n_dropped")]
    docs = docs.select(*kept)
    at, hashed, drop, lines, left = spare(docs, "_id", "_h", "_drop", "_lines", "_text")
    # Written, so that very many rows of one id and text are split between tasks where they meet it.
    drops = materialize(dropped_positions(docs, min_chars, min_docs), "drops").select(F.col("_id").alias(at), F.col("_h").alias(hashed), F.col("_drop").alias(drop))
    keyed = docs.withColumns({at: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), hashed: F.xxhash64(text_or_empty())})
    joined = keyed.join(drops.hint("shuffle_hash"), [at, hashed], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    return (
        joined.withColumn(lines, F.split(text_or_empty(), "\n"))
        .withColumn(
            left,
            F.when(F.col(drop).isNull(), text_or_empty()).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")),
        )
        .select(
            *[F.col(left).alias(c) if c.lower() == "text" else F.col(c) for c in kept],
            F.size(lines).cast("long").alias("_n_lines"),
            F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("_n_dropped"),
        )
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lines),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
