"""Line dedup: lines that many documents share go, the other lines are put together again in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import ASCII_SPACE, ascii_lower, fresh, stored, table

#: A broadcast of line hashes holds at most so many rows of 16 bytes.
MAX_BROADCAST_ROWS = 100_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs) of every line key with at least min_chars code points that min_docs rows or more contain."""
    keys = F.array_distinct(F.transform(_lines(F.col(f"`{text}`")), line_key))
    hashed = (
        docs.select(F.explode(keys).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    )
    return hashed.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _dropped(hits: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of hits whose line is frequent.

    The lines that hold over 1/MAX_BROADCAST_ROWS of all frequent occurrences are fewer than
    MAX_BROADCAST_ROWS: these go by broadcast, so that no key of the shuffled rest is hot.
    """
    stats = frequent.agg(F.count("*").alias("n"), F.sum("n_docs").alias("total")).first()
    if stats.n <= MAX_BROADCAST_ROWS:
        return hits.join(F.broadcast(frequent.select("h1", "h2")), ["h1", "h2"], "left_semi")
    heavy = F.col("n_docs") > stats.total / MAX_BROADCAST_ROWS
    top, rest = frequent.where(heavy).select("h1", "h2"), frequent.where(~heavy).select("h1", "h2")
    return hits.join(F.broadcast(top), ["h1", "h2"], "left_semi").unionByName(
        hits.join(F.broadcast(top), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"], "left_semi")
    )


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    r"""docs with `text` cleaned, and n_lines, n_dropped (long).

    A text is split at \n. A line's key is the line without [\x20\x09-\x0D] at its ends, A-Z lower-cased.
    Keys of min_chars code points or more that min_docs rows or more contain lose all their lines everywhere.

    * Null or empty text: one empty line, which an empty key (shorter than min_chars=1) never drops; the result is ''.
    * Repeated rows, and rows that share a doc_id, each count as a document; ties at min_docs are dropped.
    * All lines dropped: ''. Empty table: empty result.
    * Columns of docs named n_lines or n_dropped are replaced; all others, whatever their names, stay.
    """
    r1, r2, pos, lines, gone, q1, q2 = fresh([*docs.columns, "n_lines", "n_dropped", "h1", "h2", "key", "n_docs"], "r1", "r2", "pos", "lines", "gone", "q1", "q2")
    frequent = stored(frequent_lines(docs, text, min_docs, min_chars), "lines")
    # A row is known by its own content: equal rows lose equal lines.
    own = [f"`{c}`" for c, kind in docs.dtypes if not kind.startswith(("map", "variant")) and "map<" not in kind]
    keyed = docs.withColumns({r1: F.xxhash64(*own), r2: F.xxhash64(*reversed(own), F.lit(1))})
    hits = (
        keyed.select(r1, r2, F.posexplode(F.transform(_lines(F.col(f"`{text}`")), line_key)).alias(pos, "key"))
        .where(F.char_length("key") >= min_chars)
        .select(r1, r2, pos, F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    )
    dropped = (
        _dropped(hits, frequent)
        .groupBy(F.col(r1).alias(q1), F.col(r2).alias(q2))
        .agg(F.collect_set(pos).alias(gone))
    )
    both = keyed.join(dropped, (F.col(r1) == F.col(q1)) & (F.col(r2) == F.col(q2)), "left").withColumn(lines, _lines(F.col(f"`{text}`")))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(gone), F.array().cast("array<int>"))),
        lambda i: F.get(F.col(lines), i),
    )
    # One new row for each old one: all columns come from the left side.
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in ("n_lines", "n_dropped")],
        F.array_join(kept, "\n").alias(text),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: A row of documents is a document, as in dedup_lines, also where rows share a doc_id.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM d),
k AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.r, k.doc_id
"""
