"""Ranked lexical search by blocked matrix products: item weights, in tiles of a compact vocabulary, times document impacts.

Weights and impacts are whole numbers, held as float64. A tile's columns are dealt into parts so that no sum of products
of a part can reach 2^53; so BLAS adds without rounding, in any order, and parts are added as 64-bit integers. Each
task keeps the k best documents of each item, ties by document id, and these meet in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from fieldcast.llm.common import table

#: A block of items, which is broadcast, has about so many items and characters (but for an item that is longer alone).
BLOCK_ITEMS, BLOCK_CHARS = 2048, 500_000
#: Items and documents of a product; a document tile also ends after so many words.
ITEM_TILE, DOC_TILE, TILE_WORDS = 64, 512, 1_000_000
#: Terms of a product.
COLUMNS = 4096
#: An impact is less than this: (10^9 tf) div (1000 tf + 12 m) with m > 0.
IMPACT = 10**6
EXACT = 2**53
#: Groups that an item's candidates meet in before they meet in one.
MEET = 64
#: A-Z lower-cased; the ASCII characters that end a term become blanks. Bytes from 128 on belong to terms.
_TERMS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in b"".join(bytes([c]).lower() for c in range(256)))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters than ASCII ones."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


class Tile:
    """Items and their weights in parts: (terms, terms by items). A part has COLUMNS terms at most, and its sums are exact."""

    def __init__(self, term: np.ndarray, item: np.ndarray, weight: np.ndarray):
        """term, item, weight: one entry for each term of an item."""
        self.items = np.unique(item)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        # Entries so large that they alone could leave the exact range are halved until they don't.
        most = (EXACT - 1) // IMPACT
        while (weight > most).any():
            large = weight > most
            term, item = np.r_[term, term[large]], np.r_[item, item[large]]
            weight = np.r_[np.where(large, weight // 2, weight), weight[large] - weight[large] // 2]
        left = np.lexsort((term, item))
        while len(left):
            # What still goes into this part of each item: one entry a term, in sum at most `most`.
            it, te, w = item[left], term[left], weight[left]
            again = np.r_[False, (it[1:] == it[:-1]) & (te[1:] == te[:-1])]
            total = np.cumsum(np.where(again, 0, w))
            before = (total - w)[np.searchsorted(it, it)]
            now = ~again & (total - before <= most)
            used = np.unique(te[now])
            matrix = np.zeros((len(used), len(self.items)))
            matrix[np.searchsorted(used, te[now]), np.searchsorted(self.items, it[now])] = w[now]
            self.parts += [(used[i : i + COLUMNS], matrix[i : i + COLUMNS]) for i in range(0, len(used), COLUMNS)]
            left = left[~now]

    def scores(self, documents: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Whole scores, documents by items. doc, term, impact: the entries of a tile of documents; column: -1 for each term."""
        total = np.zeros((documents, len(self.items)), np.int64)
        for terms_, matrix in self.parts:
            column[terms_] = np.arange(len(terms_))
            at = column[term]
            column[terms_] = -1
            some = at >= 0
            dense = np.zeros((documents, len(terms_)))
            dense[doc[some], at[some]] = impact[some]
            total += (dense @ matrix).astype(np.int64)
        return total


def item_tiles(counts: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> list[Tile]:
    """counts: for each item its term numbers and how often each stands in it. weight: of each term, 0 for one without documents."""
    out = []
    for first in range(0, len(counts), ITEM_TILE):
        own = counts[first : first + ITEM_TILE]
        term = np.concatenate([t for t, _ in own])
        item = np.repeat(np.arange(first, first + len(own)), [len(t) for t, _ in own])
        value = np.concatenate([n for _, n in own]) * weight[term]
        some = value > 0
        if some.any():
            out.append(Tile(term[some], item[some], value[some]))
    return out


class Best:
    """The k best (score, id) of each item so far. Equal scores: the smaller id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.rows = k, np.ones(items, np.int64), None

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        new = pa.table({"item": item, "score": score, "id": ids})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
        item = rows["item"].to_numpy()
        first = np.searchsorted(item, item)
        self.rows = rows.filter(pa.array(np.arange(len(item)) - first < self.k))
        item, score = self.rows["item"].to_numpy(), self.rows["score"].to_numpy()
        last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == self.k - 1)
        self.least[item[last]] = score[last]


def _block_stats(docs: DataFrame, text: str, words: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, in how many documents each of the words stands)."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(held.value)}
        df, rows, total = np.zeros(len(number), np.int64), 0, 0
        for b in batches:
            for x in b.column(0).to_pylist():
                own = terms(x)
                rows, total = rows + bool(own), total + len(own)
                at = [number[w] for w in number.keys() & set(own)] if len(own) > len(number) else [i for w in set(own) if (i := number.get(w)) is not None]
                df[at] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[rows, total, df[some]])], ["term", "n"])

    # Spark adds a task's counts up before it sends them; no more rows than the block has words reach the driver.
    got = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 2, np.int64)
    out[got["term"].to_numpy() + 2] = got["n"].to_numpy()
    return int(out[0]), int(out[1]), out[2:]


def _search_block(docs: DataFrame, items: list[tuple], kinds: tuple[DataType, DataType], doc_id: str, text: str, k: int) -> DataFrame:
    """q (number of the item), item_id, doc_id, score: the k best of each task for each of the items (id, text)."""
    own = [terms(t) for _, t in items]
    words = sorted({w for x in own for w in x})
    number = {w: i for i, w in enumerate(words)}
    counts = [np.unique(np.array([number[w] for w in x], np.int64), return_counts=True) for x in own]
    rows, total, df = _block_stats(docs, text, words)
    weight = np.where(df > 0, np.floor(1000 * np.log((2 * rows + 2) / (2 * df + 1))), 0).astype(np.int64)
    known = docs.sparkSession.sparkContext.broadcast((words, item_tiles(counts, weight), [i for i, _ in items]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tiles, item_ids = known.value
        get, best = {w: i for i, w in enumerate(words)}.get, Best(len(item_ids), k)
        for b in batches:
            texts, first = b.column(1).to_pylist(), 0
            while first < len(texts):
                found, place, rate, n = [], [], [], 0
                while first + len(rate) < len(texts) and len(rate) < DOC_TILE and n < TILE_WORDS:
                    own = terms(texts[first + len(rate)])
                    got = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                    found.append(got := got[got >= 0])
                    place.append(np.full(len(got), len(rate)))
                    rate.append(75 + 25 * len(own) * rows // total if own else 1)
                    n += len(own)
                _tile_best(best, tiles, len(words), np.concatenate(found), np.concatenate(place), np.array(rate, np.int64), b.column(0).slice(first, len(rate)))
                first += len(rate)
        if best.rows is not None:
            q = best.rows["item"].to_numpy()
            made = [pa.array(q), pa.array([item_ids[i] for i in q.tolist()], like), best.rows["id"].combine_chunks(), best.rows["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in made], ["q", "item_id", "doc_id", "score"])

    like = to_arrow_type(kinds[0])
    schema = f"q long, item_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score long"
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(search, schema)


def _tile_best(best: Best, tiles: list[Tile], size: int, found: np.ndarray, place: np.ndarray, rate: np.ndarray, ids: pa.Array) -> None:
    """Scores a tile of documents. found: term numbers, document after document; place: the document of each."""
    key, tf = np.unique(place * size + found, return_counts=True)
    if not len(key):
        return
    doc, term = key // size, key % size
    impact = ((10**9 * tf) // (1000 * tf + 12 * rate[doc])).astype(float)
    column = np.full(size, -1)
    for t in tiles:
        score = t.scores(len(rate), doc, term, impact, column)
        row, col = np.nonzero(score >= best.least[t.items])
        if len(row):
            best.add(t.items[col], score[row, col], ids.take(pa.array(row)))


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k best of all docs for each item, those of score above 0 alone.

    Scores are whole numbers and exact. Equal scores go by ascending doc_id, null last; so results do not depend on how
    rows are dealt. Null and empty texts have no term: such documents are never found, such items have no rows. Rows of
    items that are equal in id and text count once; of equal id but different texts each has its own ranking. Repeated
    rows of docs are documents each. Texts may be of any length; only the named columns are read. Empty tables: no rows.
    Items go in blocks by hash, each with two passes over docs; a block's size is bounded, not the number of blocks.
    """
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.chars // BLOCK_CHARS))
    kinds = asked.schema["item_id"].dataType, docs.schema[doc_id].dataType
    out = None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else asked
        rows = [(r.item_id, r.text) for r in own.collect()]
        found = _search_block(docs, rows, kinds, doc_id, text, k).withColumn("block", F.lit(i))
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    meet = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MEET))
    some = out.withColumn("meet", meet).withColumn("rank", F.row_number().over(Window.partitionBy("block", "q", "meet").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "q").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
sized AS (SELECT r, doc_id, w, len(w) AS n FROM worded WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM sized) GROUP BY r, t),
items AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(w) AS t FROM items) GROUP BY q, t),
weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM tf, total WHERE t IN (SELECT t FROM asked) GROUP BY t),
scored AS (
  SELECT a.q, s.r, s.doc_id, sum(a.c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked a JOIN weight USING (t) JOIN tf USING (t) JOIN sized s USING (r), total
  GROUP BY a.q, s.r, s.doc_id),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 20
"""
