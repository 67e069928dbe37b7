"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index, vote by distance.

All words of all examples are terms. A term's weight is TF times IDF times its relevance, the share of the label's
variance that the word's presence explains (chi-square over the number of examples). Without relevance, some hundred
words of topic outweigh the few that the label is about; it drops no word and has no threshold. The votes' share is
calibrated on a fold of the examples by isotonic regression.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import fresh, in_fold, stored, table

#: The labelled sample: rows are picked by a hash of the id so that about so many, of so many characters, are taken at
#: most. These two bound the model, whatever the number of labels.
TRAIN_ROWS, TRAIN_CHARS = 6000, 24_000_000
#: Neighbours that vote, and examples in a block of the index.
NEIGHBOURS, BLOCK = 24, 64
#: Terms are summed at once until the others' largest weights make up less than the rest of this.
HEAD = 0.995
#: A term that more than one in so many examples has is also held as a whole column.
FREQUENT = 4
#: Words of texts that a task holds before it counts them.
COUNTED = 1_000_000
#: Marks that may stand around a word.
_MARKS = ".,;:!?()[]{}<>\"'#*$%&|-=+/"
#: One in so many examples is kept apart to calibrate on, with an index of the others.
CALIBRATE = 4
_words = re.compile(r"[^\W\d_]+").findall


def word_counts(text: str | None) -> Counter:
    return Counter(_words(text.lower())) if text else Counter()


def _begins(n: int, of: np.ndarray) -> np.ndarray:
    """Where each of n groups begins in an array sorted by group, and the end of the last."""
    return np.searchsorted(of, np.arange(n + 1))


def _gathered(begins: np.ndarray, groups: np.ndarray, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(the columns' entries of all the groups, one group after another; number of entries of each)."""
    n = begins[groups + 1] - begins[groups]
    at = np.arange(n.sum())
    at += np.repeat(begins[groups] - (np.cumsum(n) - n), n)
    return [c.take(at) for c in columns], n


class Numbers(dict):
    """What blanks part in a lower-cased text, by the numbers of its words that are known; kept for what was seen last."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.known = {w: i for i, w in enumerate(words)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        i = self.known.get(token)
        if i is None and (bare := token.strip(_MARKS)).isalpha():  # one word between marks: what the pattern would find
            i = self.known.get(bare)
            got = () if i is None else (i,)
        elif i is None:
            got = tuple(i for w in _words(token) if (i := self.known.get(w)) is not None)
        else:
            got = (i,)
        self[token] = got
        return got

    def of(self, tokens: Iterable[str]) -> Iterator[int]:
        """The numbers of the known words of tokens, in order."""
        return chain.from_iterable(map(self.__getitem__, tokens))


class Examples:
    """Word counts of examples as arrays: word numbers and counts of one after another, and for how many rows each
    stands, how many of these toxic. words: the distinct words, an Arrow array."""

    def __init__(self, words: pa.Array, begins: np.ndarray, word: np.ndarray, n: np.ndarray, copies: np.ndarray, toxic: np.ndarray):
        self.words, self.begins, self.word, self.n, self.copies, self.toxic = words, begins, word, n, copies, toxic

    @classmethod
    def of(cls, words: pa.ListArray, n: pa.ListArray, copies: np.ndarray, toxic: np.ndarray) -> Examples:
        coded = pa.compute.dictionary_encode(words.flatten())
        begins = np.r_[0, np.cumsum(pa.compute.list_value_length(words).to_numpy(zero_copy_only=False))].astype(np.int64)
        return cls(coded.dictionary, begins, coded.indices.to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float), copies, toxic)

    def where(self, some: np.ndarray) -> Examples:
        size = np.diff(self.begins)
        inside = np.repeat(some, size)
        return Examples(self.words, np.r_[0, np.cumsum(size[some])], self.word[inside], self.n[inside], self.copies[some], self.toxic[some])

    def counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begins[i : i + 2]
        return self.word[a:b], self.n[a:b]


class BlockMaxIndex:
    """Unit vectors of labelled examples by term, with the largest weight of each term in each block of examples.

    A query first sums the postings of the terms that can add most. What its other terms can add is bounded for each
    block by their largest weights there; only examples whose sum and bound reach the k-th best sum are scored in full.
    So the k nearest are exact. df: in how many of `total` rows each word stands.
    """

    def __init__(self, examples: Examples, df: np.ndarray, total: int, k: int = NEIGHBOURS):
        copies, toxic, n, size = examples.copies, examples.toxic, len(examples.copies), len(examples.words)
        self.k, self.base, self.words, self.terms = k, float((toxic.sum() + 1) / (copies.sum() + 2)), examples.words, None
        # Each distinct text counts once here, else one text of many copies would make its own words tell.
        of = np.repeat(np.arange(n), np.diff(examples.begins))
        has = np.bincount(examples.word, minlength=size).astype(float)
        bad, n1 = np.bincount(examples.word, (toxic > 0)[of], size), float((toxic > 0).sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            relevance = np.nan_to_num((bad * n - has * n1) ** 2 / (has * (n - has) * n1 * (n - n1)), posinf=0.0)
        # A word that tells nothing still counts a little; one that no example has changes all cosines alike, and is left out.
        self.weight = np.where(has > 0, (np.log((1 + total) / (1 + df)) + 1) * (relevance + 1e-6), 0.0)
        value = (1 + np.log(examples.n)) * self.weight[examples.word]
        value /= np.sqrt(np.bincount(of, value**2, n))[of]
        # Examples with like terms come together, so that a block's largest weights say much.
        order = np.lexsort((examples.word, -value, of))
        place_in, first = np.arange(len(of)) - np.repeat(examples.begins[:-1], np.diff(examples.begins)), np.full((3, n), -1)
        for j in range(3):
            first[j, of[order][place_in == j]] = examples.word[order][place_in == j]
        self.example = np.lexsort((np.arange(n), *first[::-1]))
        some = np.diff(examples.begins) > 0
        self.none = float((toxic[~some].sum() + self.base) / (copies[~some].sum() + 1))
        self.example = self.example[some[self.example]]
        self.copies, self.toxic = copies[self.example].astype(float), toxic[self.example].astype(float)
        # By example, then by term, then by term and block.
        rank = np.zeros(n, np.int64)
        rank[self.example] = np.arange(len(self.example))
        order = np.lexsort((examples.word, rank[of]))
        self.of, self.value, place = examples.word[order], value[order], rank[of][order]
        self.begins = _begins(len(self.example), place)
        order = np.lexsort((place, self.of))
        self.place, self.posted, term = place[order], self.value[order], self.of[order]
        self.term_begins = _begins(size, term)
        often = np.flatnonzero(np.diff(self.term_begins) > len(self.example) / FREQUENT)
        self.column, self.columns = np.full(size, -1), np.zeros((len(often), len(self.example)))
        self.column[often] = np.arange(len(often))
        dense = self.column[term] >= 0
        self.columns[self.column[term[dense]], self.place[dense]] = self.posted[dense]
        block = self.place // BLOCK
        start = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)]) if len(term) else np.zeros(0, np.int64)
        self.block, self.largest = block[start], np.maximum.reduceat(self.posted, start) if len(start) else np.zeros(0)
        self.block_begins = _begins(size, term[start])
        self.top = np.zeros(size)
        np.maximum.at(self.top, self.of, self.value)
        self.blocks, self.query = -(-len(self.example) // BLOCK), np.zeros(size)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit weights) of a text."""
        if self.terms is None:
            self.terms = Numbers(self.words.to_pylist())
        numbers = self.terms
        own = np.fromiter(numbers.of(text.lower().split() if text else ()), np.int64)
        return self.unit(*np.unique(own, return_counts=True))

    def unit(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(n)) * self.weight[at]
        size = np.sqrt(weight @ weight)
        some = weight > 0
        return (at[some], weight[some] / size) if size else (at[:0], weight[:0])

    def nearest(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, cosine) of the k nearest examples of positive cosine; ties go to the lower place."""
        most = weight * self.top[at]
        order = np.argsort(-most, kind="stable")
        total = np.cumsum(most[order])
        head = np.searchsorted(total, HEAD * total[-1]) + 1
        first, rest = order[:head], order[head:]
        column = self.column[at[first]]
        some = first[column < 0]
        place, n = _gathered(self.term_begins, at[some], self.place, self.posted)
        score = np.bincount(place[0], np.repeat(weight[some], n) * place[1], len(self.example)).astype(float)
        for c, w in zip(column[column >= 0].tolist(), weight[first[column >= 0]].tolist(), strict=True):
            score += w * self.columns[c]
        block, n = _gathered(self.block_begins, at[rest], self.block, self.largest)
        bound = score + np.repeat(np.bincount(block[0], np.repeat(weight[rest], n) * block[1], self.blocks), BLOCK)[: len(score)]
        best = np.partition(score, -self.k)[-self.k] if len(score) > self.k else 0.0
        able = np.flatnonzero(bound >= max(best - 1e-12, 1e-300))
        if not len(able):
            return able, np.zeros(0)
        # The examples that can be among the nearest, in full.
        self.query[at] = weight
        (of, value), n = _gathered(self.begins, able, self.of, self.value)
        cosine = np.add.reduceat(self.query.take(of) * value, np.cumsum(n) - n)
        self.query[at] = 0.0
        able, cosine = able[cosine > 0], cosine[cosine > 0]
        order = np.lexsort((able, -cosine.round(12)))[: self.k]
        return able[order], cosine[order]

    def votes(self, at: np.ndarray, weight: np.ndarray) -> tuple[float, list[int]]:
        """(toxic share of the votes, each weighted by its squared cosine, with half a vote at the base rate; neighbours)."""
        if not len(at):
            return self.none, []
        place, cosine = self.nearest(at, weight)
        near = cosine**2
        share = (near * self.toxic[place]).sum() + 0.5 * self.base
        return float(share / ((near * self.copies[place]).sum() + 0.5)), self.example[place].tolist()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """(knots, values): the rising step function nearest to y over x, by pooling neighbours; each step's rate is drawn to
    `base` by one row. Between steps the values are interpolated."""
    pools: list[list[float]] = []  # sum of w * y, sum of w, sum of w * x
    order = np.lexsort((y, x))
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([b * c, c, a * c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    values = np.array([(p[0] + base) / (p[1] + 1) for p in pools])
    return np.array([p[2] / p[1] for p in pools]), np.maximum.accumulate(values)


class Model:
    """The index, the ids of its examples, and what share of votes stands for which probability."""

    def __init__(self, index: BlockMaxIndex, ids: list, knots: np.ndarray, values: np.ndarray):
        self.index, self.ids, self.knots, self.values = index, ids, knots, values

    def judge(self, text: str | None) -> tuple[float, list]:
        share, near = self.index.votes(*self.index.vector(text))
        score = float(np.interp(share, self.knots, self.values)) if len(self.knots) else share
        return min(max(score, 0.0), 1.0), [self.ids[i] for i in near]


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int, chars: int) -> pa.Table:
    """id, copies, toxic, word, n of the labelled rows, one row for each distinct sequence of words, by id."""
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    named = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # Labels meet ids and lengths; texts stay where they are, and meet the sample's ids, of which there are about `rows` at most.
    sized = stored(named.select("id", F.length("text").alias("chars")).join(own.withColumnRenamed(doc_id, "id"), "id"), "toxic-sizes")
    size = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    share = min(1.0, rows / max(size.n, 1), chars / max(size.chars, 1))
    ids = sized.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("id", "label").distinct()
    picked = named.join(F.broadcast(ids), "id")

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [word_counts(x) for x in texts]
            same = [xxhash.xxh3_128_hexdigest(" ".join(_words((x or "").lower()))) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(same, pa.string()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["id", "label", "same", "word", "n"])

    kind = picked.schema["id"].dataType.simpleString()
    condensed = picked.select("id", "text", "label").mapInArrow(condense, f"id {kind}, label int, same string, word array<string>, n array<int>")
    one = condensed.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.sum("label").alias("toxic"), F.first(F.struct("word", "n")).alias("x"))
    return stored(one.select("id", "copies", "toxic", "x.*"), "toxic-sample").toArrow().sort_by("id").combine_chunks()


def _frequencies(docs: DataFrame, text: str, words: pa.Array) -> tuple[np.ndarray, int]:
    """(in how many rows of docs each of the words stands, rows)."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, df, rows, found = Numbers(held.value.to_pylist()), np.zeros(len(held.value), np.int64), 0, array("q")
        for b in batches:
            texts = b.column(0).to_pylist()
            for x in texts:
                if x:
                    found.extend(set(numbers.of(set(x.lower().split()))))
                if len(found) > COUNTED:
                    df += np.bincount(found, minlength=len(df))
                    found = array("q")
            rows += len(texts)
        df += np.bincount(found, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[rows, df[some]])], ["word", "n"])

    # Words go as numbers, and Spark adds their counts up in each task and then by word: no group holds what all tasks have.
    got = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 1, np.int64)
    out[got["word"].to_numpy() + 1] = got["n"].to_numpy()
    return out[1:], int(out[0])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, doc_counts: DataFrame | None = None) -> Model:
    """An index of about `rows` labelled rows at most; labels must hold training rows alone.

    Rows whose words are the same sequence are one example that votes as often as it has rows. Document frequencies are
    counted over all rows of doc_counts (docs unless given), for the examples' words: no other can match.
    """
    got = _sample(docs, labels, doc_id, text, label, rows, chars)
    ids, flat = got["id"].to_pylist(), lambda c: got[c].combine_chunks() if len(got) else pa.array([], got.schema.field(c).type)
    examples = Examples.of(flat("word"), flat("n"), flat("copies").to_numpy(), flat("toxic").to_numpy())
    df, total = _frequencies(docs if doc_counts is None else doc_counts, text, examples.words)
    index = BlockMaxIndex(examples, df, total)
    # A fold of the examples is scored with an index of the others, to learn what share of votes means what.
    fold = np.array([xxhash.xxh3_64_intdigest(str(i)) % CALIBRATE == 0 for i in ids], bool)
    knots = values = np.zeros(0)
    if fold.any() and not fold.all():
        part, apart = BlockMaxIndex(examples.where(~fold), df, total), examples.where(fold)
        share = np.array([part.votes(*part.unit(*apart.counts(i)))[0] for i in range(int(fold.sum()))])
        knots, values = isotonic(share, apart.toxic / apart.copies, np.ones(len(share)), index.base)
    return Model(index, ids, knots, values)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.3) -> DataFrame:
    """docs with score, predicted and evidence (the ids of the neighbours, nearest first), from the whole text alone.

    Null and empty texts, and texts without a word of any example, score as the examples without words do, at the base
    rate if there are none. Examples of equal cosine come in a fixed order; a score of just `cut` is predicted. Repeated
    rows score alike; an empty table gives no rows; columns named score, predicted or evidence are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (made,) = fresh(docs.columns, "made")

    @F.pandas_udf("score double, evidence array<string>")
    def judge(t: pd.Series) -> pd.DataFrame:
        got = [shared.value.judge(x if isinstance(x, str) else None) for x in t]
        return pd.DataFrame({"score": [s for s, _ in got], "evidence": pd.Series([[str(i) for i in e] for _, e in got], dtype=object)})

    out = docs.withColumn(made, judge(f"`{text}`"))
    out = out.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted", "evidence")])
    got = F.col(made)
    return out.withColumns({"score": got["score"], "evidence": got["evidence"], "predicted": (got["score"] >= cut).cast("int")}).drop(made)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id")))
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
