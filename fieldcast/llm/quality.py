"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust each, the posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import fresh, map_arrow, stored, table

SYMBOLS = b"#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, 2, 0
#: Name, and the vote of each rule; x is the dict of feature arrays of measure().
RULES = {
    "symbol_words": lambda x: _vote(x["n_symbols"] > 0.25 * x["n_words"], x["n_symbols"] <= 0.02 * x["n_words"]),
    "symbol_chars": lambda x: _vote(x["n_symbols"] > 0.06 * x["word_chars"], None),
    "shouting": lambda x: _vote((x["n_upper"] > 0.5 * x["n_letters"]) & (x["n_letters"] >= 20), x["n_upper"] <= 0.2 * x["n_letters"]),
    "exclaiming": lambda x: _vote(x["n_exclaims"] > 0.2 * x["n_words"], None),
    "repeating": lambda x: _vote(x["n_repeat_words"] > 0.35 * x["n_words"], x["n_repeat_words"] <= 0.25 * x["n_words"]),
    "one_word": lambda x: _vote((x["top_word"] > 0.25 * x["n_words"]) & (x["n_words"] >= 20), x["top_word"] <= 0.15 * x["n_words"]),
    "repeated_lines": lambda x: _vote((x["n_dup_lines"] > 0.3 * x["n_lines"]) & (x["n_lines"] >= 6), None),
    "sentences": lambda x: _vote((x["n_stops"] == 0) & (x["n_words"] >= 50), x["n_stops"] * 40 >= x["n_words"]),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*BASE, "n_letters", "n_upper", "n_exclaims", "n_stops", "top_word", "n_lines")


def _vote(bad: np.ndarray, good: np.ndarray | None) -> np.ndarray:
    out = np.where(bad, BAD, ABSTAIN)
    return out if good is None else np.where(~bad & good, GOOD, out)


def features(text: str | None) -> tuple[int, ...]:
    """FEATURES of one whole text. Words are runs of [^\\x20\\x09-\\x0D]; null or empty text has none."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at just these six characters
    n, number = len(words), {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = 0
    if n >= 3:
        v = len(number)
        if v < 2_000_000:
            window = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # too many words for one number: pairs are numbered first
            window = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(n + 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        first = twice[:n]
        covered = first.copy()
        covered[1:] |= first[:-1]
        covered[2:] |= first[:-2]
        repeats = int(covered.sum())
    lines = text.split("\n")
    with_words = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(count[[9, 10, 11, 12, 13, 32]].sum())
    upper = sum(map(str.isupper, text)) if count[0x80:].any() else int(count[65:91].sum())
    letters = sum(map(str.isalpha, text)) if count[0x80:].any() else int(count[65:91].sum() + count[97:123].sum())
    return (
        n, len(text) - spaces, int(count[list(SYMBOLS)].sum()), len(with_words) - len(set(with_words)), repeats,
        letters, upper, int(count[33]), int(count[[46, 63]].sum()), int(np.bincount(ids).max()) if n else 0, len(lines),
    )


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    got = np.array([features(t) for t in texts], np.int64).reshape(-1, len(FEATURES))
    return dict(zip(FEATURES, got.T, strict=True))


def votes(x: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each text as one number, a digit of base 3 for each rule."""
    code = np.zeros(len(x["n_words"]), np.int64)
    for rule in RULES.values():
        code = code * 3 + rule(x)
    return code


def base_failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM over vote patterns with their counts: the share of good texts and, for each rule, class and vote, its probability.

    Votes are independent given the class. The start trusts each vote at 0.9, and a Dirichlet prior of one
    pseudo-count a cell keeps every probability over zero.
    """
    seen = (codes[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1)) % 3
    n_bad, n_good = (seen == BAD).sum(1), (seen == GOOD).sum(1)
    post = 1 / (1 + 9.0 ** (2.0 * n_bad - 0.5 * n_good))  # of good
    share, p = 0.5, np.full((len(RULES), 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * post, counts * (1 - post)])
        new_share = (weight[0].sum() + 1) / (counts.sum() + 2)
        for j in range(len(RULES)):
            for c in range(2):
                got = np.bincount(seen[:, j], weight[c], 3) + 1
                p[j, c] = got / got.sum()
        post = posterior(codes, new_share, p)
        done, share = abs(new_share - share) < 1e-9, new_share
        if done:
            break
    return float(share), p


def posterior(codes: np.ndarray, share: float, p: np.ndarray) -> np.ndarray:
    """The probability that a text with this vote pattern is good."""
    seen = (codes[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1)) % 3
    log = np.log([[share, 1 - share]]) + sum(np.log(p[j][:, seen[:, j]]).T for j in range(len(RULES)))
    return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -700, 700)))


def _pattern_counts(docs: DataFrame, code: str) -> DataFrame:
    """(code, n): at most 3 ** len(RULES) rows, whatever the corpus."""
    return docs.groupBy(code).agg(F.count("*").alias("n"))


def _fitted(patterns: DataFrame, code: str) -> tuple[float, np.ndarray]:
    got = patterns.toPandas()
    return fit(got[code].to_numpy(np.int64), got["n"].to_numpy(float)) if len(got) else (0.5, np.full((len(RULES), 2, 3), 1 / 3))


def score_documents(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys of docs, FEATURES, votes code, base_failed, p_good and the verdict kept.

    Every row counts once in the EM, copies too. Null and empty texts have no words and so fail the base rules.
    A table without rows gives no rows. Only `keys` and `text` are read, so other columns may have any name.
    """
    kinds = docs.schema
    schema = ", ".join(f"`{k}` {kinds[k].dataType.simpleString()}" for k in keys)
    schema += "".join(f", {f} long" for f in FEATURES) + ", code long, base_failed boolean"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = measure(b.column(len(keys)).to_pylist())
            made = [pa.array(x[f]) for f in FEATURES] + [pa.array(votes(x)), pa.array(base_failed(x))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keys))] + made, [*keys, *FEATURES, "code", "base_failed"])

    measured = stored(docs.select(*keys, text).mapInArrow(task, schema), "quality")
    share, p = _fitted(_pattern_counts(measured, "code"), "code")

    @F.pandas_udf("double")
    def good(code):
        import pandas as pd

        return pd.Series(posterior(code.to_numpy(np.int64), share, p))

    return measured.withColumn("p_good", good("code")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and whose posterior quality is 0.5 or more, with all their columns.

    The texts are measured twice, once for the EM and once for the decision: rows need no key, and nothing of
    the size of the texts is shuffled or kept.
    """
    code, failed = fresh(docs.columns, "code", "base_failed")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(RULES), np.int64)
        for b in batches:
            total += np.bincount(votes(measure(b.column(0).to_pylist())), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    share, p = _fitted(counted, "code")
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = measure(b.column(at).to_pylist())
            ok = ~base_failed(x)
            ok[ok] &= posterior(votes(x)[ok], share, p) >= 0.5
            yield b.filter(pa.array(ok))

    return map_arrow(docs, keep, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, ["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "p_good")
