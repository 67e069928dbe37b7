"""Language ID: bit-sliced Bloom filters tell at once which languages contain an n-gram; corrected popcounts decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import fresh, in_fold, table

#: Letters in an n-gram, code points handled at once, least slots of the filter (a mask of languages each), probes.
N, BLOCK, SLOTS, PROBES = 4, 400_000, 1 << 20, 3
#: Slots of the filter for each n-gram of the language that has most.
SPARSE = 16
#: Labelled rows of each language from which filters are fitted, and the code points in them, which bound the model; and how
#: frequent in a language an n-gram must be at least, against the language in which it is most frequent.
TRAIN_ROWS, TRAIN_CHARS, LEAST_SHARE = 4000, 16_000_000, 0.2
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each window of N code points that has no gap inside a word.

    codes are lower-case letters, 0 for all else; a window may begin or end at a word's edge.
    """
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(codes) - N + 1
    ok = np.ones(m, bool)
    for i in range(1, N - 1):
        ok &= codes[i : i + m] > 0
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for i in range(N):
        h = h * np.uint64(0x100000001B3) + codes[at + i] + np.uint64(1)
    return _mix(h), at


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, index of the text) over all texts whole, a bounded number of code points at a time.

    Long texts are cut with N - 1 code points of overlap, so that each window comes once.
    """
    table, held, who, size = _letters(), [], [], 0
    for i, text in enumerate(texts):
        t = text or ""
        for a in range(0, len(t), BLOCK):
            part = t[max(0, a - N + 1) : a + BLOCK] if a else " " + t[:BLOCK]
            if a + BLOCK >= len(t):
                part += " "
            held.append(part)
            who.append(i)
            size += len(part)
            if size >= BLOCK:
                yield _hashed(table, held, who)
                held, who, size = [], [], 0
    if held:
        yield _hashed(table, held, who)


def _hashed(table: np.ndarray, held: list[str], who: list[int]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    codes = table[np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    h, at = ngrams(codes)
    owner = np.repeat(np.arange(len(held)), sizes)
    mine = owner[at] == owner[np.minimum(at + N - 1, len(owner) - 1)]  # no window over two texts
    return h[mine], np.asarray(who, np.int64)[owner[at[mine]]]


class LanguageFilters:
    """Slot i holds a mask: bit l is bit i of the Bloom filter of language l. All filters share the probes."""

    def __init__(self, grams: dict[str, np.ndarray], slots: int = SLOTS):
        self.langs, self.slots = sorted(grams), np.uint64(slots - 1)
        words = max(1, -(-len(self.langs) // 8))
        self.mask = np.zeros((slots, words), np.uint8)
        for l, lang in enumerate(self.langs):
            for p in self.places(np.asarray(grams[lang], np.uint64)):
                self.mask[p, l >> 3] |= np.uint8(1 << (l & 7))
        fill = np.array([(self.mask[:, l >> 3] >> (l & 7) & 1).mean() for l in range(len(self.langs))])
        self.false_rate = fill**PROBES

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & self.slots).astype(np.int64) for i in range(PROBES)]

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The mask of the languages that contain each n-gram."""
        first, *rest = self.places(h)
        out = self.mask[first]
        for p in rest:
            out &= self.mask[p]
        return out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, share of them estimated to be in each language) of each text."""
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for h, who in blocks(texts):
            n += np.bincount(who, minlength=len(texts))
            got = self.containing(h)
            for l in range(len(self.langs)):
                hits[:, l] += np.bincount(who[(got[:, l >> 3] >> (l & 7) & 1).astype(bool)], minlength=len(texts))
        f = self.false_rate
        return n, np.clip((hits / np.maximum(n, 1)[:, None] - f) / (1 - f), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, share = self.scores(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, total = share.argmax(1), share.sum(1)
        score = np.divide(share.max(1), total, out=np.zeros(len(texts)), where=total > 0)
        letters = _letters()
        some = n > 0
        for i in np.flatnonzero(~some):
            some[i] = any(letters[ord(c)] for c in texts[i] or "")
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def train(docs: DataFrame, doc_id: str, text: str, lang: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> LanguageFilters:
    """Filters for each lang, from about `rows` rows and `chars` code points of each at most, picked by a hash of the id.

    Of an n-gram a language's filter holds those at least LEAST_SHARE times as frequent in it as in the language
    that has them most, seen three times or more, all of them: the sample bounds their number, and the slots are as many
    as they need. So passages in a second language inside a text do little harm.
    """
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sums = own.groupBy(lang).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    sizes = {r[0]: min(1.0, rows / r.n, chars / max(r.chars, 1)) for r in sums.collect()}  # a row for each language
    if not sizes:
        return LanguageFilters({})
    share = F.try_element_at(F.create_map(*[F.lit(x) for k, part in sizes.items() for x in (k, part)]), F.col(lang))
    picked = own.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < share * (1 << 20)).select(lang, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            texts = b.column(1).to_pylist()
            for l in sorted(set(langs)):
                parts = [np.unique(h, return_counts=True) for h, _ in blocks([t for t, x in zip(texts, langs, strict=True) if x == l])]
                if parts:
                    h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = rate.join(top, "gram").where((F.col("n") >= 3) & (F.col("rate") >= LEAST_SHARE * F.col("top")))
    got = chosen.select("lang", "gram").toPandas()
    grams = {l: np.zeros(0, np.uint64) for l in sizes}
    for l, f in got.groupby("lang"):
        grams[l] = f["gram"].to_numpy(np.int64).view(np.uint64)
    most = max(map(len, grams.values()))
    return LanguageFilters(grams, max(SLOTS, 1 << (SPARSE * most).bit_length()))


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the whole text alone.

    Null texts and texts without a letter: `und`, 0. Texts with letters but no n-gram that a filter holds: the
    first language by name, 0; ties go to the first by name too. Repeated rows get the same answer each; columns
    named lang_pred or score are replaced, others stay.
    """
    (made,) = fresh(docs.columns, "made")

    @F.pandas_udf("lang_pred string, score double")
    def guess(t: pd.Series) -> pd.DataFrame:
        lang, score = model.predict([x if isinstance(x, str) else None for x in t])
        return pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": score})

    out = docs.withColumn(made, guess(f"`{text}`")).drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    return out.withColumns({"lang_pred": F.col(f"{made}.lang_pred"), "score": F.col(f"{made}.score")}).drop(made)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~in_fold(F.col("doc_id"))), "doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
