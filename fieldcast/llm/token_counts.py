"""Token counts: pieces are counted once for each distinct pre-token, and joined to the documents' pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import stored, table

#: A pre-token that makes up over 1 / HEAVY of all occurrences is heavy: so there are at most HEAVY of them.
HEAVY = 400_000
#: Distinct pre-tokens that a task holds before it passes their counts on.
FLUSH = 400_000


class PreTokenizer:
    """Splits a text as the byte-level BPE file does, special strings apart; knows the pre-tokens that are one token."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        letter = {v: k for k, v in _byte_letters().items()}
        own = [bytes(letter[c] for c in v) for v in self.tokenizer.get_vocab(with_added_tokens=False) if all(c in letter for c in v)]
        words = [w.decode() for w in own if _is_text(w)]
        self.known = {w: 1 for w, n in zip(words, self.count(words), strict=True) if n == 1 and self.find(w) == [w]}

    def count(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def pieces(self, text: str) -> tuple[int, Counter]:
        """(special tokens, frequency of each pre-token)."""
        if self.special is None:
            return 0, Counter(self.find(text))
        first, *rest = self.special.split(text)
        got = Counter(self.find(first))
        for part in rest:
            got.update(self.find(part))
        return len(rest), got


def _byte_letters() -> dict[int, str]:
    """The printable letter by which the file's format names each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_held: dict[str, PreTokenizer] = {}


def pre_tokenizer(path: str) -> PreTokenizer:
    """One for each Python worker."""
    if path not in _held:
        _held[path] = PreTokenizer(path)
    return _held[path]


def piece_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """(piece, freq, n_tokens) of every distinct pre-token that is not itself one token."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pre_tokenizer(path)
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    total.update(t.pieces(x)[1])
                if len(total) > FLUSH:
                    yield from _counted(total, t)
                    total = Counter()
        yield from _counted(total, t)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pre_tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t.count(b.column(0).to_pylist()), pa.int64())], ["piece", "freq", "n_tokens"])

    once = docs.select(text).mapInArrow(frequencies, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return once.mapInArrow(tokens, "piece string, freq long, n_tokens long")


def _counted(total: Counter, t: PreTokenizer) -> Iterator[pa.RecordBatch]:
    rest = {w: n for w, n in total.items() if w not in t.known}
    words = list(rest)
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([rest[w] for w in part], pa.int64())], ["piece", "freq"])


def count_tokens(docs: DataFrame, keys: list[str], path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """keys of docs, n_bytes, n_tokens (long) and over_limit, for each row of docs.

    path: a byte-level BPE file of the tokenizers library. Tokens are those of the library without added special
    tokens; special strings inside a text count as one each. Null and empty texts have 0 bytes and 0 tokens.
    Repeated rows are counted each, even when keys are null or equal. Only keys and text are read, so other columns
    may have any name. No ids are made for a document: BPE runs once for each distinct pre-token of the corpus.
    Heavy pre-tokens (at most HEAVY, by their definition) are broadcast with their counts and summed where the text
    is read; the others, none of them hot, are joined.
    """
    spark = docs.sparkSession
    pieces = stored(piece_table(docs, text, path), "pieces")
    total = pieces.agg(F.sum("freq")).first()[0] or 0
    heavy = pieces.where(F.col("freq") > total / HEAVY)
    rest = pieces.where(F.col("freq") <= total / HEAVY).select("piece", "n_tokens")
    known = spark.sparkContext.broadcast({r.piece: r.n_tokens for r in heavy.select("piece", "n_tokens").collect()} if total else {})

    kinds = {k: docs.schema[k].dataType.simpleString() for k in keys}
    schema = "piece string, freq long, uid long, n_bytes long" + "".join(f", `k{i}` {kinds[k]}" for i, k in enumerate(keys))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, uid = pre_tokenizer(path), TaskContext.get().partitionId() << 40
        one, more = t.known, known.value
        for b in batches:
            rows = b.num_rows
            texts, first = b.column(len(keys)).to_pylist(), 0
            while first < rows:
                word, freq, who, sums, sizes, at = [], [], [], [], [], first
                while at < rows and len(word) < FLUSH:
                    x = texts[at] or ""
                    done, got = t.pieces(x)
                    for w, n in got.items():
                        c = one.get(w) or more.get(w)
                        if c:
                            done += c * n
                        else:
                            word.append(w)
                            freq.append(n)
                            who.append(uid)
                    sums.append(done)
                    sizes.append(len(x.encode("utf-8", "surrogatepass")))
                    uid += 1
                    at += 1
                # A row for the document itself: its piece is one that no text has, and its freq is what is summed here.
                own = list(range(uid - len(sums), uid))
                columns = [pa.array(word + [f"\0{u}" for u in own], pa.string()), pa.array(freq + sums, pa.int64()), pa.array(who + own, pa.int64()), pa.array([None] * len(word) + sizes, pa.int64())]
                for i in range(len(keys)):
                    part = b.column(i).slice(first, len(own))
                    columns.append(pa.concat_arrays([pa.nulls(len(word), part.type), part]))
                yield pa.RecordBatch.from_arrays(columns, ["piece", "freq", "uid", "n_bytes", *(f"k{i}" for i in range(len(keys)))])
                first = at

    rows = docs.select(*keys, text).mapInArrow(split, schema)
    each = F.coalesce("n_tokens", F.raise_error(F.lit("a pre-token without a count")).cast("long"))
    n = F.when(F.col("n_bytes").isNotNull(), F.col("freq")).otherwise(F.col("freq") * each)
    sums = (
        rows.join(rest, "piece", "left")
        .groupBy("uid")
        .agg(F.sum(n).alias("n_tokens"), F.max("n_bytes").alias("n_bytes"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    )
    return sums.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
