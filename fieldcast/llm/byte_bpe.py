"""Byte-level BPE by a table over prefixes: each byte prefix of a text has one valid last token.

Two tokens fit if the merges turn their joined bytes into just these two. A sequence is an encoding exactly if all its
neighbours fit, so a prefix's last token is the one that ends there and fits the last token of the prefix before it;
no other does. Walking back from the end over last tokens gives the ids. As the table of a prefix never changes when
bytes are added, it is all that an append needs, and an edit is encoded anew only until the table agrees with the old one.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from fieldcast.llm.common import map_arrow, table

IDS = ArrayType(IntegerType())
#: Entries that a worker keeps of each cache; a full cache is emptied, which changes no result.
KEPT = 400_000
#: Bytes of text that are encoded before their rows go on.
ROWS_OF = 4_000_000
#: Bytes of a match of the pattern up to which only the prefixes are worked out that are asked for.
SHORT = 64
#: A match of the pattern that ends so many characters before an edit, or more, stays: no alternative looks further ahead.
AHEAD = 2


class PrefixCoder:
    """Tokens of a rank file, and last tokens of the prefixes of byte strings."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.words = {i: w for w, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        # Which lengths the tokens have that end with the same three bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for w in self.ranks:
            ends.setdefault(w[-3:], set()).add(len(w))
        self.lengths = {three: sorted(n, reverse=True) for three, n in ends.items() if len(three) == 3}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of a short byte string by the merges themselves: the lowest rank first, from the left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow a; a is -1 at the beginning."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(self.words.get(a, b"") + self.words[b]) == ([b] if a < 0 else [a, b])
        return got

    def last_token(self, raw: bytes, last: list[int], end: int) -> int:
        """The last token of raw[:end], by those of the shorter prefixes."""
        rank, pairs = self.ranks.get, self.pairs
        for n in self.lengths.get(raw[end - 3 : end], ()) if end > 2 else ():
            if n <= end and (t := rank(raw[end - n : end])) is not None:
                a = last[end - n - 1] if n < end else -1
                ok = pairs.get((a, t))
                if ok or ok is None and self.fits(a, t):
                    return t
        if end > 1 and (t := rank(raw[end - 2 : end])) is not None and self.fits(last[end - 3] if end > 2 else -1, t):
            return t
        return self.ranks[raw[end - 1 : end]]

    def last_of(self, raw: bytes, end: int, seen: dict[int, int]) -> int:
        """last_token(), with only those shorter prefixes worked out that it asks for. seen: prefixes known already."""
        rank, pairs = self.ranks.get, self.pairs
        for n in [*(self.lengths.get(raw[end - 3 : end], ()) if end > 2 else ()), 2]:
            if n <= end and (t := rank(raw[end - n : end])) is not None:
                at = end - n
                a = -1 if not at else seen[at] if at in seen else self.last_of(raw, at, seen)
                ok = pairs.get((a, t))
                if ok or ok is None and self.fits(a, t):
                    break
        else:
            t = self.ranks[raw[end - 1 : end]]
        seen[end] = t
        return t

    def ids(self, raw: bytes) -> list[int]:
        """The ids of a match of the pattern. A short one needs but few of its prefixes; a long one gets the whole table."""
        if len(raw) > SHORT:
            return self.back(self.last_tokens(raw))
        seen, at, out = {}, len(raw), []
        while at:
            out.append(seen[at] if at in seen else self.last_of(raw, at, seen))
            at -= len(self.words[out[-1]])
        return out[::-1]

    def last_tokens(self, raw: bytes, known: Iterable[int] = (), tail: list[int] | None = None) -> list[int]:
        """The last token of each prefix. known: those of the first prefixes, where they are known already. tail: those that
        the prefixes ending in the last len(tail) bytes had before an edit of what comes earlier; where as many of them
        in turn as the longest token has bytes are as before, so are the rest."""
        last, old, same = list(known), tail or [], 0
        for end in range(len(last) + 1, len(raw) + 1):
            last.append(self.last_token(raw, last, end))
            at = end - 1 - (len(raw) - len(old))
            same = same + 1 if at >= 0 and old[at] == last[-1] else 0
            if same >= self.longest:
                return last + old[at + 1 :]
        return last

    def back(self, last: list[int]) -> list[int]:
        """The ids of a text whose prefixes have these last tokens."""
        at, ids = len(last), []
        while at:
            ids.append(last[at - 1])
            at -= len(self.words[ids[-1]])
        return ids[::-1]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian numbers of four bytes. Each distinct match of the pattern goes through the table once."""
        found = self.pattern.findall(text) if text else []
        try:
            return b"".join(map(self.pieces.__getitem__, found))
        except KeyError:
            if len(self.pieces) > KEPT:
                self.pieces.clear()
            for piece in set(found).difference(self.pieces):
                self.pieces[piece] = np.array(self.ids(piece.encode()), "<u4").tobytes()
            return b"".join(map(self.pieces.__getitem__, found))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def prefixes(self, text: str | None) -> tuple[list[int], list[int]]:
        """(where each match of the pattern ends, in characters; the last token of each byte prefix)."""
        cuts, last = [], []
        for m in self.pattern.finditer(text or ""):
            cuts.append(m.end())
            last += self.last_tokens(m[0].encode())
        return cuts, last

    def edited(self, text: str, cuts: list[int], last: list[int], begin: int, end: int, new: str) -> tuple[str, list[int], list[int]]:
        """prefixes() of the text with new in place of text[begin:end], and this text. Matches before the edit stay; from
        there on matches are made until one ends where one ended before. In the first and the last of these, prefixes
        keep the tokens they have."""
        out, grown = text[:begin] + new + text[end:], len(new) - (end - begin)
        kept = bisect_right(cuts, begin - AHEAD)
        size = lambda a, b: len(text[a:b].encode())
        start = cuts[kept - 1] if kept else 0
        at_byte = size(0, start)
        cuts_now, last_now = cuts[:kept], last[:at_byte]
        for m in self.pattern.finditer(out, start):
            raw, known, tail = m[0].encode(), [], None
            if m.start() == start and kept < len(cuts):  # the match here began here before, too
                known = last[at_byte : at_byte + size(start, min(begin, cuts[kept]))][: len(raw)]
            was = m.end() - grown
            i = bisect_left(cuts, was)
            meets = was >= end and (was == 0 or i < len(cuts) and cuts[i] == was)
            if meets and was > 0:
                began = max(end, cuts[i - 1] if i else 0, m.start() - grown)
                upto = size(0, was)
                tail = last[upto - size(began, was) : upto]
            last_now += self.last_tokens(raw, known, tail)
            cuts_now.append(m.end())
            if meets:
                return out, cuts_now + [c + grown for c in cuts[bisect_right(cuts, was) :]], last_now + last[size(0, was) :]
        return out, cuts_now, last_now


_coders: dict[tuple[str, str], PrefixCoder] = {}


def coder(path: str, pattern: str | None = None) -> PrefixCoder:
    """One for each Python worker."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _coders:
        _coders[path, pattern] = PrefixCoder(path, pattern)
    return _coders[path, pattern]


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(r) // 4 for r in rows]])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _packed(rows: list[list[int]]) -> pa.Array:
    return _lists([np.array(r, np.int32).tobytes() for r in rows])


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names])


def _with(df: DataFrame, **more: DataType) -> StructType:
    return StructType([*df.schema.fields, *[StructField(c, kind) for c, kind in more.items()]])


def encode(docs: DataFrame, path: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """docs with ids (array<int>) and n_tokens (long) of whole texts, by the ranks in path, without special tokens.

    Null and empty texts have no ids. Very long texts, or matches of the pattern, take time in proportion. No two
    encodings tie, since each prefix has one valid last token. Repeated rows are encoded each; columns named ids or
    n_tokens in any letter case are replaced, others stay; an empty table gives no rows. No shuffle.
    """
    keep = _without(docs, "ids", "n_tokens")
    at = keep.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            texts, first = b.column(at).to_pylist(), 0
            while first < len(texts):
                rows, size = [], 0
                while first + len(rows) < len(texts) and size < ROWS_OF:
                    rows.append(c.encode(texts[first + len(rows)]))
                    size += len(rows[-1])
                part = b.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(rows), pa.array([len(r) // 4 for r in rows], pa.int64())], [f"c{i}" for i in range(len(part.columns) + 2)])
                first += len(rows)

    return map_arrow(keep, task, _with(keep, ids=IDS, n_tokens=LongType()))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text", pattern: str | None = None) -> DataFrame:
    """rows with the text of ids, in place of any column of that name. Null ids give ''; bytes that are no UTF-8, as ids
    cut apart can give, become U+FFFD. An id that the file does not have is an error."""
    keep = _without(rows, text.lower())
    at = keep.columns.index(ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            texts = [c.decode(x or ()).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [f"c{i}" for i in range(len(b.columns) + 1)])

    return map_arrow(keep, task, _with(keep, **{text: StringType()}))


def prefix_table(docs: DataFrame, path: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """docs with cuts (where the matches of the pattern end, in characters) and last (the last token of each byte prefix):
    what apply_edits needs. Rows and columns as in encode()."""
    keep = _without(docs, "cuts", "last")
    at = keep.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for i, x in enumerate(b.column(at).to_pylist()):
                cuts, last = c.prefixes(x)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, _packed([cuts]), _packed([last])], [f"c{j}" for j in range(len(b.columns) + 2)])

    return map_arrow(keep, task, _with(keep, cuts=IDS, last=IDS))


def apply_edits(rows: DataFrame, path: str, begin: str, end: str, new: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """rows of prefix_table() after the edit in each: new in place of the characters from begin to end (both at the text's
    end: an append). text, cuts and last are brought up to date and ids added; only what lies near the edit is encoded.

    A null text counts as empty, a null new as '', a null begin as the text's end and a null end as begin; places beyond
    the text are moved into it. Columns of the edit stay.
    """
    keep = _without(rows, "ids")
    columns = keep.columns
    at = {c: columns.index(c) for c in (text, "cuts", "last", begin, end, new)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for i in range(b.num_rows):
                x, cuts, last, first, stop, put = (b.column(at[n])[i].as_py() for n in (text, "cuts", "last", begin, end, new))
                x = x or ""
                first = len(x) if first is None else min(max(first, 0), len(x))
                stop = first if stop is None else min(max(stop, first), len(x))
                x, cuts, last = c.edited(x, cuts or [], last or [], first, stop, put or "")
                made = {at[text]: pa.array([x], pa.string()), at["cuts"]: _packed([cuts]), at["last"]: _packed([last])}
                yield pa.RecordBatch.from_arrays([*[made.get(j, b.column(j).slice(i, 1)) for j in range(len(columns))], _packed([c.back(last)])], [f"c{j}" for j in range(len(columns) + 1)])

    return map_arrow(keep, task, _with(keep, ids=IDS))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            of, back = [], []
            for i in range(b.num_rows):
                ids = b.column(1)[i].values.to_numpy()
                of.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(of, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode(docs, path).select("doc_id", "ids", F.col("n_tokens")).mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
