"""SentencePiece encoding and decoding by streaming Viterbi over a model's pieces.

The encoder holds a window of the longest piece's length and gives ids out as soon as all surviving backpointer paths
meet in one boundary: at once where no piece goes over a boundary, and by following the paths back where the window has
grown. Pieces are scored as unigrams: a model of kind BPE stores merge ranks, not log-probabilities, so a piece costs
PIECE_COST and what Zipf's law has for its rank, log(rank + 3). Texts are not normalised but for the space mark and the
mark put in front, and every byte sequence that no piece covers goes to byte pieces, so that decoding restores any text.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from fieldcast.llm.common import map_arrow, table

MARK = "▁"
#: What a piece of a BPE model costs besides the logarithm of its rank: of the words of prose, 83 % then get the ids of
#: the model's merges, against 71 % without.
PIECE_COST = 5.0
#: Distinct spans whose ids a task keeps, the longest such span, and the characters that are taken in at a time.
KEPT, KEPT_LENGTH, SLICE = 300_000, 64, 4096
#: Where no piece goes over a boundary between another character and a space mark, all paths meet there.
_spans = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+").findall


class Pieces:
    """The pieces of a model file with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        own = [model.id_to_piece(i) for i in range(size)]
        self.bytes = [0] * 256
        self.of_byte: dict[int, int] = {}
        self.score: dict[str, tuple[float, int]] = {}
        stored = [model.get_score(i) for i in range(size)]
        ranks = all(s == int(s) for s in stored)
        for i, piece in enumerate(own):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.of_byte[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece] = (-PIECE_COST - math.log(3 - stored[i]) if ranks and stored[i] <= 0 else stored[i], i)
        self.longest = max(map(len, self.score))
        # One byte costs more than any piece, so that bytes are used only where no piece fits.
        self.byte_score = min(s for s, _ in self.score.values()) - 10.0
        #: What each id stands for in a text.
        self.raw = [bytes((self.of_byte[i],)) if i in self.of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(own)]
        #: Whether the text can be cut before each run of space marks.
        self.cuts = not any(a != MARK and b == MARK for p in self.score for a, b in zip(p, p[1:], strict=False))
        #: The pieces by characters: [next characters, score, id], id -1 where no piece ends.
        self.root: dict[str, list] = {}
        for p, (score, i) in self.score.items():
            level = self.root
            for c in p:
                node = level.setdefault(c, [{}, 0.0, -1])
                level = node[0]
            node[1], node[2] = score, i


class StreamingViterbi:
    """Encodes a stream of characters. feed() returns the ids that no later character can change, end() the others.

    A span between two boundaries in which all paths meet has the same ids wherever it stands, so those of short spans
    are kept in `kept`.
    """

    def __init__(self, pieces: Pieces, kept: dict[str, array] | None = None):
        self.p, self.kept, self.commits = pieces, {} if kept is None else kept, 0
        self._clear()

    def _clear(self) -> None:
        """window: characters after the last boundary that ids are out for; at: edges from before it are made; reach:
        where the longest of these ends. best, prev, last: score of the best path to a place, where its last piece
        begins, and the piece's id, -1 for bytes."""
        self.window, self.at, self.reach = "", 0, 0
        self.best, self.prev, self.last = [0.0], [0], [0]

    def feed(self, text: str) -> array:
        out = array("i")
        for a in range(0, len(text), SLICE):
            spans = _spans(self.window + text[a : a + SLICE]) if self.p.cuts else [self.window + text[a : a + SLICE]]
            for span in spans[:-1]:
                got = None if self.at else self.kept.get(span)
                out += self._whole(span) if got is None else got
            self.window = spans[-1]
            if len(self.window) >= 4 * self.p.longest:
                self._forget(self._advance(len(self.window) - self.p.longest + 1, out))
        return out

    def end(self) -> array:
        return self._whole(self.window)

    def _whole(self, span: str) -> array:
        """The ids of what is left of a span that ends here."""
        if self.at == 0 and (got := self.kept.get(span)) is not None:
            self.window = ""
            return got
        short, out, self.window = self.at == 0 and len(span) <= KEPT_LENGTH, array("i"), span
        self._commit(self._advance(len(span), out), len(span), out)
        self._clear()
        if short:
            self.kept[span] = out
        return out

    def _advance(self, stop: int, out: array) -> int:
        """Makes the edges from all places before stop, adds ids to out wherever the paths meet, and returns where last."""
        w, root, byte, more = self.window, self.p.root, self.p.byte_score, len(self.window) + 1 - len(self.best)
        size, start, reach = len(w), 0, self.reach
        best, prev, last = self.best, self.prev, self.last
        best += [-math.inf] * more
        prev += [0] * more
        last += [0] * more
        for i in range(self.at, stop):
            if i == reach and i > start:
                self._commit(start, i, out)
                start = i
            elif i - start >= 4 * self.p.longest and (met := self._meeting(start, i, reach)) > start:
                self._commit(start, met, out)
                start = met
            base, j = best[i], i
            node = root.get(w[i])
            if node is None or node[2] < 0:
                s = base + byte * len(w[i].encode("utf-8", "surrogatepass"))
                if s > best[i + 1]:
                    best[i + 1], prev[i + 1], last[i + 1] = s, i, -1
                if reach <= i:
                    reach = i + 1
            while node is not None:
                j += 1
                if node[2] >= 0:
                    if j > reach:
                        reach = j
                    if base + node[1] > best[j]:
                        best[j], prev[j], last[j] = base + node[1], i, node[2]
                if j == size:
                    break
                node = node[0].get(w[j])
        self.at, self.reach = stop, reach
        return start

    def _forget(self, start: int) -> None:
        """Places before start go, those after are counted from there."""
        self.window, self.at, self.reach = self.window[start:], self.at - start, self.reach - start
        self.best, self.prev, self.last = self.best[start:], [p - start for p in self.prev[start:]], self.last[start:]

    def _meeting(self, start: int, at: int, reach: int) -> int:
        """The last boundary on the paths to all places that an edge can still leave from."""
        ends = {j for j in range(at, reach + 1) if self.best[j] > -math.inf}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(max(self.prev[end], start))
        return ends.pop()

    def _commit(self, start: int, j: int, out: array) -> None:
        """Adds the ids of the best path from start to j."""
        own = []
        while j > start:
            if self.last[j] >= 0:
                own.append(self.last[j])
            else:
                own += [self.p.bytes[b] for b in reversed(self.window[self.prev[j]].encode("utf-8", "surrogatepass"))]
            j = self.prev[j]
        own.reverse()
        out.extend(own)
        self.commits += 1


class Codec:
    """encode and decode of whole texts; spans of ids are kept from one text to the next."""

    def __init__(self, path: str):
        self.pieces, self.kept = Pieces(path), {}

    def encode(self, text: str | None) -> array:
        """The ids of a text; none for null or ''.

        A space mark that stands in the text itself goes to bytes, else it would be decoded as a space.
        """
        out = array("i")
        if not text:
            return out
        if len(self.kept) > KEPT:
            self.kept.clear()
        for n, part in enumerate(text.split(MARK)):
            if n:
                out.extend(self.pieces.bytes[b] for b in MARK.encode())
            stream = StreamingViterbi(self.pieces, self.kept)
            out += stream.feed(("" if n else MARK) + part.replace(" ", MARK))
            out += stream.end()
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes in order, marks as spaces, without the mark put in front."""
        return b"".join(map(self.pieces.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _arrays(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    values = array("i")
    for r in rows:
        values += r
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32)))


#: Characters of text that are encoded before their rows go on.
ROWS_OF = 1_000_000


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) and n_ids (long), of whole texts.

    Null and empty texts have no ids. Repeated rows are encoded each; columns named ids or n_ids are replaced, others
    stay; an empty table gives no rows. Paths of equal score: the one whose last differing piece begins first stays.
    """
    keep = [c for c in docs.columns if c.lower() not in ("ids", "n_ids")]
    at = keep.index(text)
    kinds = docs.select(*[f"`{c}`" for c in keep]).schema
    schema = kinds.add("ids", ArrayType(IntegerType())).add("n_ids", LongType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts, first = b.column(at).to_pylist(), 0
            while first < len(texts):
                rows, size = [], 0
                while first + len(rows) < len(texts) and size < ROWS_OF:
                    x = texts[first + len(rows)]
                    rows.append(c.encode(x))
                    size += len(x or "")
                part = b.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, _arrays(rows), pa.array([len(r) for r in rows], pa.int64())], [f"c{i}" for i in range(len(keep) + 2)])
                first += len(rows)

    return map_arrow(docs.select(*[f"`{c}`" for c in keep]), task, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of ids; null ids give ''. A column named as `text` is replaced."""
    keep = [c for c in rows.columns if c != text]
    at = keep.index(ids)
    schema = rows.select(*[f"`{c}`" for c in keep]).schema.add(text, StringType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or ()) for x in b.column(at).to_pylist()], pa.string())], [f"c{i}" for i in range(len(keep) + 1)])

    return map_arrow(rows.select(*[f"`{c}`" for c in keep]), task, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids of its text, their number, and whether they decode to just this text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(2)
            same = [c.decode(ids[i].values.to_numpy().tolist()) == (x or "") for i, x in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, b.column(3), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "restored"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path).mapInArrow(task, "doc_id long, ids array<int>, n_ids long, restored boolean")
