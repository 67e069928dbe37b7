"""Chat formatting: a hidden Markov model over speaker markers and line features recovers the roles of a transcript.

A conversation is cut into segments of at most SEGMENT messages, so that a conversation of any length is shared out
over tasks. Viterbi is an associative product of matrices in the (max, +) semiring: each segment gives its matrix, a
pass over these finds the states at the segments' ends, and each segment then finds its own path between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import fresh, in_fold, stored, table

SEGMENT = 1024
#: Speaker markers at the start of a message, by the role that they mostly stand for.
MARKERS = {"user": "user|human|customer|q|question|you", "assistant": "assistant|bot|ai|a|answer|agent|model", "system": "system|instructions?|context"}
#: A bare word is a marker before a colon or closing bracket; with a line of its own only behind a heading's opening.
_HEAD, _OPEN, _CLOSE = r"(?:#{1,4}\s*|<\|im_start\|>)", r"(?:#{1,4}\s*|<\|?|\[|\*\*)?", r"(?:\s*\|?>|\s*\]|\*\*\s*:|\s*:)"
LENGTHS, LINES = 16, 4
CODES = (len(MARKERS) + 1) * LENGTHS * LINES * 2


def marker_pattern(words: str) -> str:
    return f"(?i)^\\s*(?:{_HEAD}(?:{words})\\s*:?\\s*\\n|{_OPEN}(?:{words}){_CLOSE})"


def feature_code(text: Column) -> Column:
    """Marker, length class, lines and a closing question mark of a message as one number under CODES; null is ''."""
    t = F.coalesce(text, F.lit(""))
    marker = F.lit(0)
    for i, words in enumerate(MARKERS.values()):
        marker = F.when(t.rlike(marker_pattern(words)), i + 1).otherwise(marker)
    length = F.least(F.floor(F.log2(F.char_length(t).cast("double") + 1)), F.lit(LENGTHS - 1))
    lines = F.least(F.size(F.split(F.rtrim(t), "\n", -1)) - 1, F.lit(LINES - 1))
    asks = F.endswith(F.rtrim(t), F.lit("?")).cast("int")
    return (((marker * LENGTHS + length) * LINES + lines) * 2 + asks).cast("int")


def split_transcripts(docs: DataFrame, text: str = "text", part: str = "part") -> DataFrame:
    """docs with one row for each turn of its text, which is cut before each line that begins with a speaker marker.

    `part` numbers the turns of a text from 0. A text without such a line, null or empty is one turn, as it is.
    """
    cut = f"(?im)(?=^[#<\\[*]{{0,4}}\\s*(?:{'|'.join(MARKERS.values())})(?:\\|?>|\\]|\\*\\*:|:))"
    parts = F.filter(F.split(F.col(f"`{text}`"), cut, -1), lambda x: F.trim(x) != "")
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.array(f"`{text}`"))
    (own,) = fresh([*docs.columns, part], "turn_text")
    rows = docs.select("*", F.posexplode(parts).alias(part, own))
    return rows.withColumn(text, F.col(own)).drop(own)


class RoleModel:
    """Log-probabilities of the first role, of each role after each, and of each feature code in each role."""

    def __init__(self, roles: list[str], first: np.ndarray, after: np.ndarray, code: np.ndarray):
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.roles, self.first, self.after = roles, norm(first + 1.0), norm(after + 1.0)
        # Features are independent given the role; each has a pseudo-count of one.
        shape = (len(roles), len(MARKERS) + 1, LENGTHS, LINES, 2)
        joint = code.reshape(shape)
        total = np.zeros(shape)
        for axis in range(1, 5):
            one = joint.sum(tuple(a for a in range(1, 5) if a != axis)) + 1.0
            total = total + norm(one).reshape([len(roles), *(shape[a] if a == axis else 1 for a in range(1, 5))])
        self.emit = total.reshape(len(roles), CODES)


def sequenced(messages: DataFrame) -> DataFrame:
    """messages (conv, turn, role, text, part if any) with code, and seg, pos: their place in the order of conv, turn, part.

    The table is sorted over all tasks, so that a long conversation is spread like any other rows; null turns come first,
    and the messages of a null conversation are one conversation.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, pos, conv = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for b in batches:
            segs, places = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int32)
            for i, c in enumerate(b.column(0).to_pylist()):
                c = "NaN" if c != c else c
                if (c, pos < SEGMENT) != (conv, True) or seg & 0xFFFFFFFF == 0xFFFFFFFF:
                    seg, pos, conv = seg + 1, 0, c
                segs[i], places[i] = seg, pos
                pos += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segs), pa.array(places)], [*b.schema.names, "seg", "pos"])

    rows = messages.select("conv", *[c for c in messages.columns if c != "conv"])
    rows = rows.withColumns({"code": feature_code(F.col("text")), "tie": F.xxhash64("text", "role")})
    order = ["conv", "turn", *[c for c in ("part",) if c in rows.columns], "tie"]
    ordered = rows.repartitionByRange(_tasks(rows), *order).sortWithinPartitions(*order).drop("tie")
    kinds = ", ".join(f"{c} {k}" for c, k in ordered.dtypes)
    return stored(ordered.mapInArrow(number, f"{kinds}, seg long, pos int"), "messages")


def _tasks(df: DataFrame) -> int:
    """How many tasks the passes over messages are dealt to, so that these are not merged by their few bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def train(rows: DataFrame, learn: Column) -> RoleModel:
    """Counts over all rows of sequenced() that learn holds for and whose role is known; a few numbers for each role."""
    known = rows.where(learn & F.col("role").isNotNull())
    code = known.groupBy("role", "code").count().collect()
    roles = sorted({r.role for r in code}) or ["user"]
    at = {r: i for i, r in enumerate(roles)}
    codes, after, first = np.zeros((len(roles), CODES)), np.zeros((len(roles), len(roles))), np.zeros(len(roles))
    for r in code:
        codes[at[r.role], r.code] += r["count"]
    inside = Window.partitionBy("seg").orderBy("pos")
    steps = rows.where(learn).select("conv", "seg", "pos", "role", F.lag("role").over(inside).alias("was"))
    ends = rows.where(learn).groupBy("conv", "seg").agg(F.min_by("role", "pos").alias("role"), F.max_by("role", "pos").alias("last"))
    over = ends.withColumn("was", F.lag("last").over(Window.partitionBy("conv").orderBy("seg")))
    pairs = steps.where("pos > 0").select("was", "role").unionByName(over.where("was is not null").select("was", "role"))
    for r in pairs.where("was is not null and role is not null").groupBy("was", "role").count().collect():
        after[at[r.was], at[r.role]] += r["count"]
    opening = over.groupBy("conv").agg(F.min_by("role", "seg").alias("role")).where("role is not null")
    for r in opening.groupBy("role").count().collect():
        first[at[r.role]] += r["count"]
    return RoleModel(roles, first, after, codes)


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by segment, in frames that end with a segment."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        last = f["seg"].to_numpy() == f["seg"].iloc[-1] if len(f) else np.zeros(0, bool)
        held = f[last]
        if not last.all():
            yield f[~last].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def _padded(f: pd.DataFrame, model: RoleModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, emissions by segment, place and role) of a frame of whole segments."""
    seg = f["seg"].to_numpy()
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    lengths = np.diff(np.r_[starts, len(f)])
    emit = np.zeros((len(starts), lengths.max(), len(model.roles)))
    emit[np.repeat(np.arange(len(starts)), lengths), f["pos"].to_numpy()] = model.emit[:, f["code"].to_numpy()].T
    return starts, lengths, emit


def _matrices(model: RoleModel):
    """For each segment, the best score from each role before it to each role at its end."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _segments(frames):
            starts, lengths, emit = _padded(f, model)
            m = model.after[None] + emit[:, 0, None, :]
            opening = model.first + emit[:, 0]
            for t in range(1, emit.shape[1]):
                more = lengths > t
                m[more] = (m[more][:, :, :, None] + model.after[None, None]).max(2) + emit[more, t][:, None, :]
                opening[more] = (opening[more][:, :, None] + model.after[None]).max(1) + emit[more, t]
            yield pd.DataFrame({"seg": f["seg"].to_numpy()[starts], "m": [x.ravel() for x in m], "opening": list(opening)})

    return task


def _chained(model: RoleModel):
    """For each segment of a conversation, the role before it (-1: none) and the role at its end."""
    s = len(model.roles)

    def task(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seg")
        score, back = np.array(f["opening"].iloc[0]), []
        for m in f["m"].iloc[1:]:
            both = score[:, None] + np.array(m).reshape(s, s)
            back.append(both.argmax(0))
            score = both.max(0)
        end = [int(score.argmax())]
        for b in reversed(back):
            end.append(int(b[end[-1]]))
        end.reverse()
        return pd.DataFrame({"seg": f["seg"], "before": [-1, *end[:-1]], "end": end})

    return task


def _paths(model: RoleModel):
    """The role of each message: the best path of its segment between the roles before it and at its end."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _segments(frames):
            starts, lengths, emit = _padded(f, model)
            before, end = f["before"].to_numpy()[starts], f["end"].to_numpy()[starts]
            score = np.where((before < 0)[:, None], model.first, model.after[before]) + emit[:, 0]
            back = np.zeros(emit.shape, np.int8 if len(model.roles) < 128 else np.int32)
            for t in range(1, emit.shape[1]):
                both = score[:, :, None] + model.after[None]
                back[:, t] = both.argmax(1)
                score = np.where((lengths > t)[:, None], both.max(1) + emit[:, t], score)
            # A segment of which no chain is known (end < 0) ends where its own score is best.
            state = np.where(end < 0, score.argmax(1), end)
            out = np.zeros(emit.shape[:2], np.int64)
            for t in range(emit.shape[1] - 1, -1, -1):
                out[:, t] = state
                state = np.where(lengths > t, back[np.arange(len(starts)), t, state], state) if t else state
            roles = np.array(model.roles, dtype=object)
            yield f.assign(role_pred=roles[out[np.repeat(np.arange(len(starts)), lengths), f["pos"].to_numpy()]])[["seg", "pos", "role_pred"]]

    return task


def recover_roles(rows: DataFrame, model: RoleModel) -> DataFrame:
    """rows of sequenced() with role_pred, the Viterbi path of each conversation."""
    features, n = rows.select("seg", "pos", "code"), _tasks(rows)
    # Conversations do not go through pandas, where one null would turn all their ids into doubles.
    opened = rows.where("pos = 0").select("conv", "seg")
    several = opened.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("own"))
    chains = stored(opened.join(several, F.col("conv").eqNullSafe(F.col("own"))).select("conv", "seg"), "chains")
    long = features.join(chains.select("seg"), "seg", "left_semi").repartition(n, "seg").sortWithinPartitions("seg", "pos")
    matrices = stored(long.mapInPandas(_matrices(model), "seg long, m array<double>, opening array<double>"), "matrices")
    ends = matrices.join(chains, "seg").groupBy("conv").applyInPandas(_chained(model), "seg long, before int, end int")
    placed = features.join(ends, "seg", "left").fillna(-1, ["before", "end"])
    paths = placed.repartition(n, "seg").sortWithinPartitions("seg", "pos").mapInPandas(_paths(model), "seg long, pos int, role_pred string")
    return rows.join(paths, ["seg", "pos"])


def render(role: Column, text: Column) -> Column:
    """The canonical turn: role header, the text without blanks around it, end mark.

    One speaker marker goes from the text's beginning, if it is of this role; any other is content.
    """
    body = F.coalesce(text, F.lit(""))
    own = body
    for name, words in MARKERS.items():
        own = F.when(role == name, F.regexp_replace(body, marker_pattern(words), "")).otherwise(own)
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(own), F.lit("<|end|>\n"))


def format_chats(messages: DataFrame, learn: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, part, role_pred, rendered; roles where `learn` (over the column conv) holds are learned from.

    * A message that is a transcript itself, with lines that begin with speaker markers, is cut into its turns, numbered
      by part; its own role is known for the first one only. Any other message is one row of part 0.
    * Null text is '', null roles are not learned from, null turns come first, null conversations are one, messages that
      share a turn are in a fixed order, and repeated rows are messages each. Without any known role all are `user`. No
      rows: no rows.
    * Only the four named columns are read.
    """
    rows = messages.select(*[F.col(f"`{c}`").alias(x) for c, x in ((conv_id, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    rows = split_transcripts(rows).withColumn("role", F.when(F.col("part") == 0, F.col("role")))
    rows = sequenced(rows)
    out = recover_roles(rows, train(rows, learn))
    return out.select(F.col("conv").alias(conv_id), F.col("turn").alias(turn), "part", "role_pred", render(F.col("role_pred"), F.col("text")).alias("rendered"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learned from conversations outside the held-out fold."""
    out = format_chats(table(spark, sf_dir, "conversations"), ~in_fold(F.col("conv")))
    return out.select("conv_id", "turn", "part", in_fold(F.col("conv_id")).alias("held_out"), "role_pred", "rendered")
