"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A row's signature is one character: the kind of its role and its first fault. What repairing the rest of a conversation
costs depends on the signature of that rest alone, so all conversations' signatures are minimised from the end into one
automaton that suffixes share. Each node is worked out once for each state of the grammar `(s?(ua)+)?`: the cost-to-go
and the first edit of its best audit. In one state the edits have different initials, so that the first edit settles
every tie between audits, and the best audit suffix is a path from node to node.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from fieldcast.llm.common import stored, table

#: Kinds of roles by initial (the last: any other) and of faults; a row's signature is chr(BASE + 4 * kind + fault).
INITIALS, BASE = "sua", 65
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: States of the grammar: nothing yet, after s, after u, after a. What may follow, and where it leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FOLLOWS = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
ENDS = (START, AFTER_A)
#: The turn that a new or rerolled row takes in each state, and the state after it.
TURN = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
REROLE, DELETE, INSERT, UNMENDED, FAR = 1, 2, 5, 5, 1 << 40
#: Kinds that may stand side by side: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Of so many rows (a power of two) at most the signatures are gathered in one step, before the steps are joined.
BLOCK = 10
_BLANKS = r"[^\x20\x09-\x0D]"


class Automaton:
    """Nodes for signatures read from the end: cost-to-go of each state of the grammar, less the cheapest of them.

    Suffixes whose costs differ alike from state to state lead to one node, so there are few nodes, whatever the number
    and length of conversations. steps: for a node and a character put before it, worked out once: the node that they
    lead to, what is added to the cost, and the first edit of the best audit for each state.
    """

    def __init__(self) -> None:
        self.nodes: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, str]] = {}
        # Without rows: nothing is left to do where the grammar may end.
        self.end, self.end_cost, self.end_edits = self._closed([(0, " ") if s in ENDS else (FAR, " ") for s in range(4)])

    def _closed(self, best: list[tuple[int, str]]) -> tuple[int, int, str]:
        """(node, cheapest cost, edits) once inserted turns may come first. More than two in a row lead to a state met before."""
        for _ in range(2):
            best = [min(now, (INSERT + best[TURN[s][1]][0], "I")) for s, now in enumerate(best)]
        least = min(best)[0]
        key = tuple(c - least for c, _ in best)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
        return self.number[key], least, "".join(e for _, e in best)

    def step(self, node: int, sign: str) -> tuple[int, int, str]:
        got = self.steps.get((node, sign))
        if got is None:
            (kind, fault), rest, best = divmod(ord(sign) - BASE, 4), self.nodes[node], []
            for s in range(4):
                able = [(DELETE + rest[s], "D")]
                if fault in (FINE, TRUNCATED):
                    more = UNMENDED * (fault == TRUNCATED)
                    able.append((REROLE + more + rest[TURN[s][1]], "R"))
                    if kind < len(INITIALS) and INITIALS[kind] in FOLLOWS[s]:
                        able.append((more + rest[FOLLOWS[s][INITIALS[kind]]], "K"))
                best.append(min(able))
            got = self.steps[node, sign] = self._closed(best)
        return got


def verdicts(reversed_signatures: Iterable[str]) -> Iterator[tuple[str, int, int, int, int, int, str]]:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each.

    They come reversed and sorted, so that those with a common end stand together: of a suffix that is shared only the
    first reading is made. Held are a node and five numbers for each character of the current signature.
    """
    auto, before = Automaton(), ""
    node, sums = array("i", [auto.end]), [array("q", [x]) for x in (0, 0, 0, 0, auto.end_cost)]
    for r in reversed_signatures:
        same = len(os.path.commonprefix([r, before]))
        for x in (node, *sums):
            del x[same + 1 :]
        for i in range(same, len(r)):
            kind, fault = divmod(ord(r[i]) - BASE, 4)
            to, added, _ = auto.step(node[i], r[i])
            illegal = i > 0 and (kind, (ord(r[i - 1]) - BASE) // 4) not in LEGAL
            node.append(to)
            for x, n in zip(sums, (fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, illegal, added), strict=True):
                x.append(x[i] + n)
        before, state, at, audit = r, START, len(r), []
        cost = sums[4][at] + auto.nodes[node[at]][START]
        while edit := (auto.step(node[at - 1], r[at - 1])[2] if at else auto.end_edits)[state].strip():
            audit.append(edit)
            if edit in "IR":
                state = TURN[state][1]
            elif edit == "K":
                state = FOLLOWS[state][INITIALS[(ord(r[at - 1]) - BASE) // 4]]
            at -= edit != "I"
        yield r[::-1], *[x[len(r)] for x in sums[:4]], cost, "".join(audit)


def judged(signatures: DataFrame) -> DataFrame:
    """signature (distinct, column of that name) with blank, duplicate, truncated, illegal, cost and audit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> Iterator[str]:
            for b in batches:
                yield from b.column(0).to_pylist()

        rows, size = [], 0
        for row in verdicts(one()):
            rows.append(row)
            size += len(row[0])
            if size > 1_000_000 or len(rows) > 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    # Range by the reversed signature, so that a task gets neighbours with common ends.
    back = signatures.select(F.reverse("signature").alias("back"))
    return back.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(task, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:6]], pa.array(columns[6], pa.string())], ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _first_faults(runs: DataFrame) -> DataFrame:
    """runs (conv, turn, role, text, n: n equal rows) with signs: the signature of its rows."""
    keyed = runs.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1))})
    # The first turn of equal rows of a conversation, by partial sums: no task gets all rows of a conversation.
    first = keyed.groupBy("conv", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("first")).withColumnsRenamed({"conv": "c", "h1": "x1", "h2": "x2"})
    both = keyed.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")))
    initial = F.substring("role", 1, 1)
    kind = F.lit(len(INITIALS))
    for i, c in enumerate(INITIALS):
        kind = F.when(initial == c, i).otherwise(kind)
    sign = lambda fault: F.chr(BASE + 4 * kind + fault)
    cut = F.when(F.regexp_extract("text", rf"({_BLANKS})[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?"), sign(FINE)).otherwise(sign(TRUNCATED))
    again = F.expr("repeat(twice, cast(n - 1 as int))")
    signs = F.when(~F.col("text").rlike(_BLANKS), F.expr("repeat(none, cast(n as int))")).when(F.col("first.turn").eqNullSafe(F.col("turn")), F.concat(cut, again)).otherwise(F.concat(F.col("twice"), again))
    return both.withColumns({"twice": sign(DUPLICATE), "none": sign(BLANK)}).select("conv", "turn", "role", "text", "n", signs.alias("signs"))


def _joined(ordered: DataFrame) -> DataFrame:
    """(conv, signature): by blocks of rows of a conversation first, then the blocks, a byte a row."""
    parts = ordered.groupBy("conv", F.shiftright("pos", BLOCK).alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "signs"))).alias("x"))
    parts = parts.select("conv", "at", F.array_join(F.transform("x", lambda r: r["signs"]), "").alias("signs"))
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "signs"))).alias("x"))
    return whole.select("conv", F.array_join(F.transform("x", lambda r: r["signs"]), "").alias("signature"))


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired): a row for each conversation, and the rows of the repaired conversations.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, for each conv_id of `conversations` (of rows
    unless given). repaired: conv_id, place (from 0), role, text, edit (K, R or I).

    * Order: by turn, null first, then role, then text. Null roles and texts are one space; a null conv_id is a
      conversation. A role without a character, or of another initial than s, u and a, cannot be kept.
    * Equal rows: all but the first are duplicates. Ties between cheapest audits: the ASCII-least. Conversations without
      rows: zeros, an empty audit, no repaired rows. Empty table: no rows. Only the four named columns are read.
    * A conversation may hold any part of all rows: they are ordered by ranges, and gathered as a byte a row, like the
      audit that comes out. Very long texts only pass through.
    """
    given = [F.col(f"`{c}`").alias(a) for c, a in ((conv_id, "conv"), (turn, "turn"))]
    own = rows.select(*given, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    runs = stored(_first_faults(own.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))), "faults")
    # Equal (conv, turn, role) fall into one range, so texts need not be sampled for the ranges.
    placed = runs.repartitionByRange("conv", "turn", "role").sortWithinPartitions("conv", "turn", "role", "text")
    ordered = stored(placed.withColumn("pos", F.monotonically_increasing_id()), "ordered")
    signed = stored(_joined(ordered), "signed")
    found = signed.join(judged(signed.select("signature").distinct()), "signature").drop("signature")
    gaps = own.groupBy("conv", "turn").count().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    asked = (rows if conversations is None else conversations).select(given[0]).distinct()
    same = lambda df, c: df.withColumnRenamed("conv", c)
    report = asked.join(same(gaps, "c1"), F.col("conv").eqNullSafe(F.col("c1")), "left").join(same(found, "c2"), F.col("conv").eqNullSafe(F.col("c2")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = stored(report.select(F.col("conv").alias(conv_id), *[zero(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit")), "report")
    return report, _repaired(ordered, report, conv_id, role, text)


def _streamed(ordered: DataFrame, report: DataFrame, conv_id: str) -> DataFrame:
    """conv, pos, role, text, n, audit: before the rows of each conversation one with its audit (pos -1), in order.

    A conversation comes to one task, but as a stream of sorted rows, which spills; what is built from it row by row, such
    as a digest of the whole, is a sequence by nature.
    """
    audits = report.select(F.col(f"`{conv_id}`").alias("conv"), F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"), "audit")
    texts = ordered.select("conv", "pos", "role", "text", "n", F.lit(None).cast("string").alias("audit"))
    return audits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "pos")


def edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, str, str, str]]:
    """(conv, place, role, text, edit) of the repaired rows, and (conv, -1, "", "", "") before those of a conversation, out
    of batches of _streamed()."""
    conv, audit, at, state, place = None, "", 0, START, 0

    def until_row() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            turn, state = TURN[state]
            yield conv, place, turn, "", "I"
            at, place = at + 1, place + 1

    for b in batches:
        pos, role, text, n, audits = (b.column(i).to_pylist() for i in range(1, 6))
        for i in range(b.num_rows):
            if pos[i] < 0:
                yield from until_row()
                conv, audit, at, state, place = b.column(0).slice(i, 1), audits[i], 0, START, 0
                yield conv, -1, "", "", ""
                continue
            for _ in range(n[i]):
                yield from until_row()
                edit, at = audit[at], at + 1
                if edit == "R":
                    turn, state = TURN[state]
                    yield conv, place, turn, text[i], "R"
                elif edit == "K":
                    state = FOLLOWS[state][role[i][0]]
                    yield conv, place, role[i], text[i], "K"
                place += edit != "D"
    yield from until_row()


def _repaired(ordered: DataFrame, report: DataFrame, conv_id: str, role: str, text: str) -> DataFrame:
    kind = report.schema[conv_id].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in edited_rows(batches):
            if r[1] >= 0:
                held.append(r)
                size += len(r[3]) + 64
            if size > 1_000_000:
                yield _rows(held, kind)
                held, size = [], 0
        if held:
            yield _rows(held, kind)

    schema = StructType([StructField("conv", kind), StructField("place", LongType()), *[StructField(c, StringType()) for c in ("role", "text", "edit")]])
    return _streamed(ordered, report, conv_id).mapInArrow(task, schema).toDF(conv_id, "place", role, text, "edit")


def _rows(held: list[tuple], kind: DataType) -> pa.RecordBatch:
    conv, place, *rest = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(conv).cast(to_arrow_type(kind)), pa.array(place, pa.int64()), *[pa.array(c, pa.string()) for c in rest]], ["conv", "place", "role", "text", "edit"])


def digests(repaired: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired rows of repair(), as they come: of `role:text`, joined by line ends, row by row."""
    kind = repaired.schema[conv_id].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, convs, out = None, None, [], []
        for b in batches:
            role, text = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, at in enumerate(b.column(1).to_pylist()):
                if at == 0:
                    if conv is not None:
                        convs.append(conv)
                        out.append(sha.hexdigest())
                    conv, sha = b.column(0).slice(i, 1), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role[i]}:{text[i]}".encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(convs), pa.array(out, pa.string())], ["conv", "repaired_sha256"])
                convs, out = [], []
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([*convs, conv]), pa.array([*out, sha.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    rows = repaired.select(F.col(f"`{conv_id}`").alias("conv"), *repaired.columns[1:4]).toDF("conv", "place", "role", "text")
    schema = StructType([StructField("conv", kind), StructField("repaired_sha256", StringType())])
    return rows.mapInArrow(task, schema).withColumnRenamed("conv", conv_id)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of each row by the crc32 of `conv_id:turn`, modulo 20: 0 drops it, 1 empties
    its text, 2 takes `.!?` out of it, 3 repeats it, 4 sets role user. Nulls count as one space, but for conv_id and turn
    outside the crc32."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), code.alias("code")).where("code <> 0")
    out = rows.withColumns({"text": F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role"))})
    return out.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("code", "copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(conversations), conversations)
    sums = digests(repaired).withColumnRenamed("conv_id", "c")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    both = report.join(sums, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))



def _option(cost: str, edit: str, then: str, row: str | None) -> str:
    """SQL of a way on: its cost and edit before those of `then`, and the repaired row, if any."""
    rows = f"[{row}] || {then}.rows" if row else f"{then}.rows"
    return f"{{'cost': {cost} + {then}.cost, 'audit': '{edit}' || {then}.audit, 'rows': {rows}}}"


def _state_sql(state: str, after: str, turn: str, keeps: dict[str, str]) -> str:
    """SQL of the best way on from a state at a row, inserted turns apart; in sorted order a cheaper or ASCII-less way comes first."""
    ways = [_option("CASE WHEN fault = 'fine' THEN 1 WHEN fault = 'truncated' THEN 6 ELSE 1000000 END", "R", f"w.{after}", f"'{turn}:' || text")]
    ways += [_option(f"CASE WHEN initial <> '{i}' THEN 1000000 WHEN fault = 'fine' THEN 0 WHEN fault = 'truncated' THEN 5 ELSE 1000000 END", "K", f"w.{to}", "role || ':' || text") for i, to in keeps.items()]
    return f"list_sort([{', '.join([_option('2', 'D', f'w.{state}', None), *ways])}])[1] AS {state}"


def _inserted_sql(state: str, *then: tuple[str, str]) -> str:
    """SQL of the best way on from a state, with inserted turns first or none."""
    ways, rows = [state], ""
    for n, (turn, to) in enumerate(then, 1):
        rows += f"{', ' * (n > 1)}'{turn}:'"
        ways.append(_option(str(5 * n), "I" * n, to, rows))
    return f"list_sort([{', '.join(ways)}])[1] AS {state}"


OP11_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295) % 20 AS code
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE code WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded),
placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
faulty AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault
  FROM counted),
counts AS (
  SELECT conv_id, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
         count_if(i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
gaps AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM damaged GROUP BY conv_id),
ways AS (
  SELECT conv_id, max(n) + 1 AS i, {{'cost': 0, 'audit': '', 'rows': []::VARCHAR[]}} AS b, {{'cost': 10, 'audit': 'II', 'rows': ['user:', 'assistant:']}} AS s,
         {{'cost': 5, 'audit': 'I', 'rows': ['assistant:']}} AS u, {{'cost': 0, 'audit': '', 'rows': []::VARCHAR[]}} AS a
  FROM faulty GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_inserted_sql("b", ("user", "u"), ("assistant", "a"))}, {_inserted_sql("s", ("user", "u"), ("assistant", "a"))},
         {_inserted_sql("u", ("assistant", "a"))}, {_inserted_sql("a", ("user", "u"))}
  FROM (
    SELECT f.conv_id, f.i, {_state_sql("b", "u", "user", {"s": "s", "u": "u"})}, {_state_sql("s", "u", "user", {"u": "u"})},
           {_state_sql("u", "a", "assistant", {"a": "a"})}, {_state_sql("a", "u", "user", {"u": "u"})}
    FROM ways w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i + 1)),
best AS (SELECT conv_id, b FROM ways WHERE i = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN gaps g ON o.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""
