"""Conversation repair against SQL and against all edit sequences of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import repair
from fieldcast.llm.queries import QUERIES, SQL

KINDS = "conv_id long, turn long, role string, text string"


def conversations(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    roles, said = ["user", "assistant", "system", "tool", "", None, "User"], ["Fine.", "Ends well! ", "no end", "", " \t", None, "Really?\n", "Fine."]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            good = rng.random() < 0.7
            role = ("user", "assistant")[t % 2] if good else rng.choice(roles)
            rows.append((c, rng.choice([t, t, t, 2 * t, None]) if c % 3 == 0 else t, role, f"Turn {t}." if good else rng.choice(said)))
    return rows + [(None, 1, "user", "Lost."), (None, None, None, None), (None, None, "assistant", "Found.")]


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "fine" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple], bad: list[str], extra: int = 3) -> tuple[int, str, str]:
    """(cost, audit, repaired text) by trying every edit of every row, with up to `extra` inserted turns anywhere."""
    best = None

    def go(i: int, cost: int, audit: str, out: list, left: int):
        nonlocal best
        shape = "".join(r[:1] or "?" for r, _ in out)
        if best is not None and cost > best[0] or not re.fullmatch(r"s?(ua)*u?", shape):
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", shape):
                best = min(x for x in (best, (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))) if x)
        else:
            role, text = rows[i][2:]
            go(i + 1, cost + 2, audit + "D", out, left)
            if bad[i] in ("fine", "truncated"):
                more = 5 * (bad[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], left)
                for turn in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*out, (turn, text)], left)
        if left:
            for turn in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (turn, "")], left - 1)

    go(0, 0, "", [], extra)
    return best


def report_of(rows: list[tuple]) -> tuple:
    """The report of one conversation, of rows after damage in order."""
    bad = faults(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
    cost, audit, text = cheapest(rows, bad)
    return (gaps, *[bad.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_op11(spark, tmp_path):
    rows = [r for r in conversations(60) if r[1] is None or r[1] < 7]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    own: dict = {r[0]: [] for r in rows}
    for r in sorted(damage(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        own[r[0]].append(r)
    assert set(got) == set(own)
    for c, x in own.items():
        assert got[c] == report_of(x), x


def test_op11_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(conversations(400, 5), KINDS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    want = db.sql(SQL["op11_conversation_repair"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str) and got.columns == want.columns


def test_suffixes_are_shared():
    signs = "".join(chr(repair.BASE + i) for i in range(16))
    made = sorted("".join(x) for n in range(4) for x in itertools.product(signs, repeat=n))
    steps = []
    auto = repair.Automaton
    step = auto.step
    try:
        auto.step = lambda self, node, sign: steps.append((self, node, sign)) or step(self, node, sign)
        out = list(repair.verdicts(made))
    finally:
        auto.step = step
    assert len(out) == len(made) == 1 + 16 + 256 + 4096 and len(steps[0][0].nodes) <= 64
    assert all(a.count("K") + a.count("R") + a.count("D") == len(s) for s, *_, a in out)
    # one at a time gives the same as sharing
    assert [next(repair.verdicts([r])) for r in made[::50]] == out[::50]


def test_one_conversation_of_many_rows_and_long_texts(spark):
    """A conversation that holds most rows is ordered by ranges; its signature and audit have a byte a row."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(6000)] + [(2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "Yes."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(c) for c in ("conv", "n", "pos", "audit", "edit", "place")})
    report, repaired = repair.repair(df)
    got = {r.conv_id: r for r in report.collect()}
    assert got[1].audit == "K" * 6000 and got[1].cost == 0 and (got[2].audit, got[2].cost, got[2].duplicate) == ("KKD", 2, 1)
    out = [(r.place, r.role, r.text, r.edit) for r in repaired.where("conv_id = 1").orderBy("place").collect()]
    assert out == [(t, r, x, "K") for _, t, r, x in rows[:6000]]
    want = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x, _ in out).encode()).hexdigest()
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests(repaired).collect()}[1] == want


def test_empty_and_no_rows_left(spark):
    none = spark.createDataFrame([], KINDS)
    report, repaired = repair.repair(none)
    assert report.count() == repaired.count() == 0
    report, repaired = repair.repair(none, spark.createDataFrame([(7, 1, "user", "x"), (None, 1, "user", "x")], KINDS))
    assert sorted(map(tuple, report.collect()), key=str) == [(7, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")] and repaired.count() == 0
