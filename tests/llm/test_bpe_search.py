"""Byte-level BPE against the library, and ranked search against a plain double loop."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from test_llm import ODD, empty, frame, texts  # noqa: E402

from fieldcast.llm import byte_bpe, ranked_search  # noqa: E402
from fieldcast.llm.queries import QUERIES  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = "ab'srtelvd  \n\t1é漢😀.-  x"


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.coder(PATH).ranks, special_tokens={})


def odd_texts(n: int, seed: int = 4) -> list[str]:
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + [t + "x" * rng.randint(100, 600) + t for t in out[: n // 10]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_prefix_table(name):
    c = byte_bpe.coder(P.path(name))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t in [*odd_texts(300), *texts(20, 3), "<|endoftext|>"]:
        cuts, last = c.prefixes(t)
        want = enc.encode_ordinary(t)
        assert c.back(last) == want == np.frombuffer(c.encode(t), np.int32).tolist() and c.decode(want) == t.encode()
        # the last token of every prefix is that of the prefix encoded alone
        word = t.encode()[: len(t[: cuts[0]].encode())] if cuts else b""
        assert all(last[i - 1] == c.merged(word[:i])[-1] for i in range(1, min(len(word), 40) + 1))


def test_one_valid_last_token():
    """No other token that ends at a prefix fits the one before it."""
    c = byte_bpe.coder(PATH)
    for word in ["strengthening", " therefore", "xxxxxxxxx", "éonpa"]:
        raw = word.encode()
        last = c.last_tokens(raw)
        for end in range(1, len(raw) + 1):
            fit = [t for n in range(1, end + 1) if (t := c.ranks.get(raw[end - n : end])) is not None and c.fits(last[end - n - 1] if n < end else -1, t)]
            assert fit == [last[end - 1]]


def test_edits_encode_as_anew():
    c, rng = byte_bpe.coder(PATH), random.Random(9)
    for t in odd_texts(800, 11):
        cuts, last = c.prefixes(t)
        a = rng.randint(0, len(t))
        b = rng.choice([a, min(len(t), a + rng.randint(0, 10)), len(t)])
        new = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6)))
        out, *table = c.edited(t, cuts, last, a, b, new)
        assert out == t[:a] + new + t[b:] and tuple(table) == c.prefixes(out)


def test_an_edit_is_encoded_near_it_alone(monkeypatch):
    c = byte_bpe.coder(PATH)
    t = " ".join(texts(200, 5, 40, 60))
    cuts, last = c.prefixes(t)
    made = []
    monkeypatch.setattr(byte_bpe.PrefixCoder, "last_token", lambda self, raw, before, end, f=byte_bpe.PrefixCoder.last_token: made.append(end) or f(self, raw, before, end))
    c.edited(t, cuts, last, len(t) // 2, len(t) // 2 + 3, "yes")
    c.edited(t, cuts, last, len(t), len(t), " more")
    assert len(made) < 200 < len(t) // 100


def test_encode_decode_edit_frames(spark):
    rows = [*ODD, *odd_texts(20), "ab " * 40_000]
    df = frame(spark, [*rows, rows[9], rows[9]], True).withColumns({"N_Tokens": F.lit(1), "cuts": F.lit(2), "a.b": F.lit("a.b")})
    out = {r.doc_id: r for r in byte_bpe.encode(df, PATH).collect()}
    enc = library()
    assert all(out[i].ids == enc.encode_ordinary(t or "") and out[i].n_tokens == len(out[i].ids) and out[i]["a.b"] == "a.b" for i, t in enumerate(rows))
    back = {r.doc_id: r.text for r in byte_bpe.decode(byte_bpe.encode(df, PATH), PATH).collect()}
    assert [back[i] for i in range(len(rows))] == [t or "" for t in rows]
    for begin, end, new in ((None, None, " and more"), (1, 3, "Z"), (0, 10**6, None)):
        kinds = {"b": F.lit(begin).cast("int"), "e": F.lit(end).cast("int"), "new": F.lit(new).cast("string")}
        got = {r.doc_id: r for r in byte_bpe.apply_edits(byte_bpe.prefix_table(df, PATH).withColumns(kinds), PATH, "b", "e", "new").collect()}
        for i, t in enumerate(rows):
            t = t or ""
            x = t + new if begin is None else t[:begin] + (new or "") + t[max(min(begin, len(t)), end) :]
            assert got[i].text == x and got[i].ids == enc.encode_ordinary(x)
    assert byte_bpe.encode(empty(spark), PATH).count() == byte_bpe.prefix_table(empty(spark), PATH).count() == 0


def test_op12(spark, tmp_path):
    rows = [*ODD, *texts(30, 7), *odd_texts(20), "x" * 30_000]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    enc = library()
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(rows):
        ids = enc.encode_ordinary(t or "")
        want = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (t or "").encode())]
        assert [got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256] == [len(ids), *want]


def brute_search(docs: list, items: list, k: int = 20) -> list:
    """docs, items: (id, text)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    own = [(i, cut(t)) for i, t in docs]
    own = [(i, Counter(w), len(w)) for i, w in own if w]
    rows, total, df = len(own), sum(n for *_, n in own), Counter(t for _, w, _ in own for t in w)
    out = []
    for item, text in set(items):
        scored = []
        for i, w, n in own:
            m = 75 + 25 * n * rows // total
            s = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 12 * m)) for t in cut(text) if t in w)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


SEARCHED = [*texts(120, 31, 3, 30), *ODD, "THE Of the of", "stone-river_stone\x00river", "été ÉTÉ Été", "the " * 50_000]


@pytest.mark.parametrize("part", [None, "parts", "columns", "blocks"])
def test_ranked_search(spark, monkeypatch, part):
    """parts: sums so bounded that items need several; columns: few terms a product; blocks: few items at once."""
    if part == "parts":
        monkeypatch.setattr(ranked_search, "EXACT", 3000 * ranked_search.IMPACT)
    elif part:
        monkeypatch.setattr(ranked_search, "COLUMNS" if part == "columns" else "BLOCK_ITEMS", 3)
    docs = [*enumerate(SEARCHED), (3, SEARCHED[3]), (None, SEARCHED[4]), (None, "the of and")]
    items = [(1, "the stone of the river"), (2, None), (3, ""), (4, "zzz"), (5, "the the the THE cloud"), (None, "été paper"), (6, "river"), (6, "river"), (6, "glass lamp"), *[(10 + i, t) for i, t in enumerate(texts(6, 8, 5, 40))]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("q", "rank", "score", "item_id", "meet")}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit(1), "doc_id": F.lit("d")})
    got = sorted(map(tuple, ranked_search.ranked_search(df, asked).collect()), key=str)
    assert got == brute_search(docs, items)


def test_ranked_search_names_and_empty(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two three"), ("c", "one two")], "`my.id` string, body string")
    items = spark.createDataFrame([(1, "two one")], "item int, body string")
    out = ranked_search.ranked_search(docs, items, "my.id", "item", "body", 2).orderBy("rank")
    assert out.columns == ["item", "rank", "my.id", "score"] and [r[2] for r in out.collect()] == ["a", "c"]
    assert ranked_search.ranked_search(docs.limit(0), items, "my.id", "item", "body").count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0), "my.id", "item", "body").count() == 0


def test_exact_parts():
    """Weights near the bound are dealt so that every part's sums stay below 2^53, and the parts add up."""
    rng = np.random.default_rng(1)
    term, item = np.arange(300) % 100, np.arange(300) // 100
    weight = rng.integers(1, 2 * (ranked_search.EXACT // ranked_search.IMPACT), 300)
    t = ranked_search.Tile(term, item, weight)
    assert all((m.sum(0) * ranked_search.IMPACT < ranked_search.EXACT).all() for _, m in t.parts)
    total = np.zeros((100, 3), np.int64)
    for used, m in t.parts:
        total[used] += m.astype(np.int64)
    assert (total[term, item] == weight).all()
