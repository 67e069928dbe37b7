"""The opN queries and the pipeline themselves, over small Parquet folders, against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm import ODD, brute_components, brute_features, brute_lines, brute_scores, full_viterbi, near_copies, texts, toxic_rows  # noqa: E402

from fieldcast.llm import quality, sentencepiece  # noqa: E402
from fieldcast.llm.queries import QUERIES  # noqa: E402

LANGS = {"aa": "kabo rilu mesa tofi".split(), "bb": "strong whelp gnash brisk".split()}


def corpus() -> tuple[list, list, list]:
    rng = random.Random(31)
    toxic, bad = toxic_rows(60)
    rows = [*toxic, *near_copies(9), *texts(20, 5, 60, 120), *[" ".join(f"{w}###" for w in t.split()) for t in texts(6, 6, 60, 90)]]
    rows = [t if t is None or i % 4 else f"{t}\nA line that many share" for i, t in enumerate(rows)]
    rows += ["word " * 30_000, "x" * 20_000, rows[3], rows[3]]
    langs = [rng.choice([*LANGS, None]) for _ in rows]
    return rows, [(i, 1, int(i in bad)) for i in range(60)], langs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, langs = corpus()
    at = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, lang, "web", len(t or "")) for i, (t, lang) in enumerate(zip(rows, langs, strict=True))]
    put = lambda data, kinds, name, n=3: spark.createDataFrame(data, kinds).repartition(n).write.parquet(f"{at}/{name}.parquet")
    put(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put(labels, "doc_id long, quality int, toxic int", "labels")
    put([(0, rows[150].split("\n")[0]), (1, None), (2, "too short")], "item_id long, text string", "benchmark")
    put([(c, t, ("user", "assistant")[t % 2], "ok?" if t % 2 == 0 else texts(1, c * 9 + t, 30, 40)[0]) for c in range(30) for t in range(4)], "conv_id long, turn long, role string, text string", "conversations")
    put([(0, "http://a.NET/x", ""), (1, None, None), (2, "http://q.org/fr/1", "")], "page_id long, url string, html string", "pages")
    return at, rows, langs


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def got(spark, name: str, at: str) -> dict:
    rows = QUERIES[name](spark, at).collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op3(spark, folder):
    at, rows, _ = folder
    out = got(spark, "op3_quality_rules", at)
    feats = [quality.features(t) for t in rows]
    code = quality.votes({f: np.array([x[i] for x in feats]) for i, f in enumerate(quality.FEATURES)})
    seen = [[(int(c) // 3**j) % 3 for j in reversed(range(len(quality.RULES)))] for c in code]
    # EM by hand, a document at a time
    post = [1 / (1 + 9.0 ** (2.0 * v.count(quality.BAD) - 0.5 * v.count(quality.GOOD))) for v in seen]
    for _ in range(200):
        share = (sum(post) + 1) / (len(post) + 2)
        p = [[[1.0] * 3 for _ in range(2)] for _ in quality.RULES]
        for v, w in zip(seen, post, strict=True):
            for j, x in enumerate(v):
                p[j][0][x] += w
                p[j][1][x] += 1 - w
        p = [[[x / sum(c) for x in c] for c in r] for r in p]
        good = [share * np.prod([p[j][0][x] for j, x in enumerate(v)]) for v in seen]
        bad = [(1 - share) * np.prod([p[j][1][x] for j, x in enumerate(v)]) for v in seen]
        post = [g / (g + b) for g, b in zip(good, bad, strict=True)]
    for i, t in enumerate(rows):
        r, f = out[i], brute_features(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        assert r.base_failed == failed and abs(r.p_good - post[i]) < 1e-4 and r.kept == (not failed and post[i] >= 0.5)


def test_op4(spark, folder):
    at, rows, _ = folder
    c = sentencepiece.codec(P.path("piece_bpe_32k.model"))
    out = got(spark, "op4_sentencepiece", at)
    for i, t in enumerate(rows):
        assert out[i].restored and out[i].n_ids == len(out[i].ids)
        if t and len(t) < 500 and sentencepiece.MARK not in t:
            assert out[i].ids == full_viterbi(c.pieces, sentencepiece.MARK + t.replace(" ", sentencepiece.MARK))


def test_op6(spark, folder):
    at, rows, langs = folder
    out = got(spark, "op6_language_id", at)
    assert all(out[i].held_out == held_out(i) and 0 <= out[i].score <= 1 for i in out)
    assert all(out[i].lang_pred in LANGS or out[i].lang_pred == "und" for i in out)
    assert all((out[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(rows))


def test_op6_equals_exact_sets(spark, tmp_path):
    """The same n-grams counted in exact sets: as the filters hardly ever err, the predictions agree."""
    from fieldcast.llm import language_id

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGS[l]) for _ in range(rng.randint(1, 40))), l) for i in range(200) for l in [rng.choice(list(LANGS))]]
    rows += [(900, "kabo strong", None), (901, "kabo strong " * 100_000, None), (902, "zzzz", None), (903, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, "doc_id", "text", "lang")
    grams = {l: Counter() for l in LANGS}
    for _, t, l in rows:
        if l:
            for h, _who in language_id.blocks([t]):
                grams[l].update(h.tolist())
    rate = {l: {g: n / sum(c.values()) for g, n in c.items()} for l, c in grams.items()}
    chosen = {l: {g for g, n in grams[l].items() if n >= 3 and rate[l][g] >= language_id.LEAST_SHARE * max(rate[x].get(g, 0) for x in rate)} for l in grams}
    pred, score = model.predict([t for _, t, _ in rows])
    for (_, t, _), l, s in zip(rows, pred, score, strict=True):
        h = np.concatenate([b[0] for b in language_id.blocks([t])] or [np.zeros(0, np.uint64)]).tolist()
        share = {x: sum(g in chosen[x] for g in h) / max(len(h), 1) for x in sorted(grams)}
        want = max(share, key=share.get) if any(c.isalpha() for c in t) else "und"
        assert l == want and (not h or abs(s - max(share.values()) / max(sum(share.values()), 1e-9)) < 0.02)


def test_op8(spark, folder):
    from tokenizers import Tokenizer

    at, rows, _ = folder
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = got(spark, "op8_token_counts", at)
    for i, t in enumerate(rows):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def test_op9(spark, folder):
    at, rows, _ = folder
    out = got(spark, "op9_toxicity", at)
    own = {i: y for i, _, y in corpus()[1] if not held_out(i)}
    assert np.allclose([out[i].score for i in range(len(rows))], brute_scores(rows, own, rows), atol=1e-6)
    assert all(r.held_out == held_out(i) and r.predicted == int(r.score >= 0.3) for i, r in out.items())


def test_op10(spark, folder):
    at, rows, _ = folder
    out, want = got(spark, "op10_near_dedup", at), brute_components(rows, 2)
    assert {i: r.component_id for i, r in out.items()} == want and all(r.kept == (want[i] == i) for i, r in out.items())


def test_op1_op7(spark, folder):
    at, _, _ = folder
    rows = QUERIES["op1_chat_formatting"](spark, at).collect()
    assert len(rows) == 120 and all(r.role_pred == ("user", "assistant")[r.turn % 2] and r.held_out == held_out(r.conv_id) for r in rows)
    out = got(spark, "op7_url_filter", at)
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(3)] == [("a.net", "/x", "net/", "block"), ("", "", None, "allow"), ("q.org", "/fr/1", "org/fr/", "allow")]


def test_pipeline(spark, folder):
    at, rows, _ = folder
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    kept = [i for i, r in got(spark, "op3_quality_rules", at).items() if r.kept]
    lines = dict(zip(sorted(kept), brute_lines([rows[i] for i in sorted(kept)], 10), strict=True))
    ids = sorted(kept)
    comp = brute_components([lines[i] for i in ids], 5)
    left = [ids[j] for j in range(len(ids)) if comp[j] == j]
    import re

    def sh(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    item = sh(rows[150].split("\n")[0])
    want = [i for i in left if not item or len(item & sh(lines[i])) < 0.8 * len(item)]
    assert sorted(out) == want and len(want) < len(left) < len(ids) < len(rows)
    c = sentencepiece.codec(P.path("piece_bpe_32k.model"))
    assert all(out[i].text == lines[i] and c.decode(out[i].ids) == lines[i] and out[i].n_ids == len(out[i].ids) and out[i].n_chars == len(lines[i]) for i in want)


def test_empty_tables(spark, folder, tmp_path):
    at = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark", "conversations", "pages"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    for name, q in QUERIES.items():
        assert q(spark, at).count() == 0, name
    assert corpus_pipeline.run(spark, at).count() == 0


def test_clashing_columns(spark):
    """Names with a dot, in another letter case, or that operators give out themselves stay as they are or are replaced."""
    from pyspark.sql import functions as F

    from fieldcast.llm import decontaminate, line_dedup, near_dedup

    rows = [*texts(12, 4, 60, 90), *ODD]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({c: F.lit(c) for c in ("a.b", "r1", "comp", "c0", "code", "set", "item_id")})
    bench = spark.createDataFrame([(0, rows[0])], "item_id long, text string")
    path = P.path("piece_bpe_32k.model")
    for out in (quality.keep_good(df), near_dedup.drop_near_duplicates(df), decontaminate.drop_contaminated(df, bench)):
        assert out.columns == df.columns and all(r["a.b"] == "a.b" and r.c0 == "c0" for r in out.collect())
    more = df.withColumns({"N_Lines": F.lit(1), "IDS": F.lit(1)})
    assert sorted(line_dedup.dedup_lines(more).columns) == sorted([*df.columns, "IDS", "n_lines", "n_dropped"])
    assert sentencepiece.encode(more, path).columns == [*df.columns, "N_Lines", "ids", "n_ids"]
    assert sentencepiece.encode(more, path).count() == sentencepiece.decode(sentencepiece.encode(more, path), path).where(F.col("text") == F.coalesce("text", F.lit(""))).count()
