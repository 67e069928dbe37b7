"""Brute-force versions and edge cases of the training-data operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from fieldcast.llm import chat, decontaminate, language_id, line_dedup, near_dedup, quality, sentencepiece, token_counts, toxicity, url_filter  # noqa: E402
from fieldcast.llm.common import in_fold  # noqa: E402

WORDS = "the of and tion ing er re th ha on en thea wh ould river stone cloud paper glass lamp table chair".split()
#: Nulls, empty texts, only blanks, one word, ties and repeats.
ODD = [None, "", " \t\n", "one", "two words", "two words", "A\n\nB\n", "é" * 40]


def texts(n: int, seed: int = 0, low: int = 5, high: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(rng.randint(low, high))) for _ in range(n)]


def frame(spark, rows: list, extra: bool = False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    # names that operators use themselves
    return df.withColumns({c: F.lit(c) for c in ("n_lines", "kept", "score", "ids", "r1", "comp", "key", "code", "made")}) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- line dedup


def brute_lines(rows: list, least: int) -> list[str]:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    n = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or n[key(x)] < least) for t in rows]


@pytest.mark.parametrize("limit", [100_000, 1])
def test_line_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_ROWS", limit)
    rng = random.Random(1)
    shared = [" Common Line ", "common line", "OTHER", "other\t", "x", ""]
    rows = ["\n".join(rng.choice([*shared, *texts(1, rng.random(), 2, 4)]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ODD
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows, True), min_docs=5).collect()}
    assert [got[i].text for i in range(len(rows))] == brute_lines(rows, 5)
    assert got[0].kept == "kept" and all(got[i].n_lines == (t or "").count("\n") + 1 for i, t in enumerate(rows))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a\nb"), (None, "a\nb"), (1, "a")], "doc_id long, text string")
    got = line_dedup.dedup_lines(df, min_docs=3).collect()
    assert sorted(r.text for r in got) == ["", "b", "b"] and sum(r.n_dropped for r in got) == 3


# ---- quality


def brute_features(text: str) -> tuple[int, int, int, int, int]:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_features_and_edges(spark):
    rows = [*texts(40, 3), *[t + "\n" + t for t in texts(5, 4)], "a b c a b c", "# ** $x | <y>", *ODD, " \x1c x ", "日本 語 日本 語 日本 語"]
    for t in rows:
        assert quality.features(t)[:5] == brute_features(t), t
    got = {r.doc_id: r for r in quality.score_documents(frame(spark, rows, True).drop("kept", "code"), ["doc_id"]).collect()}
    assert all(got[i].base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0]) for i, t in enumerate(rows) for f in [brute_features(t)])
    assert all(0 <= r.p_good <= 1 and not (r.kept and r.base_failed) for r in got.values())
    assert quality.score_documents(empty(spark), ["doc_id"]).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_em_recovers_classes():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, 8)) < np.where(good, 0.02, 0.4)[:, None], quality.BAD, np.where(rng.random((20000, 8)) < 0.8, quality.GOOD, quality.ABSTAIN))
    codes = (votes * 3 ** np.arange(7, -1, -1)).sum(1)
    u, n = np.unique(codes, return_counts=True)
    share, p = quality.fit(u, n.astype(float))
    assert abs(share - 0.8) < 0.03 and abs(p[0, 1, quality.BAD] - 0.4) < 0.05
    assert ((quality.posterior(codes, share, p) > 0.5) == good).mean() > 0.95


def test_keep_good_keeps_columns(spark):
    rows = [*texts(30, 5, 60, 90), *[" ".join(f"{w}###" for w in t.split()) for t in texts(10, 6, 60, 90)]]
    df = frame(spark, rows, True)
    got = quality.keep_good(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} <= set(range(30))


# ---- near dedup and decontamination


def brute_components(rows: list, k: int) -> dict[int, int]:
    sets = {}
    for i, t in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and 100 * m >= 80 * (len(sets[i]) + len(sets[j]) - m):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def near_copies(seed: int = 7) -> list:
    rng = random.Random(seed)
    rows = texts(30, seed, 30, 80)
    for base in rows[:6]:
        for _ in range(12):
            w = base.split()
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [w[at], w[at]]])
            rows.append(" ".join(w))
    return rows + [rows[0], rows[1].upper()] + ODD


@pytest.mark.parametrize("tries", [8, 0])
def test_near_dedup(spark, monkeypatch, tries):
    monkeypatch.setattr(near_dedup, "TRIES", tries)
    rows = near_copies()
    want = brute_components(rows, 2)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows, True), k=2).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) for i, r in got.items()) and got[len(rows) - 8].n_shingles == 0


def test_drop_near_duplicates_and_empty(spark):
    rows = near_copies(8)
    df = frame(spark, rows, True)
    got = near_dedup.drop_near_duplicates(df, k=2)
    want = brute_components(rows, 2)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    twice = near_dedup.drop_near_duplicates(df.limit(3).union(df.limit(3)), k=2)
    assert twice.count() == 3
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_bucket_keys_are_dealt_out_by_classes(spark, monkeypatch):
    """A few classes lie in one small file, and have POSITIONS keys each: no task makes those of many."""
    monkeypatch.setattr(near_dedup, "CLASSES_A_TASK", 8)
    sigs = {n: near_dedup.signature(near_dedup.shingle_set(t, 2)) for n, t in enumerate(texts(64, 21, 30, 60))}
    classes = spark.createDataFrame([(n, *map(int, s)) for n, s in sigs.items()], "node long, " + ", ".join(f"s{i} long" for i in range(12))).coalesce(1)
    rows = near_dedup._buckets(classes).withColumn("task", F.spark_partition_id()).collect()
    want = {(n, int(key)) for n, s in sigs.items() for key in near_dedup.bucket_keys(s[None]).ravel()}
    assert {(r.node, r.key) for r in rows} == want and len(rows) == len(want) == 64 * near_dedup.POSITIONS
    assert max(Counter(r.task for r in rows).values()) <= 24 * near_dedup.POSITIONS


def test_places_of_rare_shingles_do_not_hold_the_whole_set(spark, monkeypatch):
    """Long sets that share a part: what is exploded has a short array a row, and the pairs are those of the full comparison."""
    made = []
    stored = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: made.append((name, df)) or stored(df, name))
    base = " ".join(f"w{i}" for i in range(600))
    rows = [base, base.replace("w300 ", "other ").replace("w10 ", "more "), base.replace("w50 ", "x "), " ".join(f"v{i}" for i in range(500))]
    sets = [near_dedup.shingle_set(t, 2).view(np.int64) for t in rows]
    sigs = [near_dedup.signature(s.view(np.uint64)) for s in sets]
    names = ", ".join(f"s{i} long" for i in range(12))
    whole = spark.createDataFrame([(i, len(s), *map(int, g), list(map(int, s))) for i, (s, g) in enumerate(zip(sets, sigs))], f"node long, n long, {names}, set array<long>")
    rest = whole.drop("set").withColumn("comp", F.col("node"))
    pairs = near_dedup._rare_pairs(rest, whole, 80)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    plan = next(df for name, df in made if name == "rarest")._jdf.queryExecution().optimizedPlan().toString()
    assert "all#" in plan and "all#" not in plan.split("Generate")[0]


def test_signature_distance(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 4, (20, 96)).astype(np.uint8) for _ in range(2))
    rows = [[*map(int, x.view(np.int64)), *map(int, y.view(np.int64))] for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, ", ".join(f"a_s{i} long" for i in range(12)) + ", " + ", ".join(f"b_s{i} long" for i in range(12)))
    got = [r.d for r in df.select(near_dedup.signature_distance("a_", "b_").alias("d")).collect()]
    assert got == (a != b).sum(1).tolist()


def test_decontamination(spark):
    docs = texts(40, 9, 30, 200)
    items = [" ".join(docs[3].split()[5:25]), docs[7].upper() + "!", " ".join([*docs[9].split()[:9], "new", *docs[9].split()[10:20]]), "too short", None, "", *texts(5, 10, 8, 20)]
    import re

    def sh(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(i, j) for i, d in enumerate(docs + ODD) for j, q in enumerate(items) if sh(q) and len(sh(q) & sh(d)) >= 0.8 * len(sh(q)) - 1e-9}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, docs + ODD, True)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contained(df, bench, ["doc_id"]).collect()}
    assert got == want and {(3, 0), (7, 1)} <= want
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(range(len(docs + ODD))) - {i for i, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contained(df, none, ["doc_id"]).count() == 0 and decontaminate.find_contained(empty(spark), bench, ["doc_id"]).count() == 0


# ---- language, urls, tokens


def test_language(spark):
    rng = random.Random(0)
    make = {"aa": "kabo rilu mesa tofi".split(), "bb": "strong whelp gnash brisk".split(), "cc": "éclou naïve öster würde".split()}
    rows = [(i, " ".join(rng.choice(make[l]) for _ in range(20)), l) for i in range(120) for l in [rng.choice(list(make))]]
    df = spark.createDataFrame([*rows, (200, None, "aa"), (201, "123 !", None), (202, "kab", None)], "doc_id long, text string, lang string")
    model = language_id.train(df.where(~in_fold(F.col("doc_id"))), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("score", F.lit("x")), model).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows) and got[200].lang_pred == got[201].lang_pred == "und" and got[202].score >= 0
    long = "kabo rilu " * 200_000
    assert model.predict([long, "kabo rilu", long])[0] == ["aa"] * 3
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.train(df.limit(0), "doc_id", "text", "lang").predict(["a"])[0] == ["und"]


def test_bit_sliced_filter_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64)
    f = language_id.LanguageFilters({f"l{i:02}": h[i::11] for i in range(11)}, 1 << 14)
    for i in range(11):
        assert (f.containing(h[i::11])[:, i >> 3] >> (i & 7) & 1).all()


def test_urls(spark):
    urls = ["http://a.b.NET/x", "https://net", "http://www.example.net/en/1?q", "http://example.net/EN/", "x://example.com/de/#f", "ftp://sub.org/fr/", "http://org/frx", "no", None, "http://badnet/", "a://b://net/", "http://example.net.org/fr/?a#b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    rules = [(v, *url_filter.split_rule(r), r) for v, r in url_filter.RULES]
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            import re

            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0].lower()
            path = re.split(r"[?#]", rest[len(host) :])[0]
        fit = sorted((len(r), r, v) for v, h, p, r in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert got[i] == (host, path, fit[-1][1] if fit else None, fit[-1][2] if fit else "allow"), u
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    rng = random.Random(0)
    keys = [f"k{i}" for i in range(20000)]
    listed = rng.sample(keys, 700)
    cascade = url_filter.build(listed, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert len(cascade.levels) > 1 and {k for k in keys if k in cascade} == set(listed)


@pytest.mark.parametrize("heavy", [1, 1000])
def test_token_counts(spark, monkeypatch, heavy):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "HEAVY", heavy)
    path = P.path("byte_bpe_50k.json")
    rows = [*texts(40, 11), "a   b\n\n  c<|endoftext|> it's 12345 日本語 naïve\t!?", "<|endoftext|><|endoftext|>", "x" * 5000, " \u3000\xa0 \x85", *ODD]
    tok = Tokenizer.from_file(path)
    want = [len(tok.encode(t or "", add_special_tokens=False)) for t in rows]
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, rows, True), ["doc_id"], path).collect()}
    assert [got[i].n_tokens for i in range(len(rows))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 1024) for i, t in enumerate(rows))
    twice = token_counts.count_tokens(frame(spark, rows[:3]).union(frame(spark, rows[:3])), ["doc_id"], path)
    assert twice.count() == 6 and token_counts.count_tokens(empty(spark), ["doc_id"], path).count() == 0


def full_viterbi(p, text: str) -> list[int]:
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for i, c in enumerate(text):
        if c not in p.score:
            ids = tuple(p.bytes[b] for b in c.encode())
            if best[i] + p.byte_score * len(ids) > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + p.byte_score * len(ids), (i, ids)
        for n in range(1, min(p.longest, len(text) - i) + 1):
            g = p.score.get(text[i : i + n])
            if g and best[i] + g[0] > best[i + n]:
                best[i + n], back[i + n] = best[i] + g[0], (i, (g[1],))
    out, j = [], len(text)
    while j:
        j, ids = back[j]
        out.append(ids)
    return [x for y in reversed(out) for x in y]


def test_sentencepiece(spark):
    c = sentencepiece.codec(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    rows = ["".join(rng.choice("abcdethn  \n\té日ﬁ①😀█▁") for _ in range(rng.randint(0, 90))) for _ in range(80)] + ODD
    for t in rows:
        assert c.decode(c.encode(t)) == (t or "")
        if t and sentencepiece.MARK not in t:
            m = sentencepiece.MARK + t.replace(" ", sentencepiece.MARK)
            v, out = sentencepiece.StreamingViterbi(c.pieces), []
            for ch in m:
                out += v.feed(ch)
            assert out + list(v.end()) == full_viterbi(c.pieces, m) == list(c.encode(t))
    path = P.path("piece_bpe_32k.model")
    got = sentencepiece.decode(sentencepiece.encode(frame(spark, rows, True), path), path)
    assert {r.doc_id: r.text for r in got.collect()} == {i: t or "" for i, t in enumerate(rows)}
    assert sentencepiece.encode(empty(spark), path).count() == 0


@pytest.mark.parametrize("cuts", [True, False])
def test_streaming_viterbi_commits_early(cuts, monkeypatch):
    c = sentencepiece.Codec(P.path("piece_bpe_32k.model"))
    c.pieces.cuts = cuts
    prose = sentencepiece.MARK + texts(1, 21, 400, 400)[0].replace(" ", sentencepiece.MARK)
    v, out, before = sentencepiece.StreamingViterbi(c.pieces), [], 0
    for ch in prose:
        out += v.feed(ch)
        assert len(v.window) <= 4 * c.pieces.longest + 1
    assert len(out) > 0.9 * len(full_viterbi(c.pieces, prose)) and v.commits > 50
    assert out + list(v.end()) == full_viterbi(c.pieces, prose)
    # one word without an end
    rng = random.Random(5)
    long = "".join(rng.choice("abcdethn") for _ in range(1_000_000 if cuts else 30_000))
    v, out, most = sentencepiece.StreamingViterbi(c.pieces), [], 0
    for i in range(0, len(long), 50):
        out += v.feed(long[i : i + 50])
        most = max(most, len(v.window), len(v.best))
    out += v.end()
    assert most < 16 * c.pieces.longest and b"".join(c.pieces.raw[i] for i in out).decode() == long
    # the same in one feed, and against the whole lattice as far as that can be held
    whole = sentencepiece.StreamingViterbi(c.pieces)
    assert [*whole.feed(long), *whole.end()] == out
    assert [*whole.feed(long[:30_000]), *whole.end()] == full_viterbi(c.pieces, long[:30_000])


# ---- toxicity and chat


def indexed(df: dict, total: int, examples: list[Counter], toxic: np.ndarray, k: int):
    """An index of word counts, each example one row."""
    import pyarrow as pa

    own = toxicity.Examples.of(pa.array([list(x) for x in examples], pa.list_(pa.string())), pa.array([list(x.values()) for x in examples], pa.list_(pa.int32())), np.ones(len(examples), int), toxic)
    return toxicity.BlockMaxIndex(own, np.array([df.get(w, 0) for w in own.words.to_pylist()]), total, k)


def dense(index, counts: list[Counter]) -> np.ndarray:
    """The same vectors by their definition, over the whole vocabulary."""
    out = np.zeros((len(counts), len(index.words)))
    for row, c in zip(out, counts, strict=True):
        for w, n in c.items():
            if w in index.terms.known:
                row[index.terms.known[w]] = (1 + np.log(n)) * index.weight[index.terms.known[w]]
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


@pytest.mark.parametrize("vocabulary, k", [(60, 7), (2000, 24), (12, 3)])
def test_block_max_is_exact(vocabulary, k):
    rng = random.Random(3)
    words = ["w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(vocabulary)]
    examples = [Counter(rng.choices(words, k=rng.randint(0, 30))) for _ in range(500)]
    toxic = np.array([rng.random() < 0.2 for _ in examples], int)
    index = indexed({w: rng.randint(1, 900) for w in words}, 1000, examples, toxic, k)
    index.vector("")
    held = dense(index, examples)[index.example]
    for _ in range(60):
        c = Counter(rng.choices(words, k=rng.randint(1, 25)))
        cos = held @ dense(index, [c])[0]
        place, got = index.nearest(*index.vector(" ".join(c.elements())))
        want = np.lexsort((np.arange(len(cos)), -cos.round(12)))[:k]  # ties: the lower place
        want = want[cos[want] > 0]
        assert np.allclose(got, cos[want]) and place.tolist() == want.tolist()


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random(4000)
    knots, values = toxicity.isotonic(x, (rng.random(4000) < x**2).astype(float), np.ones(4000), 0.3)
    assert (np.diff(values) >= 0).all() and abs(np.interp(0.7, knots, values) - 0.49) < 0.07


def toxic_rows(n: int = 300):
    rng = random.Random(12)
    rows = [" ".join("".join(rng.choices(WORDS, k=3)) for _ in range(rng.randint(20, 60))) for _ in range(n)]
    bad = set(range(0, n, 6))
    return [t + " vile rotten vile" if i in bad else t for i, t in enumerate(rows)], bad


def brute_scores(rows: list, labels: dict[int, int], texts_to_score: list) -> list[float]:
    """TF-IDF with relevance, cosine, votes and calibration, over dense vectors."""
    import re

    import xxhash

    count = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    sequence = lambda t: tuple(re.findall(r"[^\W\d_]+", (t or "").lower()))
    df = Counter(w for t in rows for w in count(t))
    seen: dict = {}
    for i in sorted(labels):
        one = seen.setdefault(sequence(rows[i]), [i, 0, 0])
        one[1], one[2] = one[1] + 1, one[2] + labels[i]
    ids, copies, toxic = (np.array(x) for x in zip(*seen.values(), strict=True))
    fold = np.array([xxhash.xxh3_64_intdigest(str(i)) % toxicity.CALIBRATE == 0 for i in ids])

    def votes(use: np.ndarray, queries: list[Counter]) -> list[float]:
        own, c, y = [count(rows[i]) for i in ids[use]], copies[use], toxic[use]
        base = (y.sum() + 1) / (c.sum() + 2)
        words = sorted({w for x in own for w in x})
        has = np.array([[w in x for w in words] for x in own], float)
        n, n1, m = len(own), (y > 0).sum(), has.sum(0)
        phi2 = np.nan_to_num((n * (has * (y > 0)[:, None]).sum(0) - m * n1) ** 2 / np.maximum(m * (n - m) * n1 * (n - n1), 1e-9))
        weight = (np.log((1 + len(rows)) / (1 + np.array([df[w] for w in words]))) + 1) * (phi2 * (m < n) + 1e-6)
        vec = lambda q: np.array([(1 + np.log(q[w])) if q[w] else 0 for w in words]) * weight
        unit = lambda v: v / (np.sqrt((v**2).sum()) or 1)
        held, out = np.array([unit(vec(x)) for x in own]), []
        for q in queries:
            v = unit(vec(q))
            if not v.any():
                none = [i for i, x in enumerate(own) if not x]
                out.append((y[none].sum() + base) / (c[none].sum() + 1))
                continue
            near = np.sort(-(held @ v))[: toxicity.NEIGHBOURS]
            at = np.argsort(-(held @ v), kind="stable")[: len(near)]
            w = np.maximum(-near, 0) ** 2
            out.append(((w * y[at]).sum() + 0.5 * base) / ((w * c[at]).sum() + 0.5))
        return out

    share = votes(~fold, [count(rows[i]) for i in ids[fold]])
    every = np.ones(len(ids), bool)
    knots, values = toxicity.isotonic(np.array(share), toxic[fold] / copies[fold], np.ones(fold.sum()), (toxic.sum() + 1) / (copies.sum() + 2))
    return np.interp(votes(every, [count(t) for t in texts_to_score]), knots, values).tolist()


def test_toxicity(spark):
    rows, bad = toxic_rows()
    rows += [*ODD, rows[1], rows[6], rows[6], "vile " * 200_000]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(300)] + [(309, 0), (310, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    df = frame(spark, rows, True).withColumns({"Evidence": F.lit("mine"), "a.b": F.lit(1)})
    learn = labels.where(~in_fold(F.col("doc_id")))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, toxicity.train(df.select("doc_id", "text"), learn)).collect()}
    assert all(got[i].predicted == int(i in bad) for i in range(300)) and all(0 <= r.score <= 1 for r in got.values()) and got[0].evidence
    own = {r.doc_id: r.toxic for r in learn.where("toxic is not null and doc_id is not null").collect()}
    want = brute_scores(rows, own, rows)
    assert np.allclose([got[i].score for i in range(len(rows))], want, atol=1e-6)
    assert got[301].score == got[300].score == got[302].score and got[len(rows) - 1].predicted == 1
    none = toxicity.train(df.select("doc_id", "text"), labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(df, none).collect())
    assert toxicity.score_toxicity(empty(spark), none).count() == 0


def brute_path(model, codes: list[int]) -> float:
    score = model.first + model.emit[:, codes[0]]
    for c in codes[1:]:
        score = (score[:, None] + model.after).max(0) + model.emit[:, c]
    return score.max()


@pytest.mark.parametrize("segment", [1024, 3])
def test_chat(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            role = ("user", "assistant")[turn % 2]
            long = rng.randint(3, 12) if role == "user" else rng.randint(30, 80)
            rows.append((conv, turn, role, ("User: " if role == "user" and rng.random() < 0.3 else "") + " ".join(rng.choice(WORDS) for _ in range(long))))
    rows += [(50, None, None, None), (50, 1, None, ""), (50, 1, None, ""), (None, 2, "user", "x?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("conv", "seg", "pos", "code")})
    placed = chat.sequenced(df.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    model = chat.train(placed, F.lit(True))
    got = chat.recover_roles(placed, model).collect()
    assert len(got) == len(rows)
    at, by = {r: i for i, r in enumerate(model.roles)}, defaultdict(list)
    for r in got:
        by[r.conv].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.seg, r.pos))
        states, codes = [at[r.role_pred] for r in own], [r.code for r in own]
        score = model.first[states[0]] + model.emit[states[0], codes[0]] + sum(model.after[a, b] + model.emit[b, c] for a, b, c in zip(states, states[1:], codes[1:], strict=False))
        assert abs(score - brute_path(model, codes)) < 1e-9
    out = chat.format_chats(df, F.lit(True)).collect()
    assert sum(r.role_pred == ("user", "assistant")[r.turn % 2] for r in out if r.conv_id is not None and r.conv_id < 40) > 0.95 * len(rows) - 4
    assert all(r.rendered.startswith(f"<|{r.role_pred}|>\n") and "User:" not in r.rendered for r in out)
    assert chat.format_chats(df.limit(0), F.lit(True)).count() == 0


def test_split_transcripts(spark):
    raw = spark.createDataFrame([(1, "User: hi\nthere\nAssistant: yes\nUSER: ok"), (2, None), (3, ""), (4, "no marker: at all")], "conv_id long, text string")
    got = chat.split_transcripts(raw).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.text and r.text.strip()) for r in got] == [(1, 0, "User: hi\nthere"), (1, 1, "Assistant: yes"), (1, 2, "USER: ok"), (2, 0, None), (3, 0, ""), (4, 0, "no marker: at all")]


def test_chat_ids_nulls_and_transcripts(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 2)
    big = 2**53 + 1
    rows = [(c, t, ("user", "assistant")[t % 2], "short?" if t % 2 == 0 else "a long answer " * 9) for c in (big, big + 1, big + 2) for t in range(6)]
    rows += [(None, t, ("user", "assistant")[t % 2], "short?" if t % 2 == 0 else "a long answer " * 9) for t in range(5)]
    rows += [(7, 0, "user", "User: hi?\nAssistant: " + "a long answer " * 9 + "\nUser: ok?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = chat.sequenced(df.withColumnRenamed("conv_id", "conv")).collect()
    assert len({r.seg for r in placed if r.conv is None}) == 3  # five messages of one conversation in segments of two
    got = chat.format_chats(df, F.lit(True)).collect()
    assert Counter((r.conv_id, r.turn) for r in got if r.conv_id != 7) == Counter((c, t) for c, t, _, _ in rows if c != 7)
    assert all(r.role_pred == ("user", "assistant")[r.turn % 2] for r in got if r.conv_id != 7)
    own = sorted((r.part, r.role_pred, r.rendered) for r in got if r.conv_id == 7)
    assert [x[:2] for x in own] == [(0, "user"), (1, "assistant"), (2, "user")] and own[2][2] == "<|user|>\nok?<|end|>\n"


def test_render_strips_one_marker_of_the_role(spark):
    cases = [("user", "User: Human: x", "Human: x"), ("user", "Context: the sea", "Context: the sea"), ("user", "You\nare late", "You\nare late"), ("assistant", "Question: what is it?", "Question: what is it?"), ("user", "### User\nhi", "hi"), ("assistant", "**Bot**: ok", "ok"), ("user", None, ""), ("system", "[system] be brief", "be brief")]
    df = spark.createDataFrame(cases, "role string, text string, want string")
    assert all(r.got == f"<|{r.role}|>\n{r.want}<|end|>\n" for r in df.select("*", chat.render(F.col("role"), F.col("text")).alias("got")).collect())


def test_digest_of_kept_lines(spark):
    got = line_dedup.dedup_lines(frame(spark, ["é\nA"])).select(F.sha2("text", 256).alias("h")).first().h
    assert got == hashlib.sha256("é\nA".encode()).hexdigest()
