"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures, each link confirmed on the full shingle sets.

A signature is POSITIONS MinHash values of 8 bits. Texts of Jaccard similarity 0.8 differ in a fifth of the positions
on average, and in more than DISTANCE of them once in some 100,000 pairs. The positions are split into CHUNKS of five:
by the pigeonhole principle, two signatures within DISTANCE differ in one position at most inside some chunk, since
2 * CHUNKS > DISTANCE. So each chunk is indexed five times, each time without one position, and equal keys give all
pairs within the distance.

Pairs of a bucket are never all made. First each text is compared to one other, the smallest of all that it shares a
bucket with. Components of what is linked then count as one, and each is compared to a few members of others that it
shares buckets with. What still lies in different components, and shares enough with any others at all, is
compared in full through an index of rare shingles, with filters by place and size inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from fieldcast.llm.common import fresh, stored, stored_count, table

CHUNK, CHUNKS = 5, 19
POSITIONS, WORDS_OF_8 = CHUNK * CHUNKS, 12
#: Signatures that differ in more positions are not compared.
DISTANCE = 2 * CHUNKS - 1
#: Pairs by which a component is compared to those before it, before all is compared in full.
TRIES = 8
#: Rare shingles before a place in their order by which a pair that was met before is known; only repeats are saved.
BEFORE = 32
#: Classes whose bucket keys one task makes, about: each has POSITIONS keys, which a task counts in memory.
CLASSES_A_TASK = 8192
#: Rows that a task turns into sets at a time.
ROWS = 256
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_SIG = [f"s{i}" for i in range(WORDS_OF_8)]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words are runs of [^\\x20\\x09-\\x0D].

    With fewer words the whole sequence is one shingle; without words, or for null, the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS values of 8 bits, as WORDS_OF_8 numbers."""
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 2048):
        np.minimum(least, (np.multiply.outer(shingles[a : a + 2048], _A) + _B).min(0), out=least)
    out = np.zeros(WORDS_OF_8 * 8, np.uint8)
    out[:POSITIONS] = (least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)
    return out.view(np.int64)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """signatures: n by WORDS_OF_8. n by POSITIONS: for each position the other positions of its chunk, with its number in front."""
    parts = np.ascontiguousarray(signatures).view(np.uint8)[:, :POSITIONS].reshape(-1, CHUNKS, CHUNK).astype(np.int64)
    out = np.empty((len(signatures), CHUNKS, CHUNK), np.int64)
    for i in range(CHUNK):
        others = [j for j in range(CHUNK) if j != i]
        out[:, :, i] = sum(parts[:, :, j] << 8 * n for n, j in enumerate(others))
    return out.reshape(-1, POSITIONS) | np.arange(POSITIONS, dtype=np.int64) << 32


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(first, rows) for first in range(0, b.num_rows, rows))


def _buckets(classes: DataFrame) -> DataFrame:
    """(node, key): a row for each class and position. Classes are short and their keys many, so they are dealt out by number first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 1024):
            keys = bucket_keys(np.column_stack([b.column(i + 1).to_numpy() for i in range(WORDS_OF_8)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), POSITIONS)), pa.array(keys.ravel())], ["node", "key"])

    dealt = classes.select("node", *_SIG).repartition(classes.count() // CLASSES_A_TASK + 1, "node")
    return dealt.mapInArrow(task, "node long, key long")


def signature_distance(a: str, b: str) -> Column:
    """In how many positions the signatures in the columns prefixed a and b differ."""
    total = F.lit(0)
    for s in _SIG:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(x)
    return total


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node reachable.

    Labels take the smallest of their neighbours' and then jump to their label's label, until nothing changes.
    Every round is written out; nothing but its count of changes reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "to"), f"{name}-edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("comp")), f"{name}-labels")
    changed = 1
    while changed:
        near = both.join(labels.withColumnsRenamed({"node": "to"}), "to").groupBy("node").agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        rows = low.join(jump, "comp", "left").select("node", "was", F.least("comp", "top").alias("comp"))
        labels, changed = stored_count(rows, f"{name}-labels", F.col("comp") < F.col("was"))
        labels = labels.select("node", "comp")
    return labels


def _measured(docs: DataFrame, keys: list[str], text: str, k: int) -> DataFrame:
    """keys, n (size of the set), d1, d2 (digest of the set) and the signature of each row."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keys}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["n long", "d1 long", "d2 long"] + [f"{s} long" for s in _SIG])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, ROWS):
            sizes, digests, sigs = [], np.zeros((b.num_rows, 2), np.int64), np.zeros((b.num_rows, WORDS_OF_8), np.int64)
            for i, x in enumerate(b.column(len(keys)).to_pylist()):
                s = shingle_set(x, k)
                sizes.append(len(s))
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                if len(s):
                    sigs[i] = signature(s)
            made = [pa.array(sizes, pa.int64()), *(pa.array(c) for c in digests.T.copy()), *(pa.array(c) for c in sigs.T.copy())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keys))] + made, [*keys, "n", "d1", "d2", *_SIG])

    return docs.select(*keys, text).mapInArrow(task, schema)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """texts (any columns, text last) with the column set in place of text."""
    kept = texts.columns[:-1]
    schema = texts.drop("text").schema.add("set", ArrayType(LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, ROWS):
            sets = [shingle_set(x, k) for x in b.column(len(kept)).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], [*kept, "set"])

    return texts.mapInArrow(task, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The rows of pairs (a, b, ca, cb) whose signatures are within DISTANCE and for which 100 * intersection >=
    percent * union on the full sets; and whether there are any."""
    side = lambda x: sets.select(*[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", *_SIG, "set")])
    fits = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (signature_distance("a_", "b_") <= DISTANCE)
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node")).where(fits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "ca", "cb"]).filter(pa.array(ok, pa.bool_()))

    return stored_count(both.select("a", "b", "ca", "cb", "a_set", "b_set").mapInArrow(task, "a long, b long, ca long, cb long"), "links", F.lit(True))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with comp, which is the node itself where it has no label."""
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _by_key(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of left, a stored table, with right, which has one row for each key.

    right is stored first: between two plain shuffles a key that holds a large part of left is split over tasks.
    """
    return left.join(stored(right, "keyed"), on)


def _shares(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, c, signature): the size of each set, and how many of its shingles some other set has too.

    Sets that could not reach the similarity with any other are left out: they have no links. In a large group of near
    copies these are the copies with many changes of their own, which would else be compared to many others.
    """
    alone = sets.select("node", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    got = sets.drop("set").join(own, "node", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return got.where(100 * F.col("c") >= percent * F.col("n"))


def _next_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, ca, cb): each component with TRIES members of earlier ones that it shares keys with, those nearest by
    signature. Earlier are components of several members before single ones, and smaller names before others.

    For each key a component is stood for by the member with the largest share of shingles that others have too, and by
    one picked by hash, another in each key. rows: key, node, comp, n, c, signature.
    """
    own = F.struct("node", *_SIG)
    best, some = [-(F.col("c") / F.col("n")), F.col("node")], [F.xxhash64("node", "key"), F.col("node")]
    stand = [F.min_by(own, F.struct(*o)).alias(x) for x, o in (("best", best), ("some", some))]
    met = stored(rows.groupBy("key", F.col("single"), "comp").agg(*stand), "met")
    ends = met.groupBy("key").agg(F.min(F.struct("single", "comp", "best", "some")).alias("low"))
    asks = _by_key(met, ends, ["key"]).where("comp <> low.comp")
    asks = asks.select("comp", F.col("low.comp").alias("cb"), F.col("some").alias("a"), F.explode(F.array_distinct(F.array("low.best", "low.some"))).alias("b"))
    near = asks.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("comp").alias("ca"), "cb", signature_distance("a.", "b.").alias("d")).distinct()
    nearest = F.row_number().over(Window.partitionBy("ca").orderBy("d", "a", "b"))
    return near.withColumn("rank", nearest).where(F.col("rank") <= TRIES).select("a", "b", "ca", "cb")


def _rare_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): the nodes of different components that can still have a link, by their rarest shingles.

    Sets of n that reach the similarity share one of the n - ceil(percent n / 100) + 1 rarest of each, in any common
    order; at the first that they share, at places i and j, no more than 1 + min(n - i, m - j) - 1 are shared in all.
    Shingles of one set alone come first in the order and make no pair. rest: node, comp, n, signature.
    """
    tokens = stored(sets.join(rest, "node", "left_semi").select("node", "n", F.explode("set").alias("h")), "tokens")
    df = tokens.groupBy("h").agg(F.count("*").alias("df"))
    ordered = _by_key(tokens, df, ["h"]).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))
    rarest = F.slice("all", F.lit(1), (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("int"))
    # The shared ones just before a place: a pair that shares one of these has been met there.
    before = lambda i: F.transform(F.filter(F.slice("all", F.greatest(i - (BEFORE - 1), F.lit(1)), F.least(i, F.lit(BEFORE))), lambda x: x["df"] > 1), lambda x: x["h"])
    # Made inside the array, so that no row holds all of its set.
    places = F.transform(rarest, lambda x, i: F.struct(i.alias("i"), x["df"].alias("df"), x["h"].alias("h"), before(i).alias("before")))
    placed = ordered.select("node", F.inline(F.filter(places, lambda x: x["df"] > 1))).drop("df")
    placed = stored(placed.join(rest, "node"), "rarest")
    # The largest set that a set of n can reach the similarity with, from its place i on; a key without such a set goes.
    top = ((100 + percent) * (F.col("n") - F.col("i")) - percent * F.col("n")) / percent
    keys = placed.groupBy("h").agg(F.min("n").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    kept = stored(_by_key(placed, keys.select("h", "least"), ["h"]).where(top >= F.col("least")).drop("least"), "rarest")
    side = lambda x: kept.select("h", *[F.col(c).alias(f"{x}{c}") for c in kept.columns if c != "h"])
    most = F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi"))
    apart = (F.col("acomp") < F.col("bcomp")) & ((100 + percent) * most >= percent * (F.col("an") + F.col("bn")))
    left, right = side("a"), side("b")
    again = F.arrays_overlap("abefore", "bbefore")
    met = left.join(right, (left["h"] == right["h"]) & apart & ~again & (signature_distance("a", "b") <= DISTANCE))
    return met.select(F.col("anode").alias("a"), F.col("bnode").alias("b"), F.col("acomp").alias("ca"), F.col("bcomp").alias("cb")).distinct()


def link_classes(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, comp) of the classes that have a link to an earlier one: classes has node, n, r1, r2 and the signature, texts
    r1, r2, text."""
    buckets = _buckets(classes)
    # Most keys are one class's own; these go before anything else is done.
    shared = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    buckets = stored(buckets.join(shared, "key"), "buckets")
    wanted = classes.join(buckets, "node", "left_semi").select("node", "n", *_SIG, "r1", "r2")
    own = wanted.join(texts.select("r1", "r2", "text"), ["r1", "r2"]).select("node", "n", *_SIG, "text")
    sets = stored(_sets(own, k).dropDuplicates(["node"]), "sets")

    # First each node is compared to one other: the smallest of all that share a key with it.
    first = buckets.groupBy("node").agg(F.min("low").alias("b")).where("b < node")
    links, some = _confirmed(first.select(F.col("node").alias("a"), "b", F.col("node").alias("ca"), F.col("b").alias("cb")), sets, percent)
    labels = rooted(links.select(F.col("ca").alias("node"), F.col("cb").alias("comp")))
    rows = stored(_labelled(buckets.select("key", "node"), labels), "labelled")
    # Keys with members in several components go on, without those members that cannot have a link at all.
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    rows, more = stored_count(_by_key(rows, several, ["key"]), "unsettled", F.lit(True))
    if not more:
        return labels
    shares = stored(_shares(sets.join(rows, "node", "left_semi"), percent), "shares")
    single = rows.groupBy("comp").agg((F.min("node") == F.max("node")).alias("single"))
    met = stored(_by_key(rows, single, ["comp"]).join(shares, "node"), "unsettled")
    links, some = _confirmed(_next_pairs(met), sets, percent)
    if some:
        # Each component joins one earlier one that it has a link to.
        up = rooted(links.groupBy("ca").agg(F.min("cb").alias("comp")).withColumnRenamed("ca", "node"))
        labels = stored(_moved(labels, up), "labels")
    # What still lies in different components is compared in full, by rare shingles.
    rest = stored(_labelled(shares.drop("c"), labels), "rest")
    links, some = _confirmed(_rare_pairs(rest, sets, percent), sets, percent)
    return _moved(labels, components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "last").where("comp <> node")) if some else labels


def rooted(up: DataFrame) -> DataFrame:
    """(node, comp) of a table of trees, (node, comp) with comp the node above: comp becomes the root, by jumps of doubling
    length. Roots have no row. Nothing but the count of changes reaches the driver."""
    labels, changed = stored(up, "trees"), 1
    while changed:
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        both = labels.join(above, "comp", "left").select("node", F.col("comp").alias("was"), F.coalesce("top", "comp").alias("comp"))
        labels, changed = stored_count(both, "trees", F.col("comp") != F.col("was"))
        labels = labels.select("node", "comp")
    return labels


def _moved(labels: DataFrame, up: DataFrame) -> DataFrame:
    """labels after their roots have got roots of their own, in up."""
    moved = labels.join(up.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return moved.unionByName(up)


def _grouped(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """doc_id as id, r1, r2 (the row's own key), n and comp (null for an empty set), one row for each row of docs."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumns({"r1": F.xxhash64("id", "text"), "r2": F.xxhash64("text", "id", F.lit(1))})
    rows = stored(_measured(keyed, ["id", "r1", "r2"], "text", k), "signatures")
    # Equal sets are one class from here on.
    least = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "r1", "r2", "n", *_SIG)).alias("v")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(least).select("d1", "d2", "v.r1", "v.r2", "v.n", *[f"v.{s}" for s in _SIG])
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = _labelled(classes.select("d1", "d2", "node"), link_classes(classes, keyed, k, percent)).select("d1", "d2", "comp")
    rows = rows.select("id", "r1", "r2", "n", "d1", "d2")
    some = _by_key(rows.where("n > 0"), named, ["d1", "d2"])
    return some.unionByName(rows.where("n = 0").withColumn("comp", F.lit(None).cast("long"))).drop("d1", "d2")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id is component_id).

    * Null and empty texts, and those without words, have an empty set and are linked with nothing. With fewer than k
      words the whole sequence is the only shingle.
    * Just percent % is a link. Repeated rows and equal texts are one class and so linked. A null doc_id is never the
      smallest; where a component has no other, component_id is null and kept true. Empty table: no rows.
    * Only the two named columns are read.
    """
    rows = stored(_grouped(docs, doc_id, text, k, percent), "grouped")
    some = rows.where("comp is not null")
    least = some.groupBy("comp").agg(F.min("id").alias("component"))
    out = _by_key(some, least, ["comp"]).unionByName(rows.where("comp is null").withColumn("component", F.col("id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id, with all its columns; of rows with equal id and
    text one stays. Rows with an empty set all stay, but for such repeats."""
    r1, r2, m1, m2 = fresh(docs.columns, "r1", "r2", "m1", "m2")
    rows = stored(_grouped(docs, doc_id, text, k, percent), "grouped")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "r1", "r2")).alias("v")).select("v.r1", "v.r2")
    kept = stored(first.unionByName(rows.where("comp is null").select("r1", "r2")).groupBy("r1", "r2").count(), "kept")
    again = stored(rows.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2").join(kept, ["r1", "r2"], "left_semi"), "repeats")
    keyed = docs.withColumns({r1: F.xxhash64(f"`{doc_id}`", f"`{text}`"), r2: F.xxhash64(f"`{text}`", f"`{doc_id}`", F.lit(1))})
    of = lambda keys: keys.select(F.col("r1").alias(m1), F.col("r2").alias(m2))
    same = (F.col(r1) == F.col(m1)) & (F.col(r2) == F.col(m2))
    out = keyed.join(of(kept), same, "left_semi")
    if again.limit(1).count():  # rows with equal id and text: one of each
        out = out.join(of(again), same, "left_anti").unionByName(keyed.join(of(again), same, "left_semi").dropDuplicates([r1, r2]))
    return out.drop(r1, r2)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
