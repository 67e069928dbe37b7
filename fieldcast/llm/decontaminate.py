"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only. A benchmark item's sketch is its smallest shingle hashes, just so many that a document
with the asked containment cannot miss them all. Items are partitioned by size; each partition has its own largest
sketch hash, and a document looks up only those of its shingles whose hash is under that bound for some partition
that it is long enough for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import fresh, stored, table

WORDS, CONTAINMENT = 5, 0.8
#: What separates words.
GAP = r"[^\p{L}\p{N}]+"


def _with(value: Column, f) -> Column:
    """f(value) with value worked out once, although a lambda in f names it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingles(text: Column, k: int = WORDS) -> Column:
    """Distinct hashes of the k-word shingles of a text: lower case, letters and digits only. Fewer words: none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")
    window = lambda hashes: F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)])
    )
    return F.array_distinct(_with(F.transform(words, lambda w: F.xxhash64(w)), window))


def _least(n: Column, containment: float) -> Column:
    """How many of n shingles a document must hold."""
    return F.ceil(F.round(F.lit(containment) * n, 9)).cast("int")


def item_sketches(items: DataFrame, item_id: str, text: str, k: int, containment: float) -> DataFrame:
    """(item_id, set, n, class, sketch): items of fewer than k words have no shingle and no row."""
    own = items.select(F.col(item_id).alias("item_id"), F.array_sort(shingles(F.col(text), k)).alias("set")).distinct()
    n = F.size("set")
    return own.where(n > 0).select(
        "item_id", "set", n.alias("n"), F.floor(F.log2(n.cast("double"))).cast("int").alias("class"),
        F.slice("set", F.lit(1), n - _least(n, containment) + 1).alias("sketch"),
    )


def find_contained(
    docs: DataFrame, items: DataFrame, doc_keys: list[str], item_id: str = "item_id", text: str = "text", item_text: str = "text", k: int = WORDS, containment: float = CONTAINMENT
) -> DataFrame:
    """doc_keys, item_id, n_shared, n_item, containment of each document and item of which it holds at least `containment`.

    All such pairs are found: an item of n shingles has the n - ceil(containment * n) + 1 smallest hashes as its
    sketch, and a document that holds ceil(containment * n) of them must hold one of the sketch.

    * Null, empty and short texts (fewer than k words) hold nothing and are held by nothing.
    * Repeated documents give a row each; repeated equal items give one row; items that share an id but not a text
      give a row each. At just `containment` a pair is found. Empty tables give no rows.
    * Only the named columns are read, so other columns may have any name.
    """
    sketches = stored(item_sketches(items, item_id, item_text, k, containment), "items")
    # A row for each size class of items: there are never more than 31.
    bounds = sketches.groupBy("class").agg(F.max(F.element_at("sketch", -1)).alias("bound")).collect()
    found = ["r1", "r2", "set", "item_id", "n_shared", "n_item", "containment"]
    names = fresh([*found, *doc_keys], *[f"k{i}" for i in range(len(doc_keys))])
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(doc_keys, names, strict=True)], F.col(f"`{text}`").alias("text"))
    keyed = keyed.withColumns({"r1": F.xxhash64(*names, "text"), "r2": F.xxhash64("text", *names, F.lit(1))})
    size = F.size("set")
    bound = F.greatest(*[F.when(size >= _least(F.lit(2**b["class"]), containment), F.lit(b["bound"])) for b in bounds], F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    looked = (
        keyed.select("r1", "r2", shingles(F.col("text"), k).alias("set"))
        .select("r1", "r2", _with(F.struct("set", bound.alias("bound")), lambda x: F.filter(x["set"], lambda h: h <= x["bound"])).alias("low"))
        .select("r1", "r2", F.explode("low").alias("h"))
    )
    sketch = stored(sketches.select(F.explode("sketch").alias("h"), "item_id", "n"), "sketches")
    pairs = stored(looked.join(sketch, "h").select("r1", "r2", "item_id", "n").distinct(), "candidates")
    texts = keyed.join(pairs.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi").withColumn("set", shingles(F.col("text"), k)).drop("text")
    shared = F.size(F.array_intersect("set", "item_set"))
    return (
        texts.join(pairs.select("r1", "r2", "item_id").distinct(), ["r1", "r2"])
        .join(sketches.select("item_id", F.col("set").alias("item_set"), F.col("n").alias("n_item")), "item_id")
        .select(*names, "item_id", shared.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
        .where(F.col("n_shared") >= _least(F.col("n_item"), containment))
        .select(*[F.col(n).alias(c) for c, n in zip(doc_keys, names, strict=True)], "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay. Rows that hold one are known by id and text."""
    r1, r2 = fresh(docs.columns, "r1", "r2")
    keyed = docs.withColumns({r1: F.xxhash64(f"`{doc_id}`", f"`{text}`"), r2: F.xxhash64(f"`{text}`", f"`{doc_id}`", F.lit(1))})
    bad = stored(find_contained(keyed, items, [r1, r2], text=text, **options).select(r1, r2).distinct(), "contaminated")
    return keyed.join(bad, [r1, r2], "left_anti").drop(r1, r2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


_SHINGLES = r"""
  SELECT {id}, unnest(list_distinct([list_slice(w, i, i + 4) FOR i IN range(1, len(w) - 3)])) AS s
  FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})
"""
OP2_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
