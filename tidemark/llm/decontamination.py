"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are short, documents long, so Jaccard similarity says nothing; what counts is the share of an
item's shingles that a document contains. Items are partitioned by size (powers of two of their number
of distinct shingles). In a size class the MinHash sketch of an item is its ``k`` shingles with the
smallest hashes, ``k`` being one more than any item of the class may miss at the threshold. A document
that contains enough of an item therefore contains at least one shingle of its sketch: the search
misses nothing. Of a document only the hashes below the largest sketch hash are looked up (its own
MinHash at the scale that the classes need), and a document with too few shingles for a class is out.

Candidates are verified by exact containment of the shingles themselves, as text. All steps are
built-in columns.

Defined case: an item of one to four words is one shingle of that length, which a document of five or
more words does not have. Such an item is found only in documents that consist of exactly its words;
that it stands inside a longer document does not count as a leak. ``LEAKS_SQL`` says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, materialised, row_key, words

SHINGLE = 5
THRESHOLD = 0.8


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct word shingles of the lower-cased text; one shorter shingle if it has fewer words."""
    def cut(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: F.array_join(F.slice(ws, i, size), " "))
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).when(F.size(ws) <= size, F.array(F.array_join(ws, " "))).otherwise(F.array_distinct(many))

    return let(words(F.lower(text)), cut)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the shingles, without building their texts."""
    def cut(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: F.xxhash64(F.slice(ws, i, size)))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).when(F.size(ws) <= size, F.array(F.xxhash64(ws))).otherwise(F.array_distinct(many))

    return let(words(F.lower(text)), cut)


def needed(n: Column, threshold: float) -> Column:
    """Fewest shingles of ``n`` that reach the threshold, in exact arithmetic (thousandths)."""
    return F.ceil(n * F.lit(round(threshold * 1000)) / F.lit(1000)).cast("long")


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``item_id, need, h``: the sketch of every item, as long as its size class requires."""
    sized = (
        items.where("item_id IS NOT NULL")
        .select("item_id", F.explode(shingle_hashes(F.col("text"))).alias("h")).distinct()
        .groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
        .withColumn("n", F.size("hs").cast("long"))
    )
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    length = upper - needed(upper, threshold) + 1
    return sized.select("item_id", needed(F.col("n"), threshold).alias("need"), F.explode(F.slice("hs", F.lit(1), length.cast("int"))).alias("h"))


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rk, item_id``: document rows that hold a sketch shingle of an item and are large enough for it."""
    sketch = sketches(items, threshold)
    largest = sketch.agg(F.max("h").alias("h"))
    hashed = docs.select(row_key().alias("rk"), shingle_hashes(F.col("text")).alias("hs")).select("rk", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    low = hashed.where(F.col("h") <= largest.scalar())
    return low.join(sketch, "h").where("n >= need").select("rk", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rk, doc_id, item_id, n_shared, n_shingles, containment``: verified leaks, one per row key and item.

    ``containment`` is the share of the item's distinct shingles that the document has. NULL or blank
    texts have no shingles: such documents and items are in no pair. Repeated document rows are one,
    repeated item rows are joined into one set. Items without an id are left out; a document without
    an id is searched and has a NULL ``doc_id``. Other columns are not read.
    """
    found = materialised(candidates(docs, items, threshold), "candidates")
    hit = docs.select("doc_id", "text", row_key().alias("rk")).join(found.select("rk").distinct(), "rk", "left_semi").dropDuplicates(["rk"])
    exact = hit.select("rk", "doc_id", F.explode(shingles(F.col("text"))).alias("s"))
    parts = items.where("item_id IS NOT NULL").select("item_id", F.explode(shingles(F.col("text"))).alias("s")).distinct()
    sizes = parts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    shared = exact.join(parts, "s").groupBy("rk", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    verified = shared.join(found, ["rk", "item_id"], "left_semi").join(sizes, "item_id").where(F.col("n_shared") >= needed(F.col("n_shingles"), threshold))
    return verified.select("rk", "doc_id", "item_id", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment``: see ``contained``; rows of one id show their best."""
    best = contained(docs, items, threshold).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"), F.max("containment").alias("containment"))
    return best


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    bad = materialised(contained(docs, items, threshold).select(F.col("rk").alias("__leak")).distinct(), "leaks")
    return docs.join(bad, row_key() == F.col("__leak"), "left_anti")


LEAKS_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), d AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark
), t AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), n AS (SELECT item_id, count(*) AS n_shingles FROM t GROUP BY item_id),
h AS (SELECT d.doc_id, t.item_id, count(*) AS n_shared FROM d JOIN t USING (s) GROUP BY d.doc_id, t.item_id)
SELECT h.doc_id, h.item_id, h.n_shared, n.n_shingles, round(CAST(h.n_shared AS DOUBLE) / n.n_shingles, 6) AS containment
FROM h JOIN n USING (item_id) WHERE h.n_shared * 1000 >= n.n_shingles * 800
"""
