"""Quality by hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into a fixed number of bins. Two multinomials over the bins are counted
over all data: one from the documents that the labels call good, one from the whole corpus. The score
of a document is the mean log ratio of its n-grams (so length does not matter), compared with a fixed
threshold. Everything is built-in columns: counting is one grouping into at most ``BINS`` rows, scoring
happens inside each row without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITESPACE, let, words

BINS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.17
SYMBOLS = "#*$%&|<>"
REPEAT = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def ngram_bins(ws: Column, bins: int = BINS) -> Column:
    """Bins of all words and of all pairs of neighbouring words; ``ws`` must be a bound value."""
    def place(*x: Column) -> Column:
        return F.pmod(F.xxhash64(*x), F.lit(bins)).cast("int")

    fewer = F.greatest(F.size(ws) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(ws, 1, fewer), F.slice(ws, 2, fewer), lambda a, b: place(a, b))
    return F.concat(F.transform(ws, lambda w: place(w)), pairs)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents that every label row calls good and none calls toxic."""
    per_doc = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return per_doc.where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("doc_id")


def log_ratios(docs: DataFrame, labels: DataFrame, bins: int = BINS) -> list[float]:
    """One log ratio per bin, trusted over raw, with additive smoothing; ``bins`` numbers in all.

    Counts cover every document. Without trusted text (or text at all) all ratios are zero.
    """
    # A merge join at every size: labels grow with the corpus, so broadcasting them is no plan to rely on.
    trusted = trusted_labels(labels).withColumn("trusted", F.lit(1)).hint("merge")
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left")
    grams = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(let(words(F.col("text")), lambda ws: ngram_bins(ws, bins))).alias("bin"))
    counts = grams.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("trusted")).collect()  # at most `bins` rows
    raw, trusted = [0] * bins, [0] * bins
    for bin_, r, t in counts:
        raw[bin_], trusted[bin_] = r, t
    if not sum(trusted):
        return [0.0] * bins
    total_raw, total_trusted = sum(raw) + bins * SMOOTHING, sum(trusted) + bins * SMOOTHING
    return [math.log((t + SMOOTHING) / total_trusted) - math.log((r + SMOOTHING) / total_raw) for r, t in zip(raw, trusted, strict=True)]


def score(ws: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0 without words. ``ws`` must be a bound value.

    The ratios enter the plan as one text that Spark folds into a constant array.
    """
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    return let(
        ngram_bins(ws, len(ratios)),
        lambda bins: F.when(F.size(bins) == 0, F.lit(0.0)).otherwise(
            F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + F.get(table, b)) / F.size(bins)
        ),
    )


def repeat_words(ws: Column, window: int = REPEAT) -> Column:
    """Words inside a window that occurs twice or more in the text; ``ws`` must be a bound value.

    Windows are compared by 64-bit hash; sorting (hash, position) puts equal ones side by side.
    """
    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        places = F.sort_array(F.transform(found, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")))["n"]

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1), lambda i: F.xxhash64(F.slice(ws, i, window)))
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(ws) < window, F.lit(0)).otherwise(repeated)


def line_repeats(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITESPACE, "") != "")
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bins: int = BINS) -> DataFrame:
    """All columns of ``docs`` plus one struct column ``quality``: counts, score and verdict of the row.

    ``quality`` has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score
    and kept. NULL text counts as empty, and a text of fewer than ten words fails. Repeated rows are judged
    alike; a row without ``doc_id`` is judged but never trusted. A column named ``quality`` is replaced.
    """
    ratios = log_ratios(docs, labels, bins)
    text = F.coalesce(F.col("text"), F.lit(""))
    measures = let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n"),
        repeat_words(ws).cast("long").alias("repeated"),
        score(ws, ratios).alias("score"),
    ))

    def verdict(m: Column) -> Column:
        failed = (m["n"] < MIN_WORDS) | (100 * m["repeated"] > MAX_REPEAT_PERCENT * m["n"])
        return F.struct(
            m["n"].alias("n_words"),
            F.length(F.translate(text, WHITESPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            line_repeats(text).cast("long").alias("n_dup_lines"),
            m["repeated"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            m["score"].alias("score"),
            (~failed & (m["score"] >= threshold)).alias("kept"),
        )

    return docs.withColumn("quality", let(measures, verdict))
