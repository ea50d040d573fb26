"""Spelling variants by pivotal grams.

Words that differ by one edit are found through their bigrams, in one order over all words: rarest first.

- The *prefix* of a word is its first three bigrams in that order (and those as frequent as the third).
- Its *pivots* are two bigrams of the prefix that do not overlap, the least frequent such pair, chosen by dynamic
  programming over positions. One edit leaves one of them whole.
- So of two words one edit apart, a pivot of the one whose prefix ends earlier is in the other's prefix.
  A single edit lies on one side of that gram, and the other side is equal: an equal left side fixes the
  position, an equal right side moves it by as much as the lengths differ. Of the side with the edit, cut
  in half, one half is equal too. So pivots are joined with prefixes by length, position, gram, equal side and equal half.

Candidates are verified by edit distance in the join itself. A word then takes the form of its most
frequent near word, if that is frequent enough, and forms are followed to their roots by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialised

# Edits that a near word may be away, and length of a gram; a prefix has EDITS * GRAM + 1 grams.
EDITS, GRAM = 1, 2
PREFIX = EDITS * GRAM + 1
SHORTEST, LEAST_USES = 5, 3
# A form is at least so many times as frequent as its variant.
MORE = 2
# Fixed values of the query: letters of a run, and that one in so many runs loses a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
SLIPS = 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each word is used; some runs lose a letter first, by document and run.

    NULL texts have no words; a row without an id slips as if its id were empty.
    """
    low = F.translate(F.col("run"), _UPPER, _LOWER)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    hashed = found.select(low.alias("run"), F.crc32(F.concat("doc", F.lit(":"), low).cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(uses: DataFrame) -> DataFrame:
    """The words that are long and frequent enough to be compared."""
    return uses.where((F.col("n") >= LEAST_USES) & (F.char_length("word") >= SHORTEST))


def pivots(prefix: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The EDITS + 1 grams of a prefix that do not overlap and are least frequent together.

    ``best[k]`` holds, after each position, the cheapest choice of ``k`` grams that end before it.
    """
    by_place = sorted(prefix, key=lambda g: g[2])
    nothing = (float("inf"), ())
    table = [[(0, ())] + [nothing] * (EDITS + 1)]
    for i, gram in enumerate(by_place):
        free = next((j for j in range(i - 1, -1, -1) if by_place[j][2] + GRAM <= gram[2]), -1) + 1
        row = list(table[-1])
        for k in range(1, EDITS + 2):
            cost, chosen = table[free][k - 1]
            row[k] = min(row[k], (cost + gram[0], (*chosen, i)))
        table.append(row)
    return [by_place[i] for i in table[-1][EDITS + 1][1]]


_ENTRIES = "word string, n long, length int, gram string, place int, pivot boolean"


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix grams of each word and which of them are its pivots, from its grams with their frequencies."""
    for batch in batches:
        out = []
        for word, n, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            order = sorted((g["uses"], g["gram"], g["place"]) for g in grams)
            last = order[PREFIX - 1][:2]
            prefix = [g for g in order if g[:2] <= last]
            chosen = set(pivots(prefix))
            out += [(word, n, len(word), g[1], g[2], g in chosen) for g in prefix]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _ENTRIES.split(", ")])


def entries(words: DataFrame) -> DataFrame:
    """``word, n, length, gram, place, pivot``: the prefix of every word of ``words(word, n)``."""
    starts = F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1))
    grams = words.select("word", "n", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("place", "gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    ranked = grams.join(common, "gram").groupBy("word", "n").agg(F.collect_list(F.struct("uses", "gram", "place")).alias("grams"))
    return map_arrow(ranked, _entry_batches, _ENTRIES)


def one_edit_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, EDITS) == 1


def _met_at(length: Column) -> Column:
    """Keys under which a whole gram of the word meets words of that length."""
    left, right = F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + (GRAM + 1), F.col("length"))
    # Place of the gram, if the right side is equal, and letters on the side with the edit, in the words it meets.
    moved, after = F.col("place") + length - F.col("length"), length - F.col("place") - GRAM
    half, rest = F.floor(after / 2).cast("int"), F.floor(moved / 2).cast("int")
    same_left = [(F.lit(1), F.left(right, half)), (F.lit(2), F.right(right, after - half))]
    same_right = [(F.lit(3), F.left(left, rest)), (F.lit(4), F.right(left, moved - rest))]
    return F.array(
        *[F.xxhash64(kind, length, "place", "gram", left, part) for kind, part in same_left],
        *[F.xxhash64(kind, length, moved, "gram", right, part) for kind, part in same_right],
    )


def near(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: every ordered pair of words one edit apart; input: distinct ``word, n``.

    Words have at least five code points.
    """
    index = materialised(entries(words), "grams")
    sought = F.flatten(F.array(*[_met_at(F.col("length") + d) for d in range(-EDITS, EDITS + 1)]))
    side = index.where("pivot").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(sought).alias("key"))
    met = index.select("word", "n", F.explode(_met_at(F.col("length"))).alias("key"))
    pairs = side.join(met, "key").where(one_edit_apart(F.col("a"), F.col("word")))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")), F.struct("word", F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(both.alias("x")).select("x.*").distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``forms(word, form)`` lead, by pointer doubling.

    A form is more frequent than its word, so there is no circle; after k steps a pointer has skipped
    2^k forms, and the steps end when none moves any more.
    """
    at = materialised(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialised(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each of the distinct ``words(word, n)``."""
    words = materialised(words, "words")
    order = F.struct((-F.col("other_n")).alias("less"), "other")
    best = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(order).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    form = F.col("other_n") >= F.col("n") * MORE
    found = materialised(found.select("word", "n", "n_near", F.when(form, F.col("other")).alias("form"), F.when(form, F.col("other_n")).alias("form_n")), "forms")
    return found.join(rooted(found.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per compared word of the documents.

    Repeated rows are counted again. NULL and empty texts add no words, and an empty table gives no rows.
    Other columns are not read.
    """
    return variants(vocabulary(runs(docs))).select("word", "form", "root", "n", "n_near", "form_n")


# The same by SQL: near words meet at a common word with one code point fewer.
VARIANTS_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) AS r(i)
),
found AS (
    SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    GROUP BY ALL
),
hashed AS (
    SELECT run, n, xor(list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(doc || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM found, crc
),
words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
cut AS (
    SELECT word, n, word AS less FROM words
    UNION SELECT word, n, left(word, i - 1) || substr(word, i + 1) FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.less = b.less AND a.word != b.word
    WHERE levenshtein(array_to_string(list_transform(string_split(a.word, ''), lambda x: chr(unicode(x)::INT + CASE WHEN unicode(x) > 127 THEN -191 ELSE 0 END)), ''),
        array_to_string(list_transform(string_split(b.word, ''), lambda x: chr(unicode(x)::INT + CASE WHEN unicode(x) > 127 THEN -191 ELSE 0 END)), '')) = 1
),
best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
),
forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)
),
ways AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, root FROM ways w WHERE NOT EXISTS (SELECT 1 FROM forms f WHERE f.word = w.root AND f.form IS NOT NULL)) USING (word)
"""
