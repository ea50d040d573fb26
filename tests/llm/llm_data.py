"""Small tables with every awkward case, and plain Python versions of the definitions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, rk string, block string, shard string, row string, h string, p double, quality string"


def words(text):
    return WORD.findall(text or "")


def edge_texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text): NULLs, blanks, ties, repeated rows, long texts, shared passages, odd characters."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 4 + ["".join(rng.choices("abcdéßñ", k=rng.randint(2, 7))) for _ in range(150)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    other = " ".join(rng.choices(vocabulary, k=16))
    rows = [(None, "a text without an id but long enough " * 3), (None, None), (1, None), (2, ""), (3, " \t\n\r "), (4, "one"), (5, "two words")]
    for i in range(10, 50):
        body = rng.choices(vocabulary, k=rng.randint(3, 60))
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage.split()
        if i % 7 == 0:
            body += other.split()
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(body)))
    rows += [(60, rows[-1][1]), (61, rows[-1][1]), (62, rows[-1][1] + " end"), (63, rows[-2][1].replace(" ", " ", 1)), (63, rows[-2][1]), (63, rows[-2][1])]
    rows += [(70, "ab " * 200), (71, "x" * 3000), (72, "x" * 3000), (73, " ".join(rng.choices(vocabulary, k=4000))), (74, passage + " " + other), (75, passage)]
    rows += [(80, "A\x0bB\x0cC \xa0D  E 🙂🙂 " + other), (81, "# $ % | < > & *\n# $ % | < > & *\n\n x\nx")]
    return rows


def documents(spark, rows):
    """The rows with all columns of the documents table, and columns whose names operators use inside."""
    full = [(i, t, "en", "src0", len(t or ""), *["clash"] * 6, 0.5, "clash") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
