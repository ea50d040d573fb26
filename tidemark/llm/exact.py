"""Exact duplicates by owners in Patricia tries.

Texts are equal when they are the same bytes without white space. Three steps, each over all rows:

1. Where the documents lie, every task puts its texts into a trie of its own. Repeats within a task
   become one *class*, so a group of copies of any size leaves a task once for each time the trie is
   emptied. The step writes one slim row per document and one row with the bytes per class.
2. Classes are dealt by length and content hash, and each partition inserts the full byte strings into
   a compressed radix trie. A terminal node keeps the smallest owner, the number of rows and the classes.
   A trie over its budget spills its heaviest subtree to the shared folder; later strings below that
   node follow it, and the subtree is put together afterwards in a trie of its own.
3. Documents take owner and size of their class.

Strings decide what is equal; length and hash only deal them out. A string that more than ``FAN`` classes
share is first merged in ``SALTS`` parts, so no task receives one row per task of a large job.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MB, WHITESPACE, map_arrow, materialised, row_key
from tidemark.llm.files import attempt_name, open_fs
from tidemark.session import scratch_path

# Bytes a trie may hold: of a task that reads documents, and of a partition of classes.
LOCAL_BYTES, TRIE_BYTES = 32 * MB, 96 * MB
# Bytes of distinct strings a partition of classes is to have.
PART_MB = 24
FAN, SALTS = 1024, 64
_NODE_BYTES = 300
_SPILL_BYTES = MB
_OUT_BYTES = 8 * MB
_BLANK = WHITESPACE.encode()

# Order of owners: most code points, an id before none, smallest id, then the row's key.
Owner = tuple[int, bool, int, int, int]


class Item:
    """What is known of one string: its best row, how many rows have it, and in which classes."""

    __slots__ = ("owner", "rows", "classes")

    def __init__(self, owner: Owner, rows: int, classes: list[int]):
        self.owner, self.rows, self.classes = owner, rows, classes

    def merge(self, owner: Owner, rows: int, classes: list[int]) -> None:
        self.owner = min(self.owner, owner)
        self.rows += rows
        self.classes += classes


class Node:
    __slots__ = ("edge", "kids", "item", "spill")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.item, self.spill = edge, {}, None, None


class Spill:
    """Strings of a subtree that is no longer in memory, in files of the shared folder."""

    def __init__(self, folder: str):
        self.fs, self.root = open_fs(folder)
        self.waiting, self.size, self.names = [], 0, []

    def add(self, key: bytes, *found) -> None:
        self.waiting.append((key, *found))
        self.size += len(key) + _NODE_BYTES
        if self.size > _SPILL_BYTES:
            self._write()

    def _write(self) -> None:
        name = attempt_name(f"-{id(self):x}-{len(self.names)}.spill")
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}") as out:
            out.write(pickle.dumps(self.waiting))
        self.names.append(name)
        self.waiting, self.size = [], 0

    def take(self, other: Spill) -> None:
        """What another spill holds, too."""
        self.names += other.names
        self.waiting += other.waiting
        self.size += other.size

    def read(self) -> Iterator[tuple]:
        for name in self.names:
            with self.fs.open_input_file(f"{self.root}/{name}") as file:
                yield from pickle.loads(file.read())
            self.fs.delete_file(f"{self.root}/{name}")
        yield from self.waiting


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of ``edge`` and ``key[at:]``."""
    lo, hi = 0, min(len(edge), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if edge[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Byte strings in a compressed radix trie that spills subtrees beyond ``budget`` bytes."""

    def __init__(self, budget: float = math.inf, folder: str | None = None):
        self.root, self.budget, self.folder = Node(b""), budget, folder
        self.size, self.strings, self.spills = 0, 0, []

    def add(self, key: bytes, owner: Owner, rows: int, classes: list[int]) -> Item | None:
        """Insert a string; its item, unless it lies in a spilled subtree."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += len(key) - at + _NODE_BYTES
                node, at = kid, len(key)
            elif key.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                if node.spill is not None:
                    node.spill.add(key, owner, rows, classes)
                    return None
            else:
                n = _common(kid.edge, key, at)
                upper = node.kids[key[at]] = Node(kid.edge[:n])
                kid.edge = kid.edge[n:]
                upper.kids[kid.edge[0]] = kid
                self.size += _NODE_BYTES
                node, at = upper, at + n
        if node.item is None:
            node.item = Item(owner, rows, classes)
            self.strings += 1
            self.size += _NODE_BYTES
            if self.size > self.budget and self.strings > 1:
                self._spill()
        else:
            node.item.merge(owner, rows, classes)
        return node.item

    def _walk(self, top: Node, path: bytes) -> Iterator[tuple[Node, bytes]]:
        stack = [(top, path)]
        while stack:
            node, path = stack.pop()
            yield node, path
            stack += [(kid, path + kid.edge) for kid in node.kids.values()]

    def items(self) -> Iterator[tuple[bytes, Item]]:
        """Strings in memory with their items."""
        return ((path, node.item) for node, path in self._walk(self.root, b"") if node.item is not None)

    def _sizes(self) -> dict[int, int]:
        """Bytes below each node."""
        order, stack = [], [(self.root, None)]
        while stack:
            node, parent = stack.pop()
            order.append((node, parent))
            stack += [(kid, node) for kid in node.kids.values()]
        sizes: dict[int, int] = {}
        for node, parent in reversed(order):
            below = sizes[id(node)] = sizes.get(id(node), 0) + len(node.edge) + _NODE_BYTES * (1 + (node.item is not None))
            if parent is not None:
                sizes[id(parent)] = sizes.get(id(parent), 0) + below
        return sizes

    def _spill(self) -> None:
        """Move the heaviest subtree of at most half the budget out of memory; the trie keeps its top node."""
        sizes = self._sizes()
        node, path = self.root, b""
        while node is self.root or sizes[id(node)] > self.budget / 2:
            kids = [k for k in node.kids.values() if k.spill is None]
            if not kids:
                break
            node = max(kids, key=lambda k: sizes[id(k)])
            path += node.edge
        if node is self.root:
            return
        node.spill = Spill(self.folder)
        self.spills.append(node.spill)
        for below, key in self._walk(node, path):
            if below is not node and below.spill is not None:
                node.spill.take(below.spill)
                self.spills.remove(below.spill)
            if below.item is not None:
                node.spill.add(key, below.item.owner, below.item.rows, below.item.classes)
                self.strings -= 1
        self.size -= sizes[id(node)] - len(node.edge) - _NODE_BYTES
        node.kids, node.item = {}, None


def merged(found: Iterator[tuple], budget: float, folder: str) -> Iterator[tuple[bytes, Item]]:
    """Each distinct string of ``(string, owner, rows, classes)`` once, in memory of about ``budget`` bytes."""
    trie = Trie(budget, folder)
    for one in found:
        trie.add(*one)
    yield from trie.items()
    waiting, trie = trie.spills, None
    while waiting:
        part = Trie(budget, folder)
        for one in waiting.pop().read():
            part.add(*one)
        yield from part.items()
        waiting += part.spills


_LOCAL = "uid long, doc_id long, chars long, rk long, class long, rows long, len long, hash long, content binary"
_STRINGS = "uid long, doc_id long, chars long, rk long, rows long, len long, hash long, content binary, classes array<long>"
_GROUPS = "uid long, doc_id long, rk long, rows long, sha256 string, classes array<long>"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _batched(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of about ``_OUT_BYTES`` from rows that say their size."""
    done, size = [], 0
    for bytes_, row in rows:
        done.append(row)
        size += bytes_
        if size > _OUT_BYTES:
            yield _batch(done, schema)
            done, size = [], 0
    yield _batch(done, schema)


def _hash(key: bytes) -> int:
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _owner_columns(owner: Owner) -> tuple:
    """uid, doc_id, chars, rk."""
    return owner[4], None if owner[1] else owner[2], -owner[0], owner[3]


def _owner(uid: int, doc_id: int | None, chars: int, rk: int) -> Owner:
    return -chars, doc_id is None, doc_id or 0, rk, uid


def _local(budget: int) -> Callable:
    def emptied(trie: Trie) -> Iterator[tuple[int, tuple]]:
        for key, item in trie.items():
            yield len(key) + 100, (*_owner_columns(item.owner), item.classes[0], item.rows, len(key), _hash(key), key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        uid, trie = TaskContext.get().partitionId() << 40, Trie()
        for batch in batches:
            for doc_id, chars, rk, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                item = trie.add(text.as_py().translate(None, _BLANK), _owner(uid, doc_id, chars, rk), 1, [])
                if not item.classes:
                    item.classes = [uid]
                yield 100, (uid, doc_id, None, None, item.classes[0], None, None, None, None)
                uid += 1
                if trie.size > budget:
                    yield from emptied(trie)
                    trie = Trie()
        yield from emptied(trie)

    return lambda batches: _batched(rows(batches), _LOCAL)


def _merging(budget: int, folder: str, last: bool) -> Callable:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uid, doc_id, chars, rk, rows, key, classes in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "chars", "rk", "rows", "content", "classes")), strict=True):
                yield key, _owner(uid, doc_id, chars, rk), rows, classes

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for key, item in merged(found(batches), budget, folder):
            uid, doc_id, chars, rk = _owner_columns(item.owner)
            if last:
                yield 150 + 8 * len(item.classes), (uid, doc_id, rk, item.rows, hashlib.sha256(key).hexdigest(), item.classes)
            else:
                yield len(key) + 100, (uid, doc_id, chars, rk, item.rows, len(key), _hash(key), key, item.classes)

    return lambda batches: _batched(groups(batches), _GROUPS if last else _STRINGS)


def groups(docs: DataFrame, local_bytes: int = LOCAL_BYTES, trie_bytes: int = TRIE_BYTES, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Rows ``uid, doc_id, class`` and groups ``uid, doc_id, rk, rows, sha256, classes`` of equal texts.

    ``uid`` numbers rows; a group names the row that stays: that with the most code points, then the
    smallest ``doc_id`` (a row without one comes last), then the smallest row key.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.char_length(text).cast("long").alias("chars"), row_key().alias("rk"), text.cast("binary").alias("content"))
    table = materialised(map_arrow(slim, _local(local_bytes), _LOCAL), "classes")
    strings = table.where("content IS NOT NULL").withColumn("classes", F.array("class")).drop("class")
    counts = strings.groupBy("len", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))
    busy = materialised(counts.where(F.col("n") > fan).select("len", "hash", F.lit(True).alias("busy")), "busy")
    floor = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("bytes")).first()[0] or 0
    parts = max(floor, math.ceil(total / (PART_MB * MB)))
    folder = scratch_path(docs.sparkSession, "tries")
    if not busy.isEmpty():
        marked = strings.join(busy, ["len", "hash"], "left")
        salted = marked.where("busy").drop("busy").repartition(parts, "len", "hash", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
        fewer = map_arrow(salted.select(*[f.split()[0] for f in _STRINGS.split(", ")]), _merging(trie_bytes, folder, False), _STRINGS)
        strings = marked.where("busy IS NULL").drop("busy").unionByName(fewer)
    found = map_arrow(strings.repartition(parts, "len", "hash"), _merging(trie_bytes, folder, True), _GROUPS)
    return table.where("content IS NULL").select("uid", "doc_id", "class"), found


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    NULL texts count as empty, and empty and blank texts are equal. Exactly one row of a group is kept, also
    where rows are repeated; ``keep_id`` is NULL only if the row that stays has no id. An empty table gives
    no rows. Other columns are not read.
    """
    rows, found = groups(docs)
    found = materialised(found, "owners")
    by_class = found.select(F.explode("classes").alias("class"), F.col("uid").alias("keeper"), F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"), F.col("sha256").alias("text_sha256"))
    return rows.join(by_class, "class").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keeper")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that agree in id and text are one."""
    keys = materialised(groups(docs)[1].select("rk"), "owners")
    return docs.select(F.struct("*").alias("row"), row_key().alias("rk")).join(keys, "rk", "left_semi").dropDuplicates(["rk"]).select("row.*")


# The same by SQL.
GROUPS_SQL = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
    row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
FROM texts
WINDOW best AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST)
"""
