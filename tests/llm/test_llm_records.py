import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_data import documents, edge_texts
from tokenizers import Tokenizer

from tidemark.llm import records
from tidemark.session import scratch_path

ODD = ["<|endoftext|> a", "don't we'll  x \n\n y", " \x1c\x85 a　b", "ab12,c!?", "  lead", "trail  ", "𝔘nicode​🙂", "a" * 500]


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def rows_with_odd():
    return edge_texts() + [(200 + i, t) for i, t in enumerate(ODD)]


def test_encoder_equals_the_library():
    texts = [t or "" for _, t in rows_with_odd()]
    encoder = records.Encoder(public_tokenizers.path(records.TOKENIZER))
    for _ in range(2):
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == library(texts)


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(records, "_MEMO_ROWS", 20)
    texts = [t or "" for _, t in rows_with_odd()]
    encoder = records.Encoder(public_tokenizers.path(records.TOKENIZER))
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == library(texts)


def test_read_back(spark):
    rows = rows_with_odd()
    got = records.token_records(documents(spark, rows)).orderBy("start").collect()
    ids = [(i, [*x, 0]) for (i, _), x in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=str)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark):
    assert records.token_records(documents(spark, [])).count() == 0


def test_shuffled_reads_and_broken_files(spark):
    folder = scratch_path(spark, "records-test")
    docs = documents(spark, [(i, f"text number {i} " * i) for i in range(40)])
    records.write_records(docs, folder)
    index = spark.read.parquet(f"{folder}/index")
    some = index.where("doc_id % 7 = 3").orderBy("length")
    got = {r.doc_id: r.ids for r in records.read_records(some, folder).collect()}
    assert {i: [*x, 0] for i, x in zip(range(3, 40, 7), library([f"text number {i} " * i for i in range(3, 40, 7)]))} == got
    files, root = records.open_fs(f"{folder}/data")
    name = index.first().file
    with files.open_input_file(f"{root}/{name}") as f:
        data = bytearray(f.readall())
    data[30] ^= 1
    with files.open_output_stream(f"{root}/{name}") as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="broken record"):
        records.read_records(index, folder).count()


def test_framing():
    record = records.frame(b"\x02abc")
    assert bytes(records.unframe(memoryview(record))) == b"\x02abc"
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)))
