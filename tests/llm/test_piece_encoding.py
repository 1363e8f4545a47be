import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from locspark.llm.common import NumberTable
from locspark.llm.piece_encoding import PieceModel, encode_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def texts():
    r = random.Random(2)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = ["", " ", "  ", "   a  b ", "\n", " \n a\n", "▁x ▁▁ y", "<s> [INST] </s><0x41>", "\x00\t\r", "𝔘𝔫 中文 é", "a" * 700, "ab" * 400 + " " * 50]
    for _ in range(400):
        out.append("".join(r.choice(["a", "e", "the", "in", "\n", " ", "  ", "é", "中", "𝔘", "X", "1", ".", "ing"]) for _ in range(r.randint(1, 40))))
    for _ in range(400):
        out.append("".join(sp.id_to_piece(r.randrange(259, 32000)).replace("▁", " ") for _ in range(r.randint(1, 8))))
    return out


def check(rows, data):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, t in data:
        ids = sp.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))), t


def test_as_the_library(spark):
    data = [*enumerate(texts()), (-1, None)]
    rows = {r.doc_id: r for r in encode_pieces(spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, ids int"), PATH).collect()}
    check(rows, data)
    assert rows[12].ids == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(data[12][1])


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check({r.doc_id: r for r in encode_pieces(docs, PATH, keep=False).collect()}, [(r.doc_id, r.text) for r in docs.collect()])


def test_pieces_of_the_model_come_back():
    model, sp = PieceModel.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for p in list(model.ids)[::37]:
        text = p.replace("▁", " ")
        assert model.encode([text])[0].tolist() == sp.encode(text)


def test_long_and_short_units_alike():
    model, r = PieceModel.load(PATH), random.Random(5)
    units = ["▁" * r.randint(0, 3) + "".join(r.choice(["a", "e", "the", "é", "中", "𝔘", "X", "ing", "er"]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    flat, edge = model.tokens(units)
    assert [flat[a:z].tolist() for a, z in zip(edge, edge[1:])] == [model.long_tokens(u) for u in units]


def test_number_table():
    r, table = np.random.default_rng(1), NumberTable(12)
    keys = np.unique(r.integers(0, 1 << 40, 3000))
    table.put(keys, np.arange(len(keys), dtype=np.int32))
    assert table.get(keys).tolist() == list(range(len(keys))) and (table.get(keys + (1 << 41)) == -1).all()
    table.clear()
    assert (table.get(keys) == -1).all()


def test_a_very_long_text(spark):
    text = "word and other word " * 60_000 + "x" * 100_000
    data = [(1, text), (1, text), (None, "a b")]
    got = encode_pieces(spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, n_tokens string"), PATH).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert sorted(r.ids for r in got) == sorted(sp.encode(t) for _, t in data) and sorted(r.decoded for r in got) == sorted(t for _, t in data)


def test_empty_table(spark):
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
