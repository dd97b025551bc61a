import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from gleanery.llm.pieces import Chunks, digests, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded string"
ODD = [
    None,
    "",
    " ",
    "  ",
    "\n",
    "\n\n a",
    " \n b",
    "a\n",
    "tabs\tand\r\nbreaks\r\n\r\n",
    "   three   spaces   ",
    "▁marker ▁▁ inside▁",
    "<s> </s> <unk> <0x0A>",
    "été 数字 🙂   \x00 �",
    " " * 1000 + "x" + " " * 33,
    "word " * 30_000,
    "y" * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    alphabet = "abcde  é\n\r\t.;)▁<0x>文🙂"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(50))) for _ in range(500)]


def test_equals_the_library(spark, library):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in encode_decode(spark.createDataFrame(rows, SCHEMA), PATH).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        assert got[i]["ids"] == ids, repr(text)[:80]
        assert got[i]["decoded"] == library.decode(ids)


def test_a_full_table_changes_nothing(library):
    chunks = Chunks(PATH, table_size=4)
    for text in texts():
        assert chunks.encode([text or ""]) == [library.encode(text or "")]


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(None, "a b", "", ""), (None, "a b", "", ""), (3, None, "", "")]
    got = digests(encode_decode(spark.createDataFrame(rows, SCHEMA), PATH)).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 2, 2]
    assert encode_decode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query_over_all_documents(spark, library):
    from gleanery.llm.queries import op2_sentencepiece

    folder = "/root/testdata/sf0.001"
    sources = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {tuple(r) for r in op2_sentencepiece(spark, folder).collect()}
    want = set()
    for k, text in sources.items():
        ids = library.encode(text)
        want.add((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
