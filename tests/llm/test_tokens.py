import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanery.llm.tokens import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, pre string"
ODD = [
    None,
    "",
    " ",
    "\n\n \t x",
    "it's they'll 'S",
    "a<|endoftext|>b <|endoftext|> <|endoftext|",
    "été  naïve 数字 १२३  　 x\x1c\x1dy\x85z",
    "   lead and trail   ",
    "🙂🙂 🏳️‍🌈 é",
    "x" * 50_000,
    "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("table_size", [1, 1000])
def test_counts_equal_the_library(spark, library, table_size):
    rng = random.Random(5)
    alphabet = "ab é'sS1٣ \n\t\x0b ​.,!<|>_文\x1f"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]
    texts += texts[:20]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in count_tokens(spark.createDataFrame(rows, SCHEMA), PATH, 5, table_size).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        n = expected(library, text)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 5)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(None, "a b", "", ""), (None, "a b", "", ""), (3, None, "", "")]
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in got) == [(False, 0), (True, 2), (True, 2)]
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query_over_all_documents(spark, library):
    from gleanery.llm.queries import op4_token_counts

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op4_token_counts(spark, folder).collect()}
    assert got == {k: expected(library, t) for k, t in texts.items()}
