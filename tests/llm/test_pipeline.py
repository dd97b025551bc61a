import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from gleanery.llm.suffixes import cut_text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("tables"))


def words(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(n))


def sample():
    item, passage = words("item", 40), words("passage", 80)
    rows = [(i, words(i, 120)) for i in range(30)]
    rows += [(100, "too short"), (101, "again " * 200), (102, None), (103, "")]  # fail the rules
    rows += [(200 + i, rows[0][1]) for i in range(5)]  # copies
    rows += [(300, rows[1][1].upper())]  # another case: the same fingerprint
    rows += [(400, f"{words(400, 90)} {passage} {words(401, 9)}"), (401, f"{words(402, 90)} {passage} {words(403, 9)}")]
    rows += [(500, f"{words(500, 90)} {item} {words(501, 60)}")]  # leak
    rows += [(None, words("null", 100)), (None, words("null", 100))]
    return rows, item, passage


@pytest.fixture(scope="module")
def written(spark, folder):
    rows, item, passage = sample()
    docs = [(i, t, None, f"h{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item, passage


def test_every_stage_takes_effect(spark, folder, written):
    rows, item, passage = written
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/out{k}"
        step(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        seen[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    clean = set(range(30))
    assert ids["quality rules"] == {i for i, _ in rows} - {100, 101, 102, 103}
    assert ids["simhash near-dedup"] == ids["quality rules"] - {200, 201, 202, 203, 204, 300}
    assert len(seen["simhash near-dedup"]) == len(ids["simhash near-dedup"])  # repeated rows as well
    cut = {r["doc_id"]: r for r in seen["suffix-array dedup"]}
    assert set(cut) == ids["simhash near-dedup"]
    assert passage in cut[400]["text"] and passage[60:-60] not in cut[401]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert ids["benchmark decontamination"] == ids["suffix-array dedup"] - {500}
    assert clean <= ids["sentencepiece encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in seen["benchmark decontamination"]}
    for r in seen["sentencepiece encoding"]:
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])


def test_no_rows(spark, folder, written):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, folder).collect() == []


def test_cuts_leave_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, "a" + shared), (2, "è" + shared + "ö"), (3, "ab" + shared[:20])]
    got = {r["doc_id"]: r["text"] for r in cut_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a" + shared, 2: "è", 3: "ab" + shared[:20]}


def test_suffix_stage_of_very_many_bytes(spark, folder, written, monkeypatch):
    """Runs times bytes go beyond 64 bits: the stage gives the same rows."""
    from gleanery.llm import windows

    shared = words(99, 40)
    rows = [(i, f"{words(i, 60)} {shared}", "en", "h", 5) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in corpus_pipeline.suffix_dedup(spark, docs, folder).collect())
    assert shared in want[0][1] and shared not in want[1][1]
    whole = windows.hot_minimisers
    monkeypatch.setattr(
        windows, "hot_minimisers", lambda keyed, scheme, packed, *more: whole(keyed, scheme, packed << 40, *more)
    )
    assert sorted(tuple(r) for r in corpus_pipeline.suffix_dedup(spark, docs, folder).collect()) == want


def test_extra_columns_with_clashing_names(spark, folder, written):
    extra = [c for c in ("row", "rest", "d", "tie", "kept", "_leaked", "fp", "n", "body", "lines", "salt", "windows")]
    row = (1, words(1, 60), "en", "h", 5, *["x"] * len(extra))
    docs = spark.createDataFrame([row], SCHEMA + "".join(f", {c} string" for c in extra))
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, folder)
        assert got.columns == docs.columns
        assert [r[5:] for r in got.collect()] == [row[5:]]
    assert step(spark, docs, folder).count() == 1


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert len(got) == len({r["doc_id"] for r in got}) > len(ids) / 3 and {r["doc_id"] for r in got} <= ids
