import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanery.llm.packing import Encoder, Shard, fill, packed

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, ids string, term string, `my col` string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def sample():
    rng = random.Random(6)
    topics = [["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(60)] for _ in range(6)]
    rows = [(i, " ".join(rng.choices(topics[i % 6], k=rng.choice([5, 40, 200, 900]))) + ".\n", None) for i in range(150)]
    rows += [(500 + i, rows[0][1], None) for i in range(60)]
    rows += [(600, None, None), (601, "", None), (None, "no id", None), (None, None, None)]
    rows += [(602, "word " * 9000, None)]
    return rows + rows[-5:]


def frame(spark, rows):
    return spark.createDataFrame([(*r[:2], "s", "x", "y", "z") for r in rows], SCHEMA).repartition(4)


def check(pieces, rows, library, window):
    """Every id in one piece, sequences gapless; the padding."""
    left = Counter((i, tuple(ids_of(library, t))) for i, t, _ in rows)
    of = defaultdict(list)
    for p in pieces:
        of[p["doc_id"], p["doc_tokens"]].append(p)
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
    found = Counter()
    for (doc_id, n), own in of.items():
        # Rows that share an id and a length are told apart by their ids.
        texts = [ids for (i, ids), k in left.items() if i == doc_id and len(ids) == n for _ in range(k)]
        held = Counter()
        for p in own:
            ids = tuple(np.frombuffer(p["ids"], "<u4").tolist())
            at = range(p["start"], p["start"] + p["length"])
            assert any(ids == t[p["start"] : p["start"] + p["length"]] for t in texts)
            held.update(at)
        assert held == Counter({k: len(texts) for k in range(n)})
        found.update((doc_id, t) for t in texts)
    assert found == left
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    padding = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        total = sum(n for _, n in own)
        assert total <= window
        padding += window - total
    return padding, len(sequences)


@pytest.mark.parametrize(("window", "shard", "task_tokens"), [(2048, 1024, 8 << 20), (64, 16, 3000)])
def test_every_id_in_one_piece_and_little_padding(spark, many_chunks, library, window, shard, task_tokens):
    rows = sample()
    got = packed(frame(spark, rows), PATH, window=window, shard=shard, task_tokens=task_tokens)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    pieces = got.collect()
    padding, sequences = check(pieces, rows, library, window)
    shards = 1 if shard == 1024 else len(rows) / shard + 40
    assert padding <= window * shards and sequences > 30


def test_no_rows(spark):
    assert packed(frame(spark, []), PATH).collect() == []


def test_ids_of_texts(library, monkeypatch):
    encoder = Encoder(PATH)
    assert encoder.quick
    rng = random.Random(1)
    texts = [
        "", " ", "a", "a b", " a", "a  b", "a   b ", "a \n b", "a\n\nb\n\n", "\n  a", "it's we'll 12 3a!? é é  x",
        "\x1c \x1d!\x1e a", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>", "🙂 語語 語", "a\u0085 b", "word.\nNext  line\t tab ",
    ]
    texts += ["".join(rng.choices(["a", "Bc", " ", "  ", "\n", "\t", "'s", "9", "é", "!", " ", "　"], k=rng.randrange(40))) for _ in range(800)]
    texts += ["y" * 3000, " " * 5000 + "x" + " " * 700]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.encode(t).tolist() for t in texts] == want
    monkeypatch.setattr("gleanery.llm.packing._STRETCH", 5)
    assert [encoder.encode(t).tolist() for t in texts] == want
    encoder.quick = None
    assert [encoder.encode(t).tolist() for t in texts[:50]] == want[:50]


def test_scores_are_bm25_and_neighbours_come_first():
    rng = np.random.default_rng(2)
    rests = [np.append(rng.integers(0, 40, rng.integers(1, 60)), 1).astype(np.uint16) for _ in range(50)]
    idf = rng.normal(size=50).clip(0).astype(np.float32)
    average = 30.0
    shard = Shard(rests, idf, average)
    for seed in (0, 7, 49):
        want = []
        for rest in rests:
            times = Counter(rest[:-1].tolist())
            norm = 1.2 * (1 - 0.75 + 0.75 * len(rest) / average)
            want.append(sum(idf[t] * times[t] * 2.2 / (times[t] + norm) for t in set(rests[seed][:-1].tolist())))
        assert np.allclose(shard.scores(seed), want, rtol=1e-5)
    seed, rest = 0, fill(Shard(rests, idf, average), 200)
    window = next(rest)
    scores = np.array(shard.scores(seed))
    chosen = [i for i, _, _ in window[1:]]
    others = [i for i in range(1, 50) if i not in chosen]
    assert window[0][:2] == (0, 0) and sum(n for _, _, n in window) == 200
    assert min(scores[chosen]) >= max(scores[others])


def test_related_documents_share_windows(spark, library):
    """Most neighbours of a document come from its own subject."""
    rng = random.Random(9)
    topics = [["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(40)] for _ in range(5)]
    rows = [(i, " ".join(rng.choices(topics[i % 5], k=60)), None) for i in range(200)]
    pieces = packed(frame(spark, rows), PATH).collect()
    of = defaultdict(list)
    for p in pieces:
        of[p["sequence_id"]].append(p["doc_id"] % 5)
    same = sum(Counter(x).most_common(1)[0][1] for x in of.values())
    assert same > 0.7 * len(pieces)


def test_query_over_all_documents(spark, library):
    from gleanery.llm.queries import op13_lexical_packing

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: ids_of(library, r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_lexical_packing(spark, folder).collect()
    total, sequences = 0, set()
    for r in got:
        ids = docs[r["doc_id"]]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert (len(part), r["doc_tokens"], r["ids_crc32"]) == (r["length"], len(ids), zlib.crc32(part.tobytes()))
        total += r["length"]
        sequences.add(r["sequence_id"])
    assert total == sum(map(len, docs.values())) and len(sequences) * 2048 - total < 2 * 2048
