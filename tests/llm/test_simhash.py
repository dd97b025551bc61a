import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import simhash
from gleanery.llm.simhash import components, fingerprint, linked, near_duplicates, segments

SCHEMA = "doc_id long, text string, fp string, root string"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, distance=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return sorted(((i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text("aAbÉé \n\t\x0b\x1f\u00a0", max_size=60))
def test_fingerprint_by_definition(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("select xxhash64('a b c d')").collect()[0][0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@settings(max_examples=500, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=9), st.integers(1, 7))
def test_a_chain_fits_exactly_within_the_distance(a, flips, distance):
    import numpy as np

    b = a
    for f in flips:
        b ^= 1 << f
    pair = np.array([a], np.uint64), np.array([b], np.uint64)
    found = any(linked(*pair, s, distance)[0] for s in range(len(segments(distance))))
    assert found == ((a ^ b).bit_count() <= distance)


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(4)
    result = near_duplicates(frame).select("doc_id", simhash.hex_digits(), "component_id")
    return sorted((tuple(r) for r in result.collect()), key=repr)


def sample(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(300)]
    passage = lambda n: rng.choices(words, k=n)
    rows = [(i, " ".join(passage(rng.randrange(1, 60)))) for i in range(150)]
    long = passage(400)
    for i in range(200):  # a large group of near copies
        edited = list(long)
        for _ in range(rng.randrange(6)):
            edited[rng.randrange(400)] = rng.choice(words)
        rows.append((1000 - i, " ".join(edited)))
    rows += [(2000 + i, rows[i][1].upper()) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "one"), (3004, "ONE"), (None, "one"), (None, "never seen")]
    return rows + rows[-4:] + [(5, "x " * 30_000)]


def test_equals_brute_force(spark):
    rows = sample(1)
    assert run(spark, rows) == expected(rows)


def test_dense_keys_keep_every_link(spark):
    """Fingerprints a few bits apart, compared directly: larger keys than any text gives here."""
    import numpy as np

    rng = random.Random(3)
    prints = {0}
    for _ in range(3000):
        p = rng.choice(sorted(prints)[-400:])
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(0, 64)
        prints.add(p)
    distance = 4
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(5)
    got = {r["node"]: r["root"] for r in components(simhash.links(frame, distance)).collect()}
    signed = sorted(int(np.uint64(p).view(np.int64)) for p in prints)
    root = {p: p for p in signed}

    def find(x, root=root):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(signed, np.int64).view(np.uint64)
    for i in range(len(signed)):
        near = np.flatnonzero(np.bitwise_count(values[i] ^ values) <= distance)
        for j in near.tolist():
            a, b = find(signed[i]), find(signed[j])
            root[max(a, b)] = min(a, b)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_no_rows_and_bad_parameters(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], SCHEMA), distance=0)


def test_query_over_all_documents(spark):
    from gleanery.llm.queries import op9_simhash

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op9_simhash(spark, folder).collect()), key=repr) == expected(rows)


def test_keys_of_many_fingerprints_are_cut(spark, monkeypatch):
    """All fingerprints share their first half: the same components whether a key lies in one task or in blocks."""
    rng = random.Random(4)
    prints = sorted({(0xABCDEF12 << 32) | rng.getrandbits(13) << rng.choice([0, 3]) for _ in range(3000)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    whole = {tuple(r) for r in components(simhash.links(frame)).collect()}
    monkeypatch.setattr(simhash, "KEY_ROWS", 100)
    links = simhash.links(frame)
    assert {tuple(r) for r in components(links).collect()} == whole and whole
    assert all((a ^ b).bit_count() % 64 for a, b in (tuple(r) for r in links.limit(50).collect()))
