import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.suffixes import cut_text, remove_shared_bytes, suffix_array

SCHEMA = "doc_id long, text string, kept string, start string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_equals_sorting(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("text", [[1] * 500, [1, 2] * 200, [2, 1] * 200 + [3], list(range(300)), list(range(300, 0, -1))])
def test_suffix_array_of_regular_texts(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def expected(rows, k):
    """Brute force: the smallest doc_id of every window."""
    last = 2**63
    first = {}
    docs = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for d, b in docs:
        for s in range(len(b) - k + 1):
            first[b[s : s + k]] = min(first.get(b[s : s + k], last + 1), d)
    out = []
    for (i, _), (d, b) in zip(rows, docs, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - k + 1):
            if first[b[s : s + k]] < d:
                gone[s : s + k] = [True] * k
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, kept, len(b), len(b) - len(kept), spans))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randrange(1, 8))) for _ in range(60)]
    passage = lambda n: " ".join(rng.choices(words, k=n))
    shared = [passage(30) for _ in range(4)]
    rows = [(i, passage(rng.randrange(40)) + rng.choice(shared)[rng.randrange(40) :] + passage(5)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + i, rows[0][1][:-9] + "x" * i) for i in range(6)]
    rows += [(300, shared[0] * 5), (301, shared[0] * 3), (302, "aaaa" * 200), (303, "aaaa" * 90), (304, "ab" * 150)]
    rows += [(305, None), (306, ""), (307, "short"), (None, shared[1] + "tail"), (None, shared[1]), (5, shared[2] * 2)]
    return rows + rows[:3] + rows[-3:]


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, monkeypatch, hot):
    if hot:  # every minimiser found more than 64 times is split into windows
        monkeypatch.setattr("gleanery.llm.windows.HOT_BYTES", 1000)
    rows = sample(4)
    if hot:
        rows += [(1000 + i, f"{i:06d}" * 4 + rows[0][1][:80] + f"{i:05d}" * 9) for i in range(150)]
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(5)
    result = remove_shared_bytes(frame).drop("rest")
    got = [(r[0], bytes(r[1]), *r[2:]) for r in result.collect()]
    assert sorted(got, key=repr) == expected(rows, 50)


def test_hot_minimisers_of_very_many_bytes(spark):
    """Runs times bytes go beyond 64 bits: the same choice as by exact numbers."""
    from gleanery.llm.suffixes import _SLICE, read_bytes
    from gleanery.llm.windows import HOT_BYTES, Scheme, _keyed, hot_minimisers, runs_of

    passage = " shared by all of the texts and so found very often in them "
    bodies = [f"{i:07d}" * 9 + passage for i in range(300)]
    scheme = Scheme(read_bytes, 50, 12, within=False, spread=3.45, slice_bytes=_SLICE)
    times = Counter(runs_of(read_bytes([b.encode() for b in bodies]), 50, 12)[0].low.tolist())
    total = sum(times.values())
    packed = 1 << 55
    assert total * packed > 1 << 63
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").coalesce(1)
    want = sorted(low for low, n in times.items() if n > 64 and 2 * n * packed >= HOT_BYTES * total)
    assert want and hot_minimisers(_keyed(docs), scheme, packed)[0].tolist() == want


def test_hot_minimisers_are_split_by_longer_grams(spark, monkeypatch):
    """Windows that share a common gram travel joined, not as 50 bytes each; those of one more common alone."""
    from gleanery.llm import windows
    from gleanery.llm.suffixes import _SLICE, read_bytes

    rng = random.Random(8)
    middle = "a common gram!"
    bodies = ["".join(rng.choices("bcdefgh", k=150)) + middle + "".join(rng.choices("bcdefgh", k=150)) for _ in range(400)]
    scheme = windows.Scheme(read_bytes, 50, 12, within=False, spread=3.45, slice_bytes=_SLICE, fine=32)
    part = read_bytes([b.encode() for b in bodies])
    runs = windows.runs_of(part, 50, 12)[0]
    hot = np.array([low for low, n in Counter(runs.low.tolist()).items() if n > 64], np.uint64)
    hot.sort()
    assert len(hot)
    split = windows._split(part, runs, 50, 32, hot, hot[:0])
    where = lambda r: (windows.ranges(r.start, r.windows).tolist(), np.repeat(r.doc, r.windows).tolist())
    assert where(split) == where(runs)  # every window once, in the same order
    alone = windows._alone(part, runs, 50, hot)
    assert where(alone) == where(runs)
    size = lambda r: int((r.windows + 49).sum())
    assert size(split) - size(runs) < (size(alone) - size(runs)) / 5
    # Equal windows have one minimiser, whatever document and place they are found in.
    data = part.data.tobytes()
    held = {}
    for start, many, low in zip(split.start.tolist(), split.windows.tolist(), split.low.tolist(), strict=True):
        for i in range(start, start + many):
            held.setdefault(data[i : i + 50], set()).add(low)
    assert all(len(x) == 1 for x in held.values())
    everywhere = np.unique(split.low)
    single = windows._split(part, runs, 50, 32, hot, everywhere)
    assert where(single) == where(runs) and size(single) == size(alone)
    # Counted over a table, in windows of the hot minimisers only.
    monkeypatch.setattr(windows, "HOT_BYTES", 1000)
    docs = spark.createDataFrame(list(enumerate(bodies * 80)), "doc_id long, text string").coalesce(1)
    fine_hot, _ = windows.hot_minimisers(windows._keyed(docs), scheme, 1 << 40, hot)
    assert len(fine_hot) and set(fine_hot.tolist()) <= set(everywhere.tolist())


def test_places_beyond_the_reserved_bits(spark, monkeypatch):
    monkeypatch.setattr("gleanery.llm.suffixes._PLACES", 2)
    rows = sample(9)
    result = remove_shared_bytes(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).drop("rest")
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in result.collect()), key=repr) == expected(rows, 50)


def test_longest_common_grams_win_whatever_the_hash(monkeypatch):
    """Strings cut in a buffer of many places as in one of few."""
    import numpy as np

    from gleanery.llm.suffixes import _fragments

    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 60_000).astype(np.uint8)
    sizes = np.array([60_000])
    few = _fragments(data, sizes, 50, 32)
    monkeypatch.setattr("gleanery.llm.suffixes._PLACES", 24)
    many = _fragments(data, sizes, 50, 32)
    assert all((a == b).all() for a, b in zip(few, many, strict=True))
    string, start, windows, place, _ = few
    assert ((place >= start) & (place + 32 <= start + 50 + windows - 1)).all() and windows.sum() == 60_000 - 49


def bucket_of(rows):
    """One bucket, all of whose strings have the same minimiser: (doc, start, string), in this order."""
    import numpy as np

    from gleanery.llm.windows import Bucket

    d, start, strings = zip(*rows, strict=True)
    size, none = np.array([len(x) for x in strings]), np.zeros(len(rows), np.int64)
    return Bucket(
        np.array(d), none, np.array(start), size - 49, none, none, np.cumsum(size) - size, size,
        np.frombuffer(b"".join(strings), np.uint8),
    )


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_windows_of_a_bucket_equal_brute_force(seed):
    from gleanery.llm.suffixes import shared_windows

    rng = random.Random(seed)
    passages = [bytes(rng.choices(b"ab" if i else b"a", k=rng.randrange(50, 90))) for i in range(4)]
    cut = lambda p: p[rng.randrange(len(p) - 49) :]
    edge = lambda: bytes(rng.choices(b"ab", k=rng.randrange(3)))
    rows = [
        (d, 1000 * i, edge() + cut(rng.choice(passages)) + edge())
        for i, d in enumerate(sorted(rng.choices(range(6), k=rng.randrange(1, 30))))
    ]
    least = {}
    for d, _, x in rows:
        for s in range(len(x) - 49):
            least[x[s : s + 50]] = min(least.get(x[s : s + 50], d), d)
    want = {(i, s) for i, (d, _, x) in enumerate(rows) for s in range(len(x) - 49) if least[x[s : s + 50]] < d}
    found = (x.tolist() for x in shared_windows(bucket_of(rows), 50, 32))
    got = [(row, offset + j) for row, offset, count in zip(*found, strict=True) for j in range(count)]
    assert set(got) == want and len(got) == len(want)


def test_strings_without_an_equal_window_are_not_sorted(monkeypatch):
    """Sharing a gram of 32 bytes is not enough: 50 have to be equal for a string to come into a suffix array."""
    from gleanery.llm import suffixes

    sorted_out = []
    whole = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: sorted_out.append(len(text)) or whole(text))
    gram = bytes(range(97, 123)) + b"0123456789ABCD"  # 40 bytes in common
    rows = [(1, 0, b"x" * 15 + gram + b"x" * 15), (2, 0, b"y" * 15 + gram + b"y" * 15)]
    assert not len(suffixes.shared_windows(bucket_of(rows), 50, 32)[0]) and not sorted_out
    rows.append((3, 0, b"z" * 5 + rows[0][2][5:60] + b"z" * 5))
    found, offset, count = suffixes.shared_windows(bucket_of(rows), 50, 32)
    assert set(found.tolist()) == {2} and count.sum() == 6 and offset.min() == 5
    assert sorted_out


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr("gleanery.llm.suffixes._SLICE", 500)
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=6000))
    rows = [(1, long), (2, long[1000:3000] + "tail" + long[:500]), (3, "x" * 40 + long[2000:2100]), (4, "y" * 3000)]
    result = remove_shared_bytes(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).drop("rest")
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in result.collect()), key=repr) == expected(rows, 50)


def test_any_column_name_is_carried(spark):
    docs = spark.createDataFrame([(1, "a", 1.5, [1])], "doc_id long, text string, `my col` double, `a.b` array<int>")
    got = cut_text(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a", 1.5, [1])]


def test_no_rows_and_bad_parameters(spark):
    assert remove_shared_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        remove_shared_bytes(spark.createDataFrame([], SCHEMA), 50, 12, 60)


def test_query_over_all_documents(spark):
    from gleanery.llm.queries import op8_suffix_array

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, kept, n, gone, spans in expected(rows, 50)}
    assert {tuple(r) for r in op8_suffix_array(spark, folder).collect()} == want
