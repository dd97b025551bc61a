import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gleanery.operators.crawl_state import CrawlState
from gleanery.operators.frontier import crawl_frontier, first_page, visit_numbers


def walk(seeds, edges):
    """The visiting order of a queue with a visited set, seed by seed."""
    visits = []
    for seed_pos, start in seeds:
        queue, seen, depth = deque([start]), set(), {start: 0}
        while queue:
            url = queue.popleft()
            if url in seen:
                continue
            visits.append((len(visits) + 1, seed_pos, depth[url], url))
            seen.add(url)
            for target in edges.get(url, []):
                if target not in seen and target not in queue:
                    queue.append(target)
                    depth[target] = depth[url] + 1
    return visits


def tables(spark, seeds, edges):
    links = [(s, i, d) for s, ds in edges.items() for i, d in enumerate(ds)]
    return (
        spark.createDataFrame(seeds, "seed_pos int, url string"),
        spark.createDataFrame(links, "src_url string, pos int, dst_url string"),
    )


def test_golden_cycle(spark):
    seeds, links = tables(spark, [(0, "0")], {"0": ["1"], "1": ["2"], "2": ["0", "3"]})
    got = sorted((r.url, r.depth) for r in crawl_frontier(seeds, links).collect())
    assert got == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]
    assert crawl_frontier(seeds, links, max_depth=1).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_visiting_order_matches_a_queue(spark, many_chunks, seed):
    rng = random.Random(seed)
    nodes = [f"u{i}" for i in range(40)]
    edges = {n: rng.sample(nodes, rng.randint(0, 4)) for n in nodes}
    seeds = [(0, "u3"), (1, "u7"), (2, "u3"), (3, "u3"), (4, "elsewhere")]
    visits = visit_numbers(crawl_frontier(*tables(spark, seeds, edges), ordered=True))
    got = sorted((r.file_no, r.seed_pos, r.depth, r.url) for r in visits.collect())
    assert got == walk(seeds, edges)
    assert len({(s, u) for _, s, _, u in got}) == len(got)


@pytest.mark.parametrize("small", [0, 1, 100_000])
def test_every_size_of_round_gives_the_same(spark, monkeypatch, small):
    monkeypatch.setattr("gleanery.session.SMALL_ROWS", small)
    edges = {str(i): [str(i + 1), "0"] for i in range(9)}
    got = crawl_frontier(*tables(spark, [(0, "0")], edges))
    assert sorted((r.depth, r.url) for r in got.collect()) == [(i, str(i)) for i in range(10)]


def test_first_page_with_nulls(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (None, None)], "page_id int, url string")
    assert [tuple(r) for r in first_page(df, ["url", "page_id"]).collect()] == [(None, None)]


def test_first_page(spark):
    df = spark.createDataFrame([(2, "b", "B"), (1, "c", "C"), (9, "a", "A"), (4, "a", "A4")], "page_id int, url string, html string")
    assert [tuple(r) for r in first_page(df, ["url", "page_id"]).select("page_id", "html").collect()] == [(4, "A4")]


def depths(spark, seeds, edges):
    full = crawl_frontier(*tables(spark, [(i, s) for i, s in enumerate(sorted(set(seeds)))], edges))
    starts = dict(enumerate(sorted(set(seeds))))
    return sorted((starts[r.seed_pos], r.url, r.depth) for r in full.collect())


@pytest.mark.parametrize("small", [0, 100_000])
def test_batches_of_links_give_what_a_full_crawl_gives(spark, monkeypatch, tmp_path, small):
    monkeypatch.setattr("gleanery.session.SMALL_ROWS", small)
    rng = random.Random(5)
    nodes = [f"u{i}" for i in range(60)]
    state = CrawlState(spark, str(tmp_path / "state"), buckets=8)
    edges, seeds = {}, []
    for batch, starts in enumerate((["u1", "u2"], ["u1", "u9"], [])):
        more = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(50)]
        if batch == 2:
            more += more[:10] + [("u1", "u59"), (None, "u3"), ("u3", None)]  # known again, and a short way
        seeds += starts
        for a, b in more:
            if a and b:
                edges.setdefault(a, []).append(b)
        state.add(
            spark.createDataFrame([(s,) for s in starts], "url string"),
            spark.createDataFrame(more, "src_url string, dst_url string"),
        )
        got = sorted(tuple(r) for r in state.depths().collect())
        assert got == depths(spark, seeds, edges)
    again = state.add(spark.createDataFrame([("u1",)], "url string"), spark.createDataFrame(more[:5], "src_url string, dst_url string"))
    assert again == 0 and sorted(tuple(r) for r in state.depths().collect()) == got


def test_a_round_reads_the_partitions_of_its_addresses(spark, tmp_path, monkeypatch):
    state = CrawlState(spark, str(tmp_path / "state"), buckets=32)
    tree = [(f"n{i}", f"n{j}") for i in range(400) for j in (2 * i + 1, 2 * i + 2)]
    empty = spark.createDataFrame([], "url string")
    state.add(spark.createDataFrame([("n0",)], "url string"), spark.createDataFrame(tree, "src_url string, dst_url string"))
    read, near = [], CrawlState._near

    def files(part):
        return part.select(F.input_file_name()).distinct().count()

    def spy(self, name, schema, rows, url):
        part = near(self, name, schema, rows, url)
        read.append((name, files(part)))
        return part

    monkeypatch.setattr(CrawlState, "_near", spy)
    everything = {name: files(state._table(name, "bucket int")) for name in ("links", "depths")}
    rounds = state.add(empty, spark.createDataFrame([("n800", "elsewhere")], "src_url string, dst_url string"))
    assert rounds == 1
    assert all(n <= everything[name] / 4 for name, n in read) and read
