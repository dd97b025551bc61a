"""The three jobs end to end on files, the sinks, the stream and the plans."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from gleanery.plans.merge_job import clean_job, merge_job, unify_job
from gleanery.plans.pages_job import pages_job
from gleanery.plans.replies_job import reply_costs, reply_records, reply_totals
from gleanery.queries import all_queries, records
from gleanery.session import scratch_path, shared_dir, written
from gleanery.sources.listing_files import scan_listing_files
from gleanery.sources.pages import first_seen, pages_of_seeds, read_pages, seed_list
from gleanery.sources.sinks import write_if_rows, write_run
from gleanery.streaming.page_stream import append_to, arriving_pages, arriving_prompts
from test_listings import FILES as DOCUMENTS

FILES = {name: case for name, case in DOCUMENTS.items() if case[0]}  # a file of zero bytes is not listed
SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    for name, (text, _) in DOCUMENTS.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "other.json").write_text('{"listings":[{"a":99}]}')
    (tmp_path / "sorted_data_z.txt").write_text('{"listings":[{"a":99}]}')
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "sorted_data_1.json").write_text('{"listings":[{"a":99}]}')
    return tmp_path


def test_scan_reads_direct_children_only(spark, folder, tmp_path):
    got = scan_listing_files(spark, str(folder))
    assert {r.file: r.text for r in got.collect()} == {k: v[0] for k, v in FILES.items()}
    assert scan_listing_files(spark, str(tmp_path / "below" / "nothing")).count() == 0


def test_merge_job(spark, folder, tmp_path):
    listings = [{"price": "$5", "image_url": " http://i ", "nested": {"k": 1}}, {"cost": "9 EUR", "name": "n"}]
    (folder / "sorted_data_x.json").write_text(json.dumps({"listings": listings}, indent=4))
    out = tmp_path / "out"
    path, rejects = merge_job(spark, str(folder), str(out), [("price", ["price", "cost"])])
    got = spark.read.parquet(path).where("file = 'sorted_data_x.json'").orderBy("pos")
    assert [(r.price, r.image_url, r["nested.k"], r.name) for r in got.collect()] == [
        ("€5.00", "https://i", 1, None),
        ("9 EUR", None, None, "n"),
    ]
    assert {r.file: r.reason for r in rejects.collect()} == {k: v[1] for k, v in FILES.items() if v[1] != "ok"}


def test_lists_of_urls_are_cleaned(spark, tmp_path):
    listings = [{"image_url": [" http://a ", "http://b"], "product_url": {"x": 1}, "file": "f", "pos": 3}]
    (tmp_path / "sorted_data_1.json").write_text(json.dumps({"listings": listings}))
    path, _ = merge_job(spark, str(tmp_path), str(tmp_path / "out"))
    row = spark.read.parquet(path).first().asDict()
    assert row["image_url"] == ["https://a", "https://b"] and (row["file"], row["pos"], row["_pos"]) == ("f", 3, 0)


def test_the_merge_asks_for_a_mapping_and_follows_the_reply(spark, tmp_path):
    (tmp_path / "sorted_data_1.json").write_text('{"listings":[{"price":"$5"},{"cost":"9 EUR"}]}')
    done = clean_job(spark, str(tmp_path), str(tmp_path / "out"))
    assert '"price": ["€5.00",null]' in done.request.first().user_prompt
    for reply, columns in (('{"price":["price","cost"]}', ["file", "pos", "price"]), ("{}", None), ("no", None)):
        replies = spark.createDataFrame([(1, reply)], "id int, reply string")
        path = unify_job(spark, done.path, replies, str(tmp_path / "unified"))
        assert (path == done.path) == (columns is None)
        if columns:
            assert spark.read.parquet(path).columns == columns


def test_merge_job_writes_nothing_without_rows(spark, tmp_path):
    (tmp_path / "sorted_data_1.json").write_text("{}")
    path, rejects = merge_job(spark, str(tmp_path), str(tmp_path / "out"))
    assert path is None and not (tmp_path / "out").exists() and rejects.count() == 1


def test_merge_jobs_write_records_once_and_no_text(spark, folder, tmp_path, monkeypatch):
    tables = []

    def spy(df, label, path=None):
        tables.append((label, df.columns))
        return written(df, label, path)

    monkeypatch.setattr("gleanery.plans.merge_job.written", spy)
    monkeypatch.setattr("gleanery.operators.listings.written", spy)
    assert clean_job(spark, str(folder), str(tmp_path / "a")).path and merge_job(spark, str(folder), str(tmp_path / "b"))[0]
    assert tables == [("classified", ["file", "listings", "reason"])] * 2


def test_scratch_tables_hold_a_variant_as_one_value(spark):
    df = spark.range(100).select(F.parse_json(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit(', "b": "x"}'))).alias("v"))
    back = written(df, "records")
    found = pq.read_schema(back.inputFiles()[0].removeprefix("file:")).field("v").type
    assert {field.name for field in found} == {"value", "metadata"}
    assert sum(r[0] for r in back.select(F.try_variant_get("v", "$.a", "int")).collect()) == sum(range(100))


def test_listing_scan_writes_all_lines_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "_LINES", 1000)
    monkeypatch.setattr(records, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = {r.reason: r.documents for r in records.q_listing_scan(spark, SF).collect()}
    lines = records.listing_documents(spark, SF).agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    for name in ("sorted_data_1.json", "other.json"):
        files = list((tmp_path / "scan" / name).glob("part-*"))
        assert len(files) >= lines[0] // 1000 and sum(f.stat().st_size for f in files) < lines[1] / 2
        assert spark.read.text(str(tmp_path / "scan" / name)).count() == lines[0] == sum(found.values())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x,"y"\n z', [1]), ("b", None, None)], "run string, t string, l array<int>")
    path = write_run(df, str(tmp_path), "csv", run_key="run")
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    assert sorted(rows(back.select("run", "t", "l")), key=str) == [("a", 'x,"y"\n z', "[1]"), ("b", None, None)]
    path = write_run(df, str(tmp_path), "json")
    assert sorted(rows(spark.read.json(path).select("run", "t")), key=str) == [("a", 'x,"y"\n z'), ("b", None)]
    assert write_if_rows(df.where("run = 'c'"), str(tmp_path / "none"), "parquet") is None
    with pytest.raises(Exception, match="(?i)exists"):
        write_run(df, str(tmp_path), "json")


@pytest.mark.parametrize("small", [0, 100_000])
def test_pages_job_numbers_missing_pages_too(spark, monkeypatch, small):
    monkeypatch.setattr("gleanery.session.SMALL_ROWS", small)
    nav = '<nav class="woocommerce-pagination"><a href="/2">2</a><a href="/3">3</a></nav><p>one</p>'
    pages = spark.createDataFrame(
        [(1, "http://s/1", nav), (2, "http://s/2", "<footer>f</footer><h1>two</h1>")], "page_id bigint, url string, html string"
    )
    seeds = seed_list(spark, ["http://s/1", "http://s/2", "http://s/1"])
    got = pages_job(seeds, pages, ["name"]).orderBy("file_no")
    assert [(r.file_no, r.seed_pos, r.depth, r.url, (r.markdown or "").split("\n")[-1]) for r in got.collect()] == [
        (1, 0, 0, "http://s/1", "one"),
        (2, 0, 1, "http://s/2", "# two"),
        (3, 0, 1, "http://s/3", ""),
        (4, 1, 0, "http://s/2", "# two"),
        (5, 2, 0, "http://s/1", "one"),
        (6, 2, 1, "http://s/2", "# two"),
        (7, 2, 1, "http://s/3", ""),
    ]
    assert pages_of_seeds(seeds, pages).where("html is null").count() == 0
    doubled = pages.unionByName(pages.selectExpr("page_id + 10 as page_id", "url", "html"))
    assert sorted(r.page_id for r in first_seen(doubled).collect()) == [1, 2]


def test_seeds_without_a_page_keep_their_row(spark):
    pages = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "page_id bigint, url string, html string")
    seeds = seed_list(spark, ["b", "c", "b"])
    got = sorted(rows(pages_of_seeds(seeds, pages).select("seed_pos", "url", "page_id", "html")))
    assert got == [(0, "b", 2, "B"), (1, "c", None, None), (2, "b", 2, "B")]


def test_replies_job(spark):
    data = [(1, '{"listings":[{"a":1},{"a":2}]}', "m", 10, 2), (2, "no", "m", 99, 99), (3, '[{"a":3}]', "x", 1, 1)]
    df = spark.createDataFrame(data, "page_id bigint, reply string, model string, input_tokens bigint, output_tokens bigint")
    assert sorted((r.page_id, r.pos) for r in reply_records(df).collect()) == [(1, 0), (1, 1), (3, 0)]
    prices = {"m": (1.0, 2.0)}
    assert {r.page_id: r.cost for r in reply_costs(df, prices).collect()} == {1: 14.0, 2: 0.0, 3: None}
    assert reply_totals(df, prices).first().asDict() == {
        "calls": 3, "input_tokens": 11, "output_tokens": 3, "cost": 14.0, "unpriced_calls": 1, "failed": 1,
    }


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    pages = read_pages(spark, f"{SF}/pages.parquet")
    pages.repartition(3).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = arriving_prompts(arriving_pages(spark, source, 1), ["name"])
        append_to(stream, target, str(tmp_path / "state"), once=True).awaitTermination()
    got = spark.read.parquet(target)
    assert got.exceptAll(arriving_prompts(pages, ["name"])).count() == 0 and got.count() == pages.count()


def test_narrow_queries_do_not_read_html(spark):
    for name in ("site_key", "clean_url"):
        plan = plan_of(all_queries()[name](spark, SF))
        assert "html" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["page_markdown", "page_links", "strip_chrome", "flatten_listings", "reply_parse", "unify_columns", "clean_price"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(all_queries()[name](spark, SF))


def test_totals_aggregate_before_the_shuffle(spark):
    plan = plan_of(all_queries()["run_totals"](spark, SF))
    assert "partial_sum" in plan and "CartesianProduct" not in plan


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_dir(spark)
    assert scratch_path(spark, "t").startswith(folder) and scratch_path(spark, "t") != scratch_path(spark, "t")
    assert spark.sparkContext.getCheckpointDir().startswith(("file:" + folder, folder))
