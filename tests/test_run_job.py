import datetime

import pytest
from gleanery.plans.run_job import run_report, write_pages
from gleanery.sources.pages import seed_list

NAV = '<nav class="woocommerce-pagination"><a href="/2">2</a><a href="/3">3</a></nav><p>one</p>'
STARTED = datetime.datetime(2024, 5, 6, 7, 8, 9)


def site(spark):
    pages = spark.createDataFrame([(1, "http://www.s.org/1", NAV), (2, "http://www.s.org/2", "<h1>two</h1>")], "page_id bigint, url string, html string")
    return seed_list(spark, ["http://www.s.org/1", "http://www.s.org/2"]), pages


def test_a_run_is_written_and_read_again(spark, tmp_path):
    run = write_pages(*site(spark), str(tmp_path), ["name"], STARTED)
    assert run.name == "s_org_2024_05_06__07_08_09"
    texts = spark.read.parquet(run.pages).orderBy("file_no").collect()
    assert [(r.run, r.file_no, r.seed_pos, r.url[-2:], (r.markdown or "").split("\n")[-1]) for r in texts] == [
        (run.name, 1, 0, "/1", "one"),
        (run.name, 2, 0, "/2", "# two"),
        (run.name, 3, 0, "/3", ""),  # never fetched: its number stays
        (run.name, 4, 1, "/2", "# two"),
    ]
    asked = spark.read.parquet(run.requests)
    assert asked.where("user_prompt is not null").count() == 3 and asked.count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        write_pages(*site(spark), str(tmp_path), ["name"], STARTED)
    again = write_pages(*site(spark), str(tmp_path), ["name"], STARTED + datetime.timedelta(1), mode="append")
    assert spark.read.parquet(again.pages).groupBy("run").count().count() == 2


def test_no_seeds(spark, tmp_path):
    seeds, pages = site(spark)
    run = write_pages(seeds.limit(0), pages, str(tmp_path))
    assert run.name is None and spark.read.schema("file_no bigint").parquet(run.pages).count() == 0


def test_totals_of_each_seed(spark, tmp_path):
    run = write_pages(*site(spark), str(tmp_path), ["name"], STARTED)
    good = '{"listings": []}'
    replies = [(1, good, "m", 10, 1), (1, good, "m", 5, 1), (2, "broken", "m", 99, 99), (4, good, "free", 7, None), (77, good, "m", 1, 1)]
    frame = spark.createDataFrame(replies, "page_id bigint, reply string, model string, input_tokens bigint, output_tokens bigint")
    got = run_report(spark.read.parquet(run.requests), frame, {"m": (1.0, 2.0)}).orderBy("seed_pos").collect()
    assert [tuple(r) for r in got] == [(0, 3, 3, 15, 2, 19.0, 0, 1), (1, 1, 1, 7, 0, 0.0, 1, 0)]
    none = run_report(spark.read.parquet(run.requests), frame.limit(0), {"m": (1.0, 2.0)}).orderBy("seed_pos").collect()
    assert [tuple(r) for r in none] == [(0, 3, 0, 0, 0, 0.0, 0, 0), (1, 1, 0, 0, 0, 0.0, 0, 0)]
