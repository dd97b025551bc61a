import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from gleanery.functions.urls import clean_url, resolve_url, run_key, site_key

BASES = [
    "http://a/b/c/d;p?q",
    "http://a",
    "https://www.x.org/a/../b/?x=1#f",
    "http://a/b/",
    "HTTP://A/b//c",
    "",
    "http://u:p@h:80/p",
    "ftp://h/x/y",
]
HREFS = [
    "", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", ".", "./", "..", "../", "../g",
    "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.",
    "g/./h", "g/../h", "http:g", "http://z/y/../x?#", "mailto:a@b", "javascript:void(0)", "//g?y", "a//b", "/a//b",
    "\tg\n x", "?", "#", "HTTPS://Q/x", "http:", "http:?y", "a b", "ünï/ß?ö=ä", "a:b", "1:2",
]


def test_resolve_url_agrees_with_urljoin(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string")
    got = df.select("b", "h", resolve_url(F.col("b"), F.col("h")).alias("r")).collect()
    assert [(r.b, r.h, r.r) for r in got if r.r != urljoin(r.b, r.h)] == []


URLS = ["https://www.shop.example.com:8080/a/b", "shop.example.org/x?y", "http://www.a-b.c", "//cdn.é.org/p", "/rooted"]


def test_site_keys(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    for row in df.select("u", site_key(F.col("u")).alias("k")).collect():
        parsed = urlparse(row.u)
        host = re.sub(r"^www\.", "", parsed.netloc or parsed.path.split("/")[0])
        assert row.k == re.sub(r"\W+", "_", host)
    both = df.where("u like 'http%'").select("u", site_key(F.col("u"), keep_www=True).alias("k")).collect()
    for row in both:
        assert row.k == re.sub(r"\W+", "_", row.u.split("//")[1].split("/")[0])


def test_run_key(spark):
    df = spark.sql("select 'http://www.a.b/c' u, timestamp '2024-10-17 12:34:56' t")
    assert df.select(run_key(F.col("u"), F.col("t"))).first()[0] == "a_b_2024_10_17__12_34_56"


def test_clean_url(spark):
    df = spark.createDataFrame([(" http://b ",), ("x?u=http://a",), (" https://c\n",), (None,)], "u string")
    once = df.select(clean_url(F.col("u")).alias("u"))
    assert [r.u for r in once.collect()] == ["https://b", "x?u=https://a", "https://c", None]
    assert once.select(clean_url(F.col("u"))).collect() == once.collect()
