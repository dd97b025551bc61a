from gleanery.llm.urlgraph import host_edges, judge_urls

SCHEMA = "page_id long, url string, html string"


def anchors(*links):
    return "".join(f'<a class="x" href="{x}">x</a>' for x in links)


def body_page(i, url, *links):
    return (i, url, f"<html><body><article><p>text {anchors(*links)}</p></article></body></html>")


def test_links_count_wherever_they_stand(spark):
    html = (
        f"<nav>{anchors('http://first.org/')}</nav><article>{anchors('http://article.org/')}</article>"
        f"<ul><li>{anchors('http://list.org/', '/own')}</li></ul><nav>{anchors('http://second.org/')}</nav>"
        f"<!-- {anchors('http://comment.org/')} --><script>{anchors('http://script.org/')}</script>"
        f"<footer>{anchors('//footer.org/x')}</footer>"
    )
    rows = [(1, "http://a.com/1", html), body_page(2, "http://b.com/1", "http://a.com/2")]
    got = {tuple(r) for r in host_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    names = ("first", "article", "list", "second", "footer")
    assert got == {("a.com", f"{x}.org", 1) for x in names} | {("b.com", "a.com", 1)}


def test_many_equal_linkers_are_blocked_as_one_is(spark):
    evil = [body_page(0, "http://evil.net/a", "http://evil2.net/"), body_page(1, "http://evil2.net/a", "http://evil.net/")]
    farm = [body_page(10 + i, f"http://farm{i}.com/", "http://evil.net/a") for i in range(100)]
    behind = [body_page(200, "http://behind.com/", *(f"http://farm{i}.com/" for i in range(9)))]
    fair = [body_page(300, "http://fair.com/", "http://evil.net/a", *(f"http://plain{i}.com/" for i in range(4)))]
    rows = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(evil + farm + behind + fair, SCHEMA)).collect()}
    assert {rows[10 + i]["verdict"] for i in range(100)} == {"block"}
    assert {round(rows[10 + i]["distrust"], 6) for i in range(100)} == {0.85}
    assert rows[200]["verdict"] == "block" and rows[300]["verdict"] == "allow"
    assert all(0 <= r["distrust"] <= 1 for r in rows.values())


def test_a_farm_with_links_in_the_body_is_blocked(spark):
    evil = [body_page(i, f"http://evil{i}.net/a") for i in range(4)]
    farm = [body_page(100, "http://farm.com/", *(f"http://evil{i}.net/a" for i in range(4)))]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(evil + farm, SCHEMA)).collect()}
    assert got[100] == "block"
