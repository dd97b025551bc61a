import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))


def test_default_limits_remove_boilerplate_of_a_large_host(spark):
    rng = random.Random(3)
    footer = words(rng, 15)
    rows = [(i, words(rng, 40), "h") for i in range(180)]
    rows += [(1000 + i, f"{words(rng, 40)}\n{footer}", "h") for i in range(20)]  # a tenth of the host
    rows += [(2000, f"{words(rng, 10)}\n{footer}", "h")]  # little else
    rows += [(3000 + i, f"{words(rng, 40)}\n{footer}", "other") for i in range(19)]  # too few there
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert set(texts) == {i for i, *_ in rows} - {2000}
    assert all((footer in t) == (3000 <= i) for i, t in texts.items())
