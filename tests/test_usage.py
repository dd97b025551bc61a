from conftest import plan_of, rows
from gleanery.operators.usage import call_cost, error_report, request_tokens, run_totals, triage_errors

PRICES = {"m": (2.0, 3.0), "n": (0.5, 0.25)}
CALLS = [(1, "m", 10, 1), (2, "m", None, 2), (3, "n", 4, None), (4, "other", 7, 7), (5, None, 1, 1)]


def calls(spark):
    return spark.createDataFrame(CALLS, "call_id int, model string, input_tokens bigint, output_tokens bigint")


def test_two_prices_of_a_model_count_a_call_once(spark):
    from gleanery.operators.usage import run_totals

    usage = spark.createDataFrame([("m", 10, 1)], "model string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 1.0)], "model string, input double, output double")
    row = run_totals(usage, prices).first()
    assert (row.calls, row.input_tokens, row.cost) == (1, 10, 32.0)


def test_costs(spark):
    expected = [(1, 23.0, False), (2, 6.0, False), (3, 2.0, False), (4, None, True), (5, None, True)]
    assert rows(call_cost(calls(spark), PRICES).select("call_id", "cost", "unpriced").orderBy("call_id")) == expected
    table = spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, input double, output double")
    joined = call_cost(calls(spark), table)
    assert rows(joined.select("call_id", "cost", "unpriced").orderBy("call_id")) == expected
    joined.collect()
    assert "BroadcastHashJoin" in plan_of(joined) or "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_standard_price_is_free(spark):
    df = spark.createDataFrame([("Groq Llama3.1 70b", 5, 5)], "model string, input_tokens bigint, output_tokens bigint")
    assert rows(call_cost(df).select("cost", "unpriced")) == [(0.0, False)]


def test_totals(spark):
    assert rows(run_totals(calls(spark), PRICES)) == [(5, 22, 11, 31.0, 2)]
    assert rows(run_totals(calls(spark).where("call_id > 9"), PRICES)) == [(0, 0, 0, 0.0, 0)]
    by = run_totals(calls(spark).selectExpr("*", "call_id <= 2 as early"), PRICES, by=["early"])
    assert sorted(rows(by)) == [(False, 3, 12, 8, 2.0, 2), (True, 2, 10, 3, 29.0, 0)]


def test_request_tokens(spark):
    df = spark.createDataFrame([(1, "a b"), (1, " c\n"), (2, "")], "r int, t string")
    assert sorted(rows(request_tokens(df, "r", "t"))) == [(1, 3), (2, 0)]


def test_triage(spark):
    messages = {
        "rate_limit_exceeded: Please try again in 1.5s.": ("wait", 1.5),
        "rate_limit_exceeded: Please try again in 0s": ("backoff", None),
        "rate_limit_exceeded: Please try again in ..s": ("backoff", None),
        "rate_limit_exceeded 503": ("backoff", None),
        "Error 503": ("backoff", None),
        "Please try again in 9s": ("stop", None),
        "bad key": ("stop", None),
    }
    df = spark.createDataFrame([(m,) for m in messages], "msg string")
    got = triage_errors(df)
    assert {r.msg: (r.action, r.wait_seconds) for r in got.collect()} == messages
    assert sorted(rows(error_report(got)), key=str) == [("backoff", 4, None), ("stop", 2, None), ("wait", 1, 1.5)]
