"""Shared statements on small tables made by hand, with rows worked out by hand and not by the statement's own text."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from docweave import registry  # noqa: F401  gathers all statements
from docweave.plans.analytics import STATEMENTS

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
CHATS = "conv_id long, turn long, role string, text string"


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def events(spark, *rows):
    """(ts, user, kind, value) each."""
    return spark.createDataFrame([(k, *r, "{}") for k, r in enumerate(rows)], EVENTS)


def lines(spark, *rows):
    """(order, part, supplier, line, quantity, discount, tax, flag) each."""
    return spark.createDataFrame([(o, p, s, n, float(q), 1.0, float(d), float(t), f, "O", at(1)) for o, p, s, n, q, d, t, f in rows], LINES)


def run(spark, key, **tables):
    return sorted(map(tuple, spark.sql(STATEMENTS[key].sql, **tables).collect()), key=str)


@pytest.mark.parametrize(
    "number,quantity,model,cogs,charge",
    [
        (0, 10_000, "gemini-2.5-flash", "0.47500000", "0.78000000"),  # 1,000,000 tokens in and 70,000 out
        (2, 1, "gemini-2.5-pro", "0.00019500", "0.00039000"),  # 100 in, 7 out
        (3, 0, "gemini-2.0-flash", "0E-8", "0E-8"),  # no tokens
        (4, 500, "unknown", "0E-8", "0E-8"),  # a model without rates costs nothing
    ],
)
def test_costs_of_a_model(spark, number, quantity, model, cogs, charge):
    got = run(spark, "llm_cost_decimal", lineitem=lines(spark, (1, 1, 1, number, quantity, 0, 0, "N")))
    assert got == [(model, 1, Decimal(cogs), Decimal(charge))]


def test_costs_add_up_without_rounding_away(spark):
    rows = [(k, 1, 1, 1, 1, 0, 0, "N") for k in range(1000)]  # 100 and 7 tokens: 0.00002375 and 0.000039 each
    assert run(spark, "llm_cost_decimal", lineitem=lines(spark, *rows)) == [("gemini-2.5-flash-lite", 1000, Decimal("0.02375000"), Decimal("0.03900000"))]


def test_shares_in_percent(spark):
    df = events(spark, *[(at(1), 1, "view", 1.0)] * 2, *[(at(1), 1, "click", 1.0)] * 1, *[(at(2), 2, "error", 1.0)] * 5)
    assert run(spark, "usage_pct_share", events=df) == [("click", 1, 12.5), ("error", 5, 62.5), ("view", 2, 25.0)]


def test_alert_is_pending_for_two_days_and_then_fires(spark):
    bad = {1: 1, 2: 5, 3: 6, 4: 7, 5: 0, 6: 4, 7: 2}  # errors of ten events a day; more than 19 % breach
    df = events(spark, *[(at(d, k), 1, "error" if k < n else "view", 1.0) for d, n in bad.items() for k in range(10)])
    got = {r[0].day: (r[1], r[2]) for r in run(spark, "alert_firing", events=df)}
    assert {d: s for d, (_, s) in got.items()} == {1: "ok", 2: "pending", 3: "pending", 4: "firing", 5: "ok", 6: "pending", 7: "pending"}
    assert got[4][0] == 3 and got[6][0] == 1


def test_quantiles_interpolate(spark):
    df = events(spark, *[(at(1, 5, k), 1, "view", float(v)) for k, v in enumerate((10, 20, 30, 40))], (at(1, 6), 1, "view", 7.0), (at(1, 6, 1), 1, "view", None))
    assert run(spark, "window_quantile", events=df) == [(at(1, 5), 38.5), (at(1, 6), 7.0)]
    assert run(spark, "latency_percentiles", events=df) == [("view", 20.0, 30.0, 36.0, 38.0)]


def test_retrieval_rates(spark):
    df = events(spark, *[(at(1), 1, "view", v) for v in (10.0, 34.9, 35.0, 80.0)], (at(1), 1, "click", 50.0))
    assert run(spark, "rag_eval_segmented", events=df) == [("click", 1, 50.0, 0, 0.0, 1.0), ("view", 4, 39.975, 2, 0.5, 0.25)]
    df = events(spark, (at(3), 1, "view", 9.99), (at(3, 4), 1, "view", 10.0), (at(4), 1, "view", 0.0), (at(4), 1, "click", 0.0))
    assert run(spark, "zero_result_rate_daily", events=df) == [(date(2024, 1, 3), 2, 1, 9.995), (date(2024, 1, 4), 1, 1, 0.0)]


def test_counters_that_start_anew(spark):
    df = events(spark, *[(at(1, k), 7, "view", v) for k, v in enumerate((5.0, 9.0, 2.0, 2.0, 12.0))], (at(1), 8, "view", 100.0))
    assert run(spark, "counter_rate", events=df) == [(7, 0, 0.0), (7, 1, 4.0), (7, 2, 2.0), (7, 3, 0.0), (7, 4, 10.0), (8, 5, 0.0)]
    assert run(spark, "counter_rate_windows", events=df) == [(7, at(1), round(16 / 86400, 9)), (8, at(1), 0.0)]


def test_hours_without_errors_and_ratios(spark):
    df = events(spark, (at(1, 1, 5), 1, "error", 1.0), (at(1, 1, 9), 1, "view", 1.0), (at(1, 1, 10), 1, "view", 1.0), (at(1, 4), 1, "view", 1.0))
    assert run(spark, "window_absent", events=df) == [(at(1, 2),), (at(1, 3),), (at(1, 4),)]
    assert run(spark, "error_rate_ratio", events=df) == [(at(1, 1), 33.3333), (at(1, 4), 0.0)]
    assert run(spark, "window_count_1h", events=df) == [(at(1, 1), 3), (at(1, 4), 1)]


def test_ten_busiest_users_of_a_day(spark):
    df = events(spark, *[(at(1, k % 24), u, "view", 1.0) for u in range(12) for k in range(20 - u if u != 11 else 10)])
    got = run(spark, "window_topk", events=df)
    assert [r[1:] for r in sorted(got, key=lambda r: (-r[2], r[1]))] == [(u, 20 - u) for u in range(10)]


def test_sessions_do_not_multiply_their_costs(spark):
    chats = spark.createDataFrame([(1, 0, "user", "b"), (1, 1, "assistant", "zz"), (1, 2, "user", "a"), (2, 0, "user", None)], CHATS)
    df = events(spark, (at(1), 1, "view", 1.25), (at(1), 1, "view", 2.0), (at(1), 9, "view", 5.0))
    assert run(spark, "session_cost_rollup", conversations=chats, events=df) == [(1, 3, 3.25), (2, 1, 0.0)]
    # the join that multiplies, as the page it stands for has it: three messages by two records
    assert run(spark, "session_cost_fanout", conversations=chats, events=df) == [(1, 3, 9.75), (2, 1, 0.0)]
    assert run(spark, "last_user_message_lexical", conversations=chats) == [(1, "b"), (2, None)]


def test_history_fills_a_budget(spark):
    chats = spark.createDataFrame([(1, 0, "user", "x" * 1200), (1, 1, "user", "x" * 792), (1, 2, "user", "xxx"), (1, 3, "user", "x" * 9999), (2, 0, "user", "x" * 5000)], CHATS)
    assert run(spark, "budget_prefix_fill", conversations=chats) == [(1, 0, 300, 300), (1, 1, 198, 498), (1, 2, 1, 499), (2, 0, 300, 300)]


def test_conflicts_by_scope(spark):
    rows = [(1, 7), (2, 7), (3, 8), (5, 8), (10, 9), (4, 9)]  # keys that 5 divides hold everywhere
    orders = spark.createDataFrame([(k, c, "P", 1.0, at(1), "1") for k, c in rows] + [(6, 7, "F", 1.0, at(1), "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    assert dict(run(spark, "scope_conflicts", orders=orders)) == {1: 2, 2: 1, 3: 5, 5: 3, 10: 4, 4: 5}
    one = orders.where("o_orderkey = 1")
    assert run(spark, "scope_conflicts", orders=one) == []


def test_completeness_by_scope(spark):
    df = lines(spark, (1, 1, 3, 1, 40, 0.05, 0.06, "N"), (1, 1, 3, 2, 5, 0.05, 0.0, "A"), (1, 1, 4, 2, 40, 0.0, 0.06, "N"), (1, 1, 4, 3, 20, 0.05, 0.0, "A"))
    got = {(r[2], r[1]): r[3] for r in run(spark, "completeness_by_scope", lineitem=df)}
    assert got == {("industry_protocol", 1): 1.0, ("industry_protocol", 2): 0.63, ("unknown", 2): 0.6, ("unknown", 3): 0.7}


def test_usage_with_default_costs(spark):
    df = events(spark, (at(1), 1, "view", 20.0), (at(1), 1, "error", 20.0), (at(1), 1, "click", 20.9), (at(1), 1, "purchase", 20.0), (at(1), 1, "purchase", 4.0))
    got = [(r[1], r[2], r[3], r[4]) for r in run(spark, "usage_log_default_costs", events=df)]
    assert got == [
        ("mcp", "search_documentation", Decimal("0.00010000"), 27),
        ("mcp", "get_api_endpoint", Decimal("0.00010000"), 27),
        ("chat", "answer", Decimal("0.00002350"), 27),
        ("mcp", "list_products", Decimal("0E-8"), 27),
        ("mcp", "list_products", Decimal("0.50000000"), 11),
    ]
