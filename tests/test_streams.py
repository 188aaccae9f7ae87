"""Streams against plain replays, decimals and floats against Python's own, and small operators that had no test."""

from __future__ import annotations

import datetime
import decimal
import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlake.functions import formulas
from gridlake.functions import scalar as S
from gridlake.operators import retrieval
from gridlake.plans.control_queries import _job_events
from gridlake.plans.reference_queries import QUERIES
from gridlake.streaming import leases, state
from tests.conftest import SF

ZERO = datetime.datetime(2024, 1, 1)


def replay(events, lease, delay, most, end):
    """One job's events (second, kind, token), then the passing of time until end."""
    status, token, due, tries, out = None, None, None, 0, []

    def lost(at, why):
        nonlocal status, token, due, tries
        tries, token = tries + 1, None
        status, due = ("waiting", at + delay) if tries < most else ("failed", None)
        out.append((at, status, why, tries))

    for at, kind, who in [*sorted(events), (end, None, None)]:
        while due is not None and due <= at:
            if status == "running":
                lost(due, "stale")
            else:
                out.append((due, "pending", "delay_over", tries))
                status, due = "pending", None
        if kind is None or status in ("failed", "succeeded"):
            continue
        if kind == "enqueue":
            if status is None:
                status = "pending"
                out.append((at, "pending", "enqueued", tries))
        elif kind == "claim":
            if status == "pending":
                status, token, due = "running", who, at + lease
                out.append((at, "running", "claimed", tries))
            else:
                out.append((at, status or "unknown", "refused_claim", tries))
        elif status != "running" or who != token:
            out.append((at, status or "unknown", f"refused_{kind}", tries))
        elif kind == "heartbeat":
            due = at + lease
        elif kind == "fail":
            lost(at, "reported")
        else:
            status, token, due = "succeeded", None, None
            out.append((at, "succeeded", "done", tries))
    return out


def test_a_lease_stream_in_many_batches(spark, tmp_path):
    rng = random.Random(9)
    events = []
    for key in range(8):
        at = 0
        for _ in range(60):
            at += rng.choice([1, 2, 4, 60, 170, 181])
            events.append((key, at, rng.choice(["enqueue", "claim", "claim", "heartbeat", "heartbeat", "fail", "succeed"] if rng.random() < 0.9 else ["enqueue"]), rng.choice("ab")))
    events = [e for e in events if e[2] != "succeed" or e[0] % 2]
    end = max(e[1] for e in events) + 1
    events += [(50, k, kind, who) for k, (kind, who) in enumerate([("enqueue", None), ("claim", "a"), ("succeed", "b"), ("succeed", "a"), ("claim", "a")])]
    events.append((99, end, "enqueue", "a"))  # the latest event, which the watermark follows
    events.sort(key=lambda e: e[1])
    stamp = lambda s: ZERO + datetime.timedelta(seconds=s)
    schema = "key long, ts timestamp, kind string, token string"
    size = len(events) // 6 + 1
    for k in range(0, len(events), size):  # later files hold later events
        rows = [(key, stamp(s), kind, who) for key, s, kind, who in events[k : k + size]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["key"], r["ts"], r["state"], r["reason"], r["attempts"]) for r in state.drained(leases.lease_transitions(stream)).collect())
    want = []
    for key in {e[0] for e in events}:
        want += [(key, stamp(s), *rest) for s, *rest in replay([e[1:] for e in events if e[0] == key], leases.LEASE, leases.DELAY, leases.ATTEMPTS, end)]
    assert got == sorted(want)
    assert {"stale", "delay_over", "reported", "refused_claim", "refused_heartbeat", "done"} <= {w[3] for w in want} and "failed" in {w[2] for w in want}
    assert max(w[4] for w in want) == 3


def test_the_lease_query_over_its_whole_table(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = _job_events(events).collect()
    micros = lambda t: round((t - ZERO).total_seconds() * 1_000_000)
    end = max(micros(r["ts"]) for r in rows) // 1000 * 1000  # watermarks count milliseconds
    want = []
    for key in {r["key"] for r in rows}:
        own = [(micros(r["ts"]), r["kind"], r["token"]) for r in rows if r["key"] == key]
        want += [(key, *x) for x in replay(own, 6 * 3600 * 1_000_000, 3600 * 1_000_000, 3, max(end, max(o[0] for o in own)))]
    got = [(r["key"], micros(r["ts"]), r["state"], r["reason"], r["attempts"]) for r in QUERIES["lease_stream"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 300


def test_latest_states(spark):
    rows = spark.createDataFrame([(1, "a", ZERO), (1, "b", ZERO + datetime.timedelta(1)), (2, "a", ZERO)], "key long, state string, ts timestamp")
    assert {r["key"]: r["state"] for r in state.latest_states(rows).collect()} == {1: "b", 2: "a"}


def test_decimal_formulas_are_those_of_python(spark):
    rng = random.Random(11)
    number = lambda: str(decimal.Decimal(rng.randrange(-(10**rng.randrange(1, 22)), 10**rng.randrange(1, 22))).scaleb(-rng.randrange(0, 12)))
    rows = [(number(), number(), number()) for _ in range(300)] + [("1", "0", "3"), (None, "1", "1"), ("x", "1", "1"), ("NaN", "1", "1"), ("0", "0", "0"), ("1e30", "1", "7")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for text in ("a / b * 100", "(a - b) / (c + 0.1) - -a", "a * b * c / 3", "a / b / c + 1e-7"):
        for r in df.select("a", "b", "c", formulas.exact(text).alias("x")).collect():
            with decimal.localcontext(decimal.Context(prec=28, rounding=decimal.ROUND_HALF_EVEN)):
                try:
                    values = {k: decimal.Decimal(r[k]) for k in "abc"}
                    missing = not all(values[k].is_finite() for k in formulas.variables(text))
                except (TypeError, decimal.InvalidOperation):
                    missing = any(r[k] is None or r[k] == "x" for k in formulas.variables(text))
                if missing:
                    assert r["x"]["status"] == "missing"
                    continue
                try:
                    want = eval(text.replace("0.1", "decimal.Decimal('0.1')").replace("1e-7", "decimal.Decimal('1e-7')"), {"decimal": decimal}, values)
                except (ZeroDivisionError, decimal.InvalidOperation):
                    assert r["x"]["status"] == "not_meaningful" and r["x"]["value"] is None
                    continue
            assert (r["x"]["text"], r["x"]["status"]) == (str(want), "available")
            if abs(want) < 10**25:
                assert r["x"]["value"] == want.quantize(decimal.Decimal("1e-12"), context=decimal.Context(prec=60, rounding=decimal.ROUND_HALF_EVEN))


def test_exact_margins_over_the_whole_query(spark):
    rows = QUERIES["exact_margins"](spark, SF).collect()
    with decimal.localcontext(decimal.Context(prec=28, rounding=decimal.ROUND_HALF_EVEN)):
        for r in rows:
            assert r["operating_margin"] == str(r["given_operating_income"] / r["given_revenue"] * 100)
            assert r["net_margin"] == str(r["given_net_income"] / r["given_revenue"] * 100)
    assert len(rows) > 50


@pytest.mark.parametrize("text", ["round(a, 2)", "a // b", "a % b", "round(a)", "round(a / b, 1) - a // b", "max(a, b, 0.5) // 0.1", "-a // b"])
def test_answers_are_those_of_python_floats(spark, text):
    rng = random.Random(5)
    rows = [(2.675, 1.0), (1e20, 3.0), (0.5, 0.5), (1.5, -2.0), (2.5, 1e-3), (-7.0, 2.0), (7.0, -2.0), (-1e20, 7.0), (1e308, 1e-5), (5.0, 0.0), (9.995, 0.1), (-0.0, 3.0)]
    rows += [(rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 17), rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 6)) for _ in range(300)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", formulas.compiled(text, answers=True).alias("x")).collect()
    for r in got:
        try:
            want = float(eval(text, {}, {"a": r["a"], "b": r["b"]}))
        except (ZeroDivisionError, OverflowError, ValueError):
            want = None
        assert r["x"] == want or (want is not None and want != want), (r, want)


def test_batched_encoder(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id long, text string").repartition(3)
    out = rows.mapInArrow(retrieval.batched(lambda texts: [[float(len(t)), 1.0] for t in texts], 2), "id long, v array<float>")
    assert {r["id"]: list(r["v"]) for r in out.collect()} == {i: [float(len(f"text {i}")), 1.0] for i in range(30)}
    wrong = rows.mapInArrow(retrieval.batched(lambda texts: [[1.0]] * len(texts), 2), "id long, v array<float>")
    with pytest.raises(Exception, match="vectors must have 2 components"):
        wrong.collect()
    assert rows.limit(0).mapInArrow(retrieval.batched(lambda texts: [], 2), "id long, v array<float>").count() == 0
    assert pa.types.is_list(pa.list_(pa.float32()))


def test_name_uuids_over_the_whole_query(spark):
    got = {r["s_suppkey"]: r["id"] for r in QUERIES["name_uuids"](spark, SF).collect()}
    assert len(got) > 5 and got == {k: str(uuid.uuid5(uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), str(k))) for k in got}


def test_amounts(spark):
    cases = [(2.5e12, "2.5조원"), (1234e12, "1,234조원"), (3e8, "3억원"), (-1_250_000.0, "-1.3백만원"), (999.0, "999원"), (0.0, "0원"), (1999.96, "2천원")]
    df = spark.createDataFrame(cases, "v double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", S.krw_amount(F.col("v")).alias("got")).collect())
    rows = [(-1234.56, "USD", "millions", "-$1,234.6M", "-$1,235M"), (1000.0, "CHF", "ones", "CHF 1,000", "CHF 1,000"), (7.04, "JPY", "billions", "¥7B", "JPY 7B")]
    df = spark.createDataFrame(rows, "v double, c string, s string, a string, b string")
    got = df.select("a", "b", S.international_amount(F.col("v"), F.col("c"), F.col("s")).alias("x"), S.comparison_amount(F.col("v"), F.col("c"), F.col("s")).alias("y")).collect()
    assert all((r["x"], r["y"]) == (r["a"], r["b"]) for r in got)
    assert [r[0] for r in spark.createDataFrame([(1.26,), (-3.0,), (0.04,), (0.0,)], "v double").select(S.signed_percent(F.col("v"))).collect()] == ["+1.3%", "-3%", "0%", "0%"]
