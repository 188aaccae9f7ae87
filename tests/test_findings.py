"""What reviews of the queries found."""

import datetime
import random

import duckdb
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridlake.operators import cells, comparison, graph, keyword, nearest, retrieval
from gridlake.plans import workbook_queries
from gridlake.streaming import leases, state
from tests.test_streams import ZERO, replay


def test_scores_are_rounded_as_in_sql(spark):
    """Growth 0, margin 100, stability 99.55: 64.865 as a double lies below the half."""
    years = [(1, y, r, i) for y, r, i in ((2000, 200.0, 100.0), (2001, 100.0, 100.0))]
    series = spark.createDataFrame(years, "company_id long, fiscal_year int, revenue double, operating_income double")
    held = spark.createDataFrame([(1, 0.0, 1.0, 0.375)], "company_id long, liabilities double, assets double, net_debt double")
    got = comparison.candidates(series, held).first()
    assert (got["growth_score"], got["profitability_score"], got["stability_score"]) == (0.0, 100.0, 99.55)
    assert got["composite_score"] == duckdb.sql("SELECT round(0.0::DOUBLE * 0.35::DOUBLE + 100.0::DOUBLE * 0.35::DOUBLE + 99.55::DOUBLE * 0.3::DOUBLE, 2)").fetchall()[0][0] == 64.86
    assert comparison.ranked(comparison.candidates(series, held)).where(F.col("rank") == 1).count() == 1


def test_boxes_grow_through_many_strips(spark, monkeypatch):
    """A chain in which each box meets the next only once it has grown: as many steps as it has boxes, but few rounds."""
    n = 600
    rows = [("a", 0, 0, 0, 100, 1)] + [("a", 2 * k, 2 * k, 100 * (k % 2), 100 * (k % 2), 1) for k in range(1, n)] + [("b", 5, 5, 5, 5, 1)]
    boxes = spark.createDataFrame(rows, "sheet string, min_row int, max_row int, min_col int, max_col int, n_cells long")
    rounds = []
    plain = cells.connected
    monkeypatch.setattr(cells, "connected", lambda links: rounds.append(1) or plain(links))
    got = sorted(map(tuple, cells.merged_boxes(boxes, gap=1).collect()))
    assert got == [("a", 0, 2 * n - 2, 0, 100, n), ("b", 5, 5, 5, 5, 1)]
    assert len(rounds) <= 8


def test_listed_parents_are_not_broadcast(spark):
    h = spark.createDataFrame([("s", 1, 0, 0, 9), ("s", 2, 1, 2, 3), ("s", 3, 2, 2, 2)], "sheet string, header_id long, row int, lo int, hi int")
    out = cells.attached_parents(h)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["header_id"], r["parent_id"]) for r in out.collect()) == [(1, None), (2, 1), (3, 2)]


def test_all_evidence_that_ties(spark):
    """More cells tie at the best alias than any limit lets through."""
    rows = [(f"B{k:03}", "co", "s", f"B{k:03}", k, 1, ["revenue"], ["fy2020"]) for k in range(150)]
    c = spark.createDataFrame(rows, "cell_id string, company string, sheet string, coord string, row_index int, col_index int, row_tokens array<string>, column_tokens array<string>")
    wanted = spark.createDataFrame([("m", ["revenue"], [], ["fy2020"], "fy")], "metric_id string, aliases array<string>, excluded array<string>, period_terms array<string>, kind string")
    assert retrieval.exact_evidence(c, wanted, None).count() == 150


def test_region_membership_holds_folded_rows(spark, tmp_path):
    """Rows of cells are folded, so that a region holds cells of many parts."""
    spark.createDataFrame([(1, "b", 1), (131, "b", 2), (261, "b", 1)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, workbook_queries.region_membership(spark, str(tmp_path)).collect()))
    assert got == [("b", 1, 1, 2, 1), ("b", 1, 2, 2, 1)]


def test_even_bits_are_scanned(spark, monkeypatch):
    """Random bits: segments would meet most rows, so blocks are scanned; equal distances go by id over blocks."""
    monkeypatch.setattr(nearest, "BLOCK", (7, 50))
    monkeypatch.setattr(nearest, "HELD", 100)
    monkeypatch.setattr(nearest, "masks", lambda width, s: [0] * (1 << width))
    bits = [random.Random(k % 150).getrandbits(64) - (1 << 63) for k in range(200)]
    rows = spark.createDataFrame([(3 * k, [b]) for k, b in enumerate(bits)], "id long, bits array<long>")
    got = sorted((r["query_id"], r["distance"], r["doc_id"]) for r in nearest.hamming_nearest(rows.where("id < 60"), rows, 11, 64).collect())
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == sorted((3 * i, d, j) for i in range(20) for d, j in sorted((far(bits[i], b), 3 * k) for k, b in enumerate(bits))[:11])


def _streamed(spark, files, schema, operator, folder):
    """What operator puts out of a stream of files, a batch each, and the rows of state that it kept."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return sorted(map(str, spark.read.schema(out.schema).parquet(f"{folder}/out").collect())), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_keys_share_calls_of_a_stream_of_states(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(state, "BUCKETS", 2, raising=False)
    rng, schema = random.Random(4), "key long, state string, ts timestamp"
    keys = [None, 2**60 + 1, 2**60 + 2, *range(30)]
    rows = [(rng.choice(keys), rng.choice(["a", "b", "c", None, "end"] if k > 200 else ["a", "b", None]), ZERO + datetime.timedelta(seconds=k)) for k in range(600)]
    got, kept = _streamed(spark, [rows[:200], rows[200:400], rows[400:]], schema, lambda x: state.state_changes(x, ("end",)), tmp_path)
    want = state.state_changes_batch(spark.createDataFrame(rows, schema), ("end",)).select("key", "state", "ts")
    assert got == sorted(map(str, want.collect())) and kept <= 3


def test_jobs_share_calls_of_a_lease_stream(spark, monkeypatch, tmp_path):
    """A bucket's timer is the earliest of its jobs'; a lease that ends with the stream itself is stale in any bucket."""
    monkeypatch.setattr(state, "BUCKETS", 2, raising=False)
    rng, end = random.Random(8), 2000
    events = [(key, at, kind, "a") for key in range(30) for at, kind in ((key, "enqueue"), (40 + key, "claim"))]
    events += [(key, at, rng.choice(["heartbeat", "fail", "claim", "succeed"]), rng.choice("ab")) for key in range(15) for at in sorted(rng.sample(range(100, 1500), 8))]
    events += [(70, 1700, "enqueue", None), (70, end - leases.LEASE, "claim", "a"), (71, end, "enqueue", "a")]
    files = [[e for e in events if lo <= e[1] < lo + 400] for lo in range(0, end + 1, 400)]
    rows = [[(key, ZERO + datetime.timedelta(seconds=at), kind, who) for key, at, kind, who in f] for f in files]
    got, kept = _streamed(spark, rows, "key long, ts timestamp, kind string, token string", leases.lease_transitions, tmp_path)
    want = []
    for key in {e[0] for e in events}:
        done = replay([e[1:] for e in events if e[0] == key], leases.LEASE, leases.DELAY, leases.ATTEMPTS, end)
        want += [Row(key=key, ts=ZERO + datetime.timedelta(seconds=at), state=s, reason=why, attempts=n) for at, s, why, n in done]
    assert got == sorted(map(str, want)) and kept <= 2


def test_few_words_of_a_batch_are_sorted_at_once(monkeypatch):
    """Texts of a batch may be long: postings come of a few at a time, a text that is longer by itself."""
    monkeypatch.setattr(keyword, "AT_ONCE", 10, raising=False)
    rng = random.Random(6)
    texts = [None, [], *([rng.choice("abcde") for _ in range(rng.choice([0, 1, 3, 7, 25]))] for _ in range(80)), None]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "words"])
    got = [b.to_pylist() for b in keyword._by_word(iter([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)]))]
    want = {(w, i, len(t), tuple(k + 1 for k, x in enumerate(t) if x == w)) for i, t in enumerate(texts) if t for w in t}
    rows = [(r["word"], r["doc_id"], r["length"], tuple(r["places"])) for b in got for r in b]
    assert sorted(rows) == sorted(want)
    assert max(sum(len(r["places"]) for r in b) for b in got if len({r["doc_id"] for r in b}) > 1) <= 10


def test_rounds_over_graphs_send_the_driver_no_tables(spark, monkeypatch):
    """Of a loop's joins only those with a short frontier are broadcast, and here none counts as short."""
    monkeypatch.setattr(graph, "SHORT_LIST", 0, raising=False)
    plans, plain, add = [], graph.cut, graph.Levels.add
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(graph, "cut", lambda df: plain(seen(df)))
    monkeypatch.setattr(graph.Levels, "add", lambda self, rows: add(self, seen(rows)))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "source long, target long")
    out = seen(graph.cycles(edges.select(F.col("source").alias("node")), edges))
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
