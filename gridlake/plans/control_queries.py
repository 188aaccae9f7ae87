"""Queries over grids, graphs, evaluations, logs, state streams and catalogs, and what the platform adds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cells as X
from ..operators import evaluation as E
from ..operators import graph as G
from ..sources import snapshots
from ..streaming import leases, state
from .base import query, table


def _grid(spark, sf_dir):
    """A sheet for each event type; users as rows, stretches of ten minutes of the day as columns."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("sheet"), F.col("user_id").cast("int").alias("row"), F.floor((F.hour("ts") * 60 + F.minute("ts")) / 10).cast("int").alias("col")).distinct()


_GRID = "g AS (SELECT DISTINCT event_type AS sheet, user_id::INT AS row, ((hour(ts) * 60 + minute(ts)) // 10)::INT AS col FROM events)"
_COMPONENTS = f"""{_GRID}, n AS (SELECT *, row::BIGINT * 1000 + col AS id FROM g),
    e AS (SELECT a.sheet, a.id AS x, b.id AS y FROM n a JOIN n b ON a.sheet = b.sheet AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    r(sheet, id, root) AS (SELECT sheet, id, id FROM n UNION SELECT e.sheet, e.y, r.root FROM r JOIN e ON e.sheet = r.sheet AND e.x = r.id WHERE r.root < e.y),
    c AS (SELECT sheet, id, min(root) AS root FROM r GROUP BY ALL)"""


@query(f"""
    WITH RECURSIVE {_COMPONENTS}
    SELECT sheet, (id // 1000)::INT AS row, (id % 1000)::INT AS col, dense_rank() OVER (PARTITION BY sheet ORDER BY root)::INT AS component FROM c
""")
def grid_components(spark, sf_dir):
    """C14, U1."""
    return X.connected_cells(_grid(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {_COMPONENTS}
    SELECT sheet, dense_rank() OVER (PARTITION BY sheet ORDER BY root)::INT AS component, min(id // 1000)::INT AS min_row, max(id // 1000)::INT AS max_row, min(id % 1000)::INT AS min_col, max(id % 1000)::INT AS max_col, count(*) AS n_cells FROM c GROUP BY sheet, root
""")
def grid_bounds(spark, sf_dir):
    """A15, C14."""
    return X.bounds(X.connected_cells(_grid(spark, sf_dir))).select("sheet", "component", "min_row", "max_row", "min_col", "max_col", "n_cells")


#: Steps in which every box takes the envelope of all that it touches, more than these tables need to come to rest.
_STEPS = 32


@query(f"""
    WITH RECURSIVE {_COMPONENTS},
    b AS (SELECT sheet, root, min(id // 1000) AS r0, max(id // 1000) AS r1, min(id % 1000) AS c0, max(id % 1000) AS c1, count(*) AS n FROM c GROUP BY sheet, root),
    s(step, sheet, root, r0, r1, c0, c1) AS (
        SELECT 0, sheet, root, r0, r1, c0, c1 FROM b UNION ALL
        SELECT x.step + 1, x.sheet, x.root, min(y.r0), max(y.r1), min(y.c0), max(y.c1) FROM s x JOIN s y
        ON y.sheet = x.sheet AND y.r0 <= x.r1 + 1 AND x.r0 <= y.r1 + 1 AND y.c0 <= x.c1 + 1 AND x.c0 <= y.c1 + 1 WHERE x.step < {_STEPS} GROUP BY x.step, x.sheet, x.root)
    SELECT sheet, s.r0::INT AS min_row, s.r1::INT AS max_row, s.c0::INT AS min_col, s.c1::INT AS max_col, sum(n)::BIGINT AS n_cells FROM s JOIN b USING (sheet, root) WHERE step = {_STEPS} GROUP BY sheet, s.r0, s.r1, s.c0, s.c1 HAVING sum(n) >= 2
""")
def grid_tables(spark, sf_dir):
    """Boxes merged to a fixpoint."""
    return X.merged_boxes(X.bounds(X.connected_cells(_grid(spark, sf_dir))), gap=0, min_cells=2)


@query("""
    WITH h AS (SELECT p_brand || '-' || (p_partkey // 500) AS sheet, p_partkey AS header_id, (p_size % 7)::INT AS row, (p_partkey % 50)::INT AS lo, (p_partkey % 50 + 20 - 3 * (p_size % 7))::INT AS hi FROM part),
    p AS (SELECT h.sheet, h.header_id, u.header_id AS parent_id, row_number() OVER (PARTITION BY h.sheet, h.header_id ORDER BY u.row DESC, u.hi - u.lo, u.header_id) AS n FROM h JOIN h u ON u.sheet = h.sheet AND u.row < h.row AND u.lo <= h.lo AND u.hi >= h.hi)
    SELECT h.sheet, h.header_id, parent_id FROM h LEFT JOIN p ON p.sheet = h.sheet AND p.header_id = h.header_id AND n = 1
""")
def header_parent_containment(spark, sf_dir):
    """Spans made from part keys and sizes; a sheet for each brand and 500 keys."""
    row = F.col("p_size") % 7
    lo = (F.col("p_partkey") % 50).cast("int")
    sheet = F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 500).cast("string"))
    h = table(spark, sf_dir, "part").select(sheet.alias("sheet"), F.col("p_partkey").alias("header_id"), row.alias("row"), lo.alias("lo"), (lo + 20 - 3 * row).alias("hi"))
    return X.attached_parents(h).select("sheet", "header_id", "parent_id")


@query("""
    WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS k FROM c QUALIFY k = 1)
    SELECT lang, CASE WHEN count(*) = 1 THEN max(source) END AS majority, max(n) AS n FROM r GROUP BY lang
""")
def unambiguous_majority(spark, sf_dir):
    """A9."""
    return X.unambiguous_majority(table(spark, sf_dir, "documents"), "lang", "source")


ROLES = {"income": ("the", "and"), "balance": ("der", "und"), "cash": ("src1", "que")}


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN lower(source) LIKE '%the%' THEN 4 WHEN lower(text) LIKE '%the%' THEN 1 ELSE 0 END + CASE WHEN lower(source) LIKE '%and%' THEN 4 WHEN lower(text) LIKE '%and%' THEN 1 ELSE 0 END AS a,
        CASE WHEN lower(source) LIKE '%der%' THEN 4 WHEN lower(text) LIKE '%der%' THEN 1 ELSE 0 END + CASE WHEN lower(source) LIKE '%und%' THEN 4 WHEN lower(text) LIKE '%und%' THEN 1 ELSE 0 END AS b,
        CASE WHEN lower(source) LIKE '%src1%' THEN 4 WHEN lower(text) LIKE '%src1%' THEN 1 ELSE 0 END + CASE WHEN lower(source) LIKE '%que%' THEN 4 WHEN lower(text) LIKE '%que%' THEN 1 ELSE 0 END AS c FROM documents)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a >= b AND a >= c THEN 'income' WHEN b >= c THEN 'balance' ELSE 'cash' END AS role, greatest(a, b, c)::INT AS score, least(0.98, 0.55 + 0.1 * greatest(a, b, c))::DOUBLE AS confidence FROM s
""")
def role_scoring(spark, sf_dir):
    """A16."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return X.role_scores(d, ROLES, "source", "text").select("doc_id", "role", "score", "confidence")


def _edges(spark, sf_dir):
    """Each part's key leads to its double and its triple."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source")).select("source", F.explode(F.array(F.col("source") * 2, F.col("source") * 3)).alias("target"))
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return nodes, e


_EDGES = "d AS (SELECT p_partkey AS source, unnest([p_partkey * 2, p_partkey * 3]) AS target FROM part)"


@query(f"""
    WITH RECURSIVE {_EDGES}, n AS (SELECT source AS node FROM d UNION SELECT target FROM d),
    r(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT target FROM d) UNION SELECT d.target, r.level + 1 FROM r JOIN d ON d.source = r.node)
    SELECT node, max(level)::INT AS level FROM n LEFT JOIN r USING (node) GROUP BY node
""")
def topological_levels(spark, sf_dir):
    """G2, on a graph made from part keys (each key leads to its double and its triple)."""
    return G.generations(*_edges(spark, sf_dir))


_RING = "d AS (SELECT p_partkey AS source, CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 9 ELSE p_partkey + 1 END AS target FROM part WHERE p_partkey % 10 <> 4 OR p_partkey % 30 = 4 UNION ALL SELECT p_partkey, p_partkey + 7 FROM part WHERE p_partkey % 100 < 10 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 97 = 0)"


@query(f"""
    WITH RECURSIVE {_RING}, r(a, b) AS (SELECT source, target FROM d UNION SELECT r.a, d.target FROM r JOIN d ON d.source = r.b),
    s AS (SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
    SELECT node, cycle FROM s
""")
def graph_cycles(spark, sf_dir):
    """G1: cycles among parts: rings of ten keys, some of them open, with steps of seven between some, and a few keys on
    their own."""
    p, k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source")), F.col("source")
    ring = p.where((k % 10 != 4) | (k % 30 == 4)).withColumn("target", F.when(k % 10 == 9, k - 9).otherwise(k + 1))
    edges = ring.unionByName(p.where(k % 100 < 10).withColumn("target", k + 7)).unionByName(p.where(k % 97 == 0).withColumn("target", k))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    return G.cycles(nodes, edges)


@query("""
    WITH e AS (SELECT l_orderkey * 8 + l_linenumber % 4 AS edge_id, l_suppkey AS source, l_partkey % 100 + 1 AS target, 'o' || l_linenumber % 3 AS output, 'i' || l_linenumber % 5 AS input, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS branch FROM lineitem),
    g AS (SELECT target, input, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT branch) AS b FROM e GROUP BY ALL)
    SELECT 'duplicate_edge' AS problem, edge_id::VARCHAR AS item FROM e GROUP BY edge_id HAVING count(*) > 1 UNION ALL SELECT 'self_edge', edge_id::VARCHAR FROM e WHERE source = target
    UNION ALL SELECT 'unknown_output', edge_id::VARCHAR FROM e WHERE output = 'o2' OR source NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'unknown_input', edge_id::VARCHAR FROM e WHERE input = 'i4' OR target NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'input_conflict', target || ':' || input FROM g WHERE n > 1 AND (s > 1 OR b < n)
""")
def graph_edge_problems(spark, sf_dir):
    """G1: line items as edges between suppliers: repeated ids, loops, ports that are not there, inputs that conflict."""
    c = F.col
    edges = table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber") % 4).alias("edge_id"), c("l_suppkey").alias("source"), (c("l_partkey") % 100 + 1).alias("target"), F.concat(F.lit("o"), (c("l_linenumber") % 3).cast("string")).alias("output"),
        F.concat(F.lit("i"), (c("l_linenumber") % 5).cast("string")).alias("input"), F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("branch"),
    )
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("node"))
    ports = s.select("node", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.lit(port).alias("port")) for side, port in [("out", "o0"), ("out", "o1"), ("in", "i0"), ("in", "i1"), ("in", "i2"), ("in", "i3")]))).alias("p")).select("node", "p.*")
    return G.edge_problems(edges, ports)


@query(f"""
    WITH RECURSIVE {_EDGES}, r(node) AS (SELECT 3::BIGINT UNION SELECT d.target FROM r JOIN d ON d.source = r.node WHERE d.target % 5 <> 0)
    SELECT node FROM r
""")
def resume_closure(spark, sf_dir):
    """What follows node 3; keys divisible by 5 count as succeeded."""
    nodes, e = _edges(spark, sf_dir)
    return G.descendants(nodes.where("node = 3"), e, nodes.where("node % 5 = 0"))


@query(f"""
    WITH {_EDGES}, n AS (SELECT source AS node FROM d UNION SELECT target FROM d)
    SELECT node, coalesce(array_to_string(list_sort(list(DISTINCT source)), ','), '') AS upstream FROM n LEFT JOIN d ON target = node GROUP BY node
""")
def task_plan(spark, sf_dir):
    """G6."""
    return G.task_plan(*_edges(spark, sf_dir)).select("node", F.array_join(F.col("upstream").cast("array<string>"), ",").alias("upstream"))


@query("""
    WITH l AS (SELECT user_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'skipped' ELSE 'succeeded' END AS status FROM events)
    SELECT run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status IN ('succeeded', 'skipped')) THEN 'succeeded' ELSE 'pending' END AS status, count(*) AS n_nodes FROM l GROUP BY run_id
""")
def dag_status_reduce(spark, sf_dir):
    """Event types as node states."""
    t = F.col("event_type")
    status = F.when(t == "error", "failed").when(t == "click", "running").when(t == "purchase", "skipped").otherwise("succeeded")
    return G.reduced_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), status.alias("status")))


@query("""
    SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS quality_rate, round(avg(CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END END), 4)::DOUBLE AS toxic_rate
    FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def benchmark_summary(spark, sf_dir):
    """A7, A6."""
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.summary(r, "lang", {"quality_rate": (F.col("quality") == 1, None), "toxic_rate": (F.col("toxic") == 1, F.col("quality") == 1)})


@query("""
    WITH s AS (SELECT conv_id, list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user')), '[^a-z]+'), lambda x: len(x) > 6) AS gold,
                      list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role <> 'user')), '[^a-z]+'), lambda x: len(x) > 6) AS found FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN len(found) > 0 THEN len(list_intersect(list_distinct(found), list_distinct(gold)))::DOUBLE / len(list_distinct(found)) END AS precision,
           CASE WHEN len(gold) > 0 THEN len(list_intersect(list_distinct(found), list_distinct(gold)))::DOUBLE / len(list_distinct(gold)) END AS recall FROM s WHERE gold IS NOT NULL AND found IS NOT NULL
""")
def route_precision_recall(spark, sf_dir):
    """Long words of a conversation's answers against those of its questions."""
    c = table(spark, sf_dir, "conversations")
    said = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    s = c.groupBy("conv_id").agg(said(F.col("role") == "user").alias("g"), said(F.col("role") != "user").alias("f"), F.bool_or(F.col("role") == "user").alias("a"), F.bool_or(F.col("role") != "user").alias("b")).where("a AND b")
    words = lambda x: F.filter(F.split(F.lower(x), "[^a-z]+", -1), lambda w: F.length(w) > 6)
    s = s.select("conv_id", words(F.col("g")).alias("gold"), words(F.col("f")).alias("found"))
    pr = E.precision_recall(F.col("found"), F.col("gold"))
    return s.select("conv_id", pr["precision"].alias("precision"), pr["recall"].alias("recall"))


@query("""
    WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?'), lambda x: CASE WHEN starts_with(x, '(') AND ends_with(x, ')') THEN -abs(regexp_replace(x, '[(),]', '', 'g')::DOUBLE) ELSE regexp_replace(x, '[(),]', '', 'g')::DOUBLE END) AS v FROM conversations)
    SELECT conv_id, turn, len(v)::INT AS n_numbers, len(list_filter(v, lambda a: abs(a - 100) <= 0.5)) > 0 AS states_hundred FROM t
""")
def answer_number_match(spark, sf_dir):
    """F28, F29."""
    c = table(spark, sf_dir, "conversations").withColumn("v", S.numbers_in(F.col("text")))
    return c.select("conv_id", "turn", F.size("v").alias("n_numbers"), F.exists("v", lambda a: S.number_matches(a, F.lit(100.0))).alias("states_hundred"))


@query("""
    WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS lease FROM o)
    SELECT user_id, lease::BIGINT AS lease, min(ts) AS claimed_at, max(ts) AS last_beat, count(*) AS beats FROM s GROUP BY ALL
""")
def stale_lease_sessions(spark, sf_dir):
    """Six hours without a heartbeat end a lease."""
    return state.lease_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)


@query("""
    SELECT user_id, last_beat, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_beat)) / 1000000 AS age, greatest(0, 86400 - (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_beat)) / 1000000) AS left, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_beat)) / 1000000 > 86400 AS stale
    FROM (SELECT user_id, max(ts) AS last_beat FROM events GROUP BY user_id)
""")
def lease_ages(spark, sf_dir):
    """Age, time left and staleness of each user's lease of a day, at the end of January."""
    beats = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_beat"))
    return state.lease_age(beats, "last_beat", "2024-01-31 00:00:00", 86_400)


@query("""
    SELECT c_custkey AS owner, o_orderkey AS run, run_at FROM (SELECT c_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS run_at FROM customer JOIN orders ON o_custkey = c_custkey)
    QUALIFY row_number() OVER (PARTITION BY owner ORDER BY run_at DESC NULLS LAST, run DESC) = 1
""")
def latest_runs(spark, sf_dir):
    """K9: each customer's latest order; open ones have no date yet and come last."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("run_at"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    return snapshots.latest(o.join(c, "owner"), ["owner"], ["run_at", "run"]).select("owner", "run", "run_at")


def _job_events(events):
    """Events as those of a user's job of a day: purchases enqueue, signups claim, views renew, errors fail, clicks end."""
    kind = F.when(F.col("event_type") == "purchase", "enqueue").when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "error", "fail").otherwise("succeed")
    key = F.col("user_id") * 100 + F.dayofmonth("ts")
    return events.select(key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("token"))


@query()
def lease_stream(spark, sf_dir):
    """Events as those of jobs under leases of six hours, tried again after an hour, as a stream with timers;
    a test replays the whole table event by event."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    out = leases.lease_transitions(_job_events(rows), leases.Rules(lease=6 * 3600, delay=3600))
    return state.drained(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    SELECT user_id, event_id, attempt, attempt < 3 AS requeued FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS attempt FROM events WHERE event_type = 'error')
""")
def bounded_retry(spark, sf_dir):
    """T4: errors as failures of a user's job."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return state.attempts(e, "user_id", "at", F.col("event_type") == "error").select("user_id", "event_id", "attempt", "requeued")


@query("""
    SELECT event_type AS scope, arg_max(event_id, (ts, event_id)) AS head, max(ts) AS head_at FROM events GROUP BY event_type
""")
def head_pointer_latest(spark, sf_dir):
    """T6, S13, A4, J6."""
    return snapshots.heads(table(spark, sf_dir, "events").withColumnRenamed("event_type", "scope"), "scope", "ts", "event_id")


@query("""
    SELECT user_id AS key, event_type AS state, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM events) WHERE b IS DISTINCT FROM event_type
""")
def state_changes_batch(spark, sf_dir):
    """T1 over a finished table."""
    return state.state_changes_batch(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), "ts"))


@query("""
    WITH e AS (SELECT user_id * 100 + day(ts) AS key, event_type AS state, ts FROM events)
    SELECT key, state, ts FROM (SELECT *, lag(state) OVER w AS b, coalesce(max((state = 'purchase')::INT) OVER (PARTITION BY key ORDER BY ts, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, state)) WHERE b IS DISTINCT FROM state AND ended = 0
""")
def state_stream_to_the_end(spark, sf_dir):
    """Changes of each user's days as a stream, up to the first purchase, which is terminal."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("key"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    return state.drained(state.state_changes(rows, ("purchase",))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    SELECT user_id AS key, event_type AS state, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM events) WHERE b IS DISTINCT FROM event_type
""")
def state_change_stream(spark, sf_dir):
    """T1 as a stream: the events table as a file source, read until it is used up, into a table of changes."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    return state.drained(state.state_changes(rows)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    SELECT user_id, array_to_string((list(event_id ORDER BY ts, event_id))[-80:], ',') AS last_ids FROM events GROUP BY user_id
""")
def last_80_log_entries(spark, sf_dir):
    """A5: the last 80 entries of each log, each reduced to 80 rows by a window before they are gathered."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 80")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    return e.groupBy("user_id").agg(F.array_join(ids, ",").alias("last_ids"))


@query("""
    SELECT r_name AS name, count(n_nationkey) AS n, coalesce(array_to_string(list(n_name ORDER BY n_nationkey) FILTER (WHERE n_name IS NOT NULL), ','), '') AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
""")
def collection_catalog(spark, sf_dir):
    """S7, S8, S9, J2, J3."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",").alias("members"))
    return table(spark, sf_dir, "region").join(n, "r_regionkey", "left").select(F.col("r_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("members", F.lit("")).alias("members"))


@query("""
    SELECT role, count(*) AS n, round(sum(((length(text) - (CASE WHEN turn > 0 THEN length(text) // 2 ELSE 0 END)) * 2.0 + (CASE WHEN turn > 0 THEN length(text) // 2 ELSE 0 END) * 0.5 + 100 * 8.0)::DECIMAL(18,2))::DOUBLE / 1000000, 6) AS cost FROM conversations GROUP BY role
""")
def token_cost(spark, sf_dir):
    """Characters as tokens; half of the input is cached after the first turn."""
    n = F.char_length("text")
    cached = F.when(F.col("turn") > 0, F.floor(n / 2)).otherwise(0)
    cost = S.token_cost(n, cached, F.lit(100), 2.0, 0.5, 8.0)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.sum((cost * 1_000_000).cast("decimal(18,2)")).cast("double") / 1_000_000, 6).alias("cost"))


@query("""
    SELECT 'company-' || substr(sha256(s_suppkey || '|' || s_name), 1, 24) AS company_id, s_suppkey, (('0x' || substr(sha256(s_name), 1, 8))::BIGINT % 12)::BIGINT AS mark FROM supplier
""")
def hash_identifiers(spark, sf_dir):
    """F32, F39."""
    s = table(spark, sf_dir, "supplier")
    return s.select(S.short_id("company", F.col("s_suppkey").cast("string"), F.col("s_name")).alias("company_id"), "s_suppkey", S.hash_bucket(F.col("s_name"), 12).alias("mark"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderstatus AS before FROM orders), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT o_orderkey, CASE WHEN after IS NULL THEN 'delete' WHEN before IS NULL THEN 'insert' ELSE 'update' END AS operation FROM o FULL JOIN n USING (o_orderkey) WHERE before IS DISTINCT FROM after
""")
def audit_changes(spark, sf_dir):
    """Orders before and after some are deleted and some changed."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")))
    return snapshots.audit(old, new, ["o_orderkey"]).select("o_orderkey", "operation")


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def platform_cube(spark, sf_dir):
    """Platform, not reference: cube."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.count("*").alias("n"))


@query("""
    (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0
""")
def platform_setops(spark, sf_dir):
    """Platform, U2, U3: intersect and except."""
    o = table(spark, sf_dir, "orders")
    keys = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return keys("F").intersect(keys("O")).subtract(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("""
    WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
    SELECT event_id, v.user_id, (SELECT arg_max(value, ts) FROM p WHERE p.user_id = v.user_id AND p.ts <= v.ts) AS last_value FROM v
""")
def platform_asof(spark, sf_dir):
    """Platform, J15: the last purchase at or before each click, by a window over both."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    own = F.when(F.col("event_type") == "purchase", F.col("value"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("last_value", F.last(own, ignorenulls=True).over(w)).where("event_type = 'click'").select("event_id", "user_id", "last_value")
