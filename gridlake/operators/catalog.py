"""Catalogs of companies, sources, questions and answers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalar as S
from ..functions.formulas import derived
from ..session import cut, short_list
from .graph import Levels
from .metrics import derive


def company_tokens(name: Column) -> Column:
    """Lower-case words of a company's name without its legal form."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([0-9a-z가-힣]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*C.LEGAL_FORMS))


def company_key(name: Column) -> Column:
    return F.array_join(company_tokens(name), "")


def company_acronym(name: Column) -> Column:
    return F.array_join(F.transform(company_tokens(name), lambda w: F.substring(w, 1, 1)), "")


def prefixes(key: Column, least: int = 1) -> Column:
    """All prefixes of least characters or more, the key itself included."""
    n = F.length(key)
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda i: F.substring(key, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def alias_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_name, right_name) of names where one key begins the other, or one key is the other's acronym.

    Names are joined by equal keys only: each side lists its prefixes, whose number the length of a name bounds.
    """

    def side(df: DataFrame, which: str) -> DataFrame:
        name = F.col(f"{which}_name")
        return df.select(name).distinct().select(name, company_key(name).alias("key"), company_acronym(name).alias("acronym")).where("key <> ''")

    a, b = side(left, "left"), side(right, "right")
    longer = lambda df, which: df.select(f"{which}_name", F.explode(prefixes(F.col("key"))).alias("key"))
    short = lambda df, which, c="key": df.select(f"{which}_name", F.col(c).alias("key"))
    found = [
        longer(a, "left").join(short(b, "right"), "key"),
        short(a, "left").join(longer(b, "right"), "key"),
        short(a, "left").join(short(b, "right", "acronym"), "key"),
        short(a, "left", "acronym").join(short(b, "right"), "key"),
    ]
    out = None
    for part in found:
        part = part.select("left_name", "right_name")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def resolved_scopes(requests: DataFrame, scopes: DataFrame, least: int = 4) -> DataFrame:
    """(request, index_id) of a catalog (index_id, company_name, ticker).

    A request that equals a company's name, its name before a bracket, or its ticker takes those indexes; else the ones
    whose alias begins the request or begins with it, both of least characters or more, if all belong to one company.
    """
    base = F.trim(F.split_part("company_name", F.lit("("), F.lit(1)))
    alias = scopes.select("index_id", S.normalize_token(F.col("company_name")).alias("company"), F.explode(F.array("company_name", base, F.coalesce("ticker", F.lit("")))).alias("alias"))
    alias = alias.select("index_id", "company", S.normalize_token(F.col("alias")).alias("key")).where("key <> ''").distinct()
    asked = requests.select("request").distinct().withColumn("key", S.normalize_token(F.col("request"))).where("key <> ''")
    exact = asked.join(alias, "key").select("request", "index_id").distinct()
    left = asked.join(exact.select("request").distinct(), "request", "left_anti")
    longer = lambda df: df.withColumn("key", F.explode(prefixes(F.col("key"), least)))
    near = left.join(longer(alias), "key").unionByName(longer(left).join(alias.where(F.length("key") >= least), "key"))
    near = near.where(F.length("key") >= least).select("request", "index_id", "company").distinct()
    one = near.groupBy("request").agg(F.count_distinct("company").alias("n")).where("n = 1").select("request")
    return exact.unionByName(near.join(one, "request", "left_semi").select("request", "index_id").distinct())


def repaired_routes(routes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(subquery, index_id, status) of planned routes: known ids stay, an unknown one is set right if there is one scope.

    A subquery of known and unknown ids is "mixed", one of unknown ids among several scopes "unknown".
    """
    known = scopes.select("index_id").distinct()
    only = known.agg(F.when(F.count("*") == 1, F.min("index_id")).alias("only"))
    checked = routes.join(known.withColumn("known", F.lit(True)), "index_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    w = Window.partitionBy("subquery")
    checked = checked.withColumns({"any": F.bool_or("known").over(w), "all": F.bool_and("known").over(w)}).join(F.broadcast(only))
    status = F.when(F.col("all"), "valid").when(F.col("any"), "mixed").when(F.col("only").isNotNull(), "repaired").otherwise("unknown")
    return checked.select("subquery", F.when(status == "repaired", F.col("only")).otherwise(F.col("index_id")).alias("index_id"), status.alias("status")).distinct()


def question_plan(companies: DataFrame, periods: DataFrame, metrics: DataFrame, job: str, version: str = "1") -> DataFrame:
    """A queued question for each source metric and period of each company; derived metrics get none.

    companies: company_id, workbook_hash, index_id; periods: company_id, kind, period_id, label; metrics:
    metric_id, label_en, template with {metric} and {period}, derived.
    """
    pid = F.when(F.startswith("period_id", F.concat("kind", F.lit("-"))), F.col("period_id")).otherwise(F.concat_ws("-", "kind", "period_id"))
    asked = companies.join(periods, "company_id").withColumn("period_id", pid).crossJoin(short_list(metrics.where("NOT derived")))
    identity = F.concat_ws("\x00", F.lit(job), F.col("company_id").cast("string"), "workbook_hash", "index_id", "metric_id", "period_id", F.lit(version))
    text = F.replace(F.replace("template", F.lit("{period}"), F.col("label")), F.lit("{metric}"), F.col("label_en"))
    return asked.select(F.concat(F.lit("question-"), F.substring(F.sha2(identity, 256), 1, 24)).alias("question_id"), "company_id", "metric_id", "period_id", text.alias("question_text"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"))


def answers_or_missing(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question with its latest completed answer; without one the value is null and missing.

    answers: question_id, status, value, answered_at, answer_id.
    """
    latest = answers.where("status = 'completed'").groupBy("question_id").agg(F.max_by("value", F.struct("answered_at", "answer_id")).alias("value"))
    out = questions.join(latest, "question_id", "left")
    return out.withColumn("status", F.when(F.col("value").isNull(), C.MISSING).otherwise(C.AVAILABLE))


def company_index(sources: DataFrame, removed: DataFrame, key: str = "company_id") -> DataFrame:
    """The newest source of each company, preferred ones first; removed companies are left out."""
    best = F.max_by(F.struct("source_id", "created_at"), F.struct(F.col("preferred").cast("int"), "created_at", "source_id"))
    out = sources.join(removed.select(key).distinct(), key, "left_anti").groupBy(key).agg(best.alias("s"), F.count("*").alias("n_sources"))
    return out.select(key, F.col("s.source_id").alias("source_id"), F.col("s.created_at").alias("created_at"), "n_sources")


def materialization_candidates(entries: DataFrame, snapshots: DataFrame, jobs: DataFrame, key: str = "company_id") -> DataFrame:
    """Companies whose snapshot is absent or of another workbook, with the reason.

    entries and snapshots: key, workbook_hash; jobs: key, workbook_hash, status, of which each company has its latest.
    A job on the present workbook hides the company unless it failed.
    """
    s = snapshots.select(key, F.col("workbook_hash").alias("built"))
    j = jobs.select(key, F.col("workbook_hash").alias("tried"), "status")
    both = entries.where("workbook_hash IS NOT NULL").join(s, key, "left").join(j, key, "left")
    here = F.coalesce(F.col("tried") == F.col("workbook_hash"), F.lit(False))
    reason = F.when(here & (F.col("status") == "failed"), "failed").when(here, None).when(F.col("built").isNotNull(), "source_changed").otherwise("not_created")
    out = both.where("built IS NULL OR built <> workbook_hash").withColumn("reason", reason)
    return out.where("reason IS NOT NULL").select(key, "reason")


def capped_companies(companies: DataFrame, most: int = 30) -> DataFrame:
    """K5: the first companies by lower-case name, then id: the league's stated size."""
    return companies.orderBy(F.lower("display_name"), "company_id").limit(most)


def claim_order(queue: DataFrame, worker: str, most: int) -> DataFrame:
    """K8: the next entries for a worker: its own first, then by priority, then the oldest."""
    return queue.orderBy(F.when(F.col("preferred_worker") == worker, 0).otherwise(1), F.desc("priority"), "created_at", "id").limit(most)


def resolved_evidence(asked: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Each asked reference with the number of indexes that hold it; found, ambiguous or missing."""
    hits = cells.groupBy(*on).agg(F.count_distinct("index_id").alias("n_indexes"), F.min("index_id").alias("index_id"))
    out = asked.join(hits, on, "left").withColumn("n_indexes", F.coalesce("n_indexes", F.lit(0)))
    status = F.when(F.col("n_indexes") == 0, "missing").when(F.col("n_indexes") > 1, "ambiguous").otherwise("found")
    return out.withColumns({"status": status, "index_id": F.when(status == "found", F.col("index_id"))})


def grounded(statements: DataFrame, evidence: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Statements whose cell is among the evidence, placeholders not counted as evidence."""
    real = evidence.where(~F.upper(F.trim("cell_value")).isin(*C.PLACEHOLDERS_EVIDENCE))
    return statements.join(real.select(cell).distinct(), cell, "left_semi")


def validated(answers: DataFrame) -> DataFrame:
    """Status of an extracted answer; the first rule that holds decides.

    answers: same_lineage, raw_value, n_evidence, unit, profile_units (an array).  Answers of another request are
    invalid; a placeholder is missing; a value without evidence is invalid; without a unit of its own a value takes the
    profile's only one, and is ambiguous where the profile has several.
    """
    units = F.array_distinct(F.array_compact("profile_units"))
    unit = F.coalesce("unit", F.when(F.size(units) == 1, units[0]))
    status = (
        F.when(~F.coalesce("same_lineage", F.lit(False)), C.INVALID)
        .when(F.col("raw_value").isNull() | F.upper(F.trim("raw_value")).isin(*C.PLACEHOLDERS_EXTRACTION), C.MISSING)
        .when(F.coalesce("n_evidence", F.lit(0)) == 0, C.INVALID)
        .when(unit.isNull() & (F.size(units) > 1), C.AMBIGUOUS)
        .when(F.regexp_replace("raw_value", ",", "").try_cast("double").isNull(), C.INVALID)
        .otherwise(C.AVAILABLE)
    )
    return answers.withColumns({"status": status, "unit": unit})


def first_wins(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The union of parts, where of equal keys the row of the first part (then by order) stays."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("part", *order)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def known_metrics(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observations of metrics that the catalog still has."""
    return observations.join(catalog.select("metric_id").distinct(), "metric_id", "left_semi")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal keys; rows are read as they come."""
    key, digest, any_yet = None, None, False
    for batch in batches:
        out = []
        for k, row in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            k = k.as_py()
            if digest is not None and k != key:
                out.append((key, digest.hexdigest()))
                digest = None
            if digest is None:
                key, digest, any_yet = k, hashlib.sha256(), False
            digest.update(f"{chr(30) if any_yet else ''}{row}".encode())
            any_yet = True
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], batch.column(0).type), pa.array([x[1] for x in out])], names=["key", "fingerprint"])
        kind = batch.column(0).type
    if digest is not None:
        yield pa.record_batch([pa.array([key], kind), pa.array([digest.hexdigest()])], names=["key", "fingerprint"])


def fingerprint(rows: DataFrame, key: str, *parts: Column) -> DataFrame:
    """One SHA-256 for each key over its rows in order.

    Each row is hashed first; a key's digests are sorted by Spark and hashed as a stream, so none of its lists is held.
    """
    row = F.sha2(F.concat_ws("\x1e", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)
    ordered = rows.select(F.col(key).alias("key"), row.alias("row")).repartition("key").sortWithinPartitions("key", "row")
    kind = rows.schema[key].dataType.simpleString()
    return ordered.mapInArrow(_digests, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def cache_key(module: Column, version: Column, given: Column, config: Column) -> Column:
    """The key of a result: module and version, the digest of its input, its configuration."""
    return F.sha2(F.concat_ws("|", F.concat_ws("@", module, version), F.sha2(given, 256), config), 256)


def shard_ranges(counts: DataFrame, size: int, key: str = "index_id", count: str = "n") -> DataFrame:
    """(key, shard, start, stop) of the ranges of size rows that a count splits into."""
    shards = F.sequence(F.lit(0), F.ceil(F.col(count) / size).cast("int") - 1)
    out = counts.where(F.col(count) > 0).withColumn("shard", F.explode(shards))
    return out.select(key, "shard", (F.col("shard") * size).cast("long").alias("start"), F.least((F.col("shard") + 1) * size, F.col(count)).cast("long").alias("stop"))


def common_years(left: DataFrame, right: DataFrame, keep: int = 5, entity: str = "company_id", year: str = "fiscal_year") -> DataFrame:
    """The last years that both series of an entity have."""
    both = left.join(right, [entity, year])
    w = Window.partitionBy(entity).orderBy(F.desc(year))
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def tree_paths(nodes: DataFrame, separator: str = " / ") -> DataFrame:
    """(node_id, path, depth) of a tree (node_id, parent_id, name), roots at depth 0.

    One join for each level of the tree; levels are one table.  Nodes that no root reaches are left out.
    """
    nodes, levels = cut(nodes.select("node_id", "parent_id", "name")), Levels(nodes.sparkSession)
    level = levels.add(nodes.where("parent_id IS NULL").select("node_id", F.col("name").alias("path"), F.lit(0).alias("depth")))
    while not level.isEmpty():
        up = level.select(F.col("node_id").alias("parent_id"), "path", "depth")
        level = levels.add(nodes.join(up, "parent_id").select("node_id", F.concat_ws(separator, "path", "name").alias("path"), (F.col("depth") + 1).alias("depth")))
    return levels.all()


def recalculated(observations: DataFrame, formulas: tuple[str, ...], entity: str = "company_id", period: str = "fiscal_year") -> DataFrame:
    """Derived metrics from stored source observations: (entity, period, metric_id, value, status, issue).

    observations: entity, period, metric_id, value, status.  A formula's status is the first by precedence of those of
    its variables, a zero denominator is not meaningful; issue names formula and status unless it is available.
    """
    names = sorted({v for f in formulas for v in derived(f)[1]})
    pick = lambda n, c: F.max(F.when(F.col("metric_id") == n, F.col(c)))
    wide = observations.where(F.col("metric_id").isin(*names)).groupBy(entity, period).agg(*(pick(n, "value").alias(n) for n in names), *(F.coalesce(pick(n, "status"), F.lit(C.MISSING)).alias(f"{n}_status") for n in names))
    for f in formulas:
        wide = derive(wide, f)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("metric_id"), F.col(f).alias("value"), F.col(f"{f}_status").alias("status")) for f in formulas))).alias("r")
    out = wide.select(entity, period, rows).select(entity, period, "r.*")
    return out.withColumn("issue", F.when(F.col("status") != C.AVAILABLE, F.concat_ws(":", "metric_id", "status")))


def renamed_company(rows: DataFrame, key: str, company: str, meta: str = "meta", text: str = "text") -> DataFrame:
    """Rows (of one collection) with the JSON key set and the company at the start of the text replaced."""
    new = S.json_set(F.col(meta), key, F.lit(company))
    start = F.concat(F.lit("Company: "), F.lit(company), F.lit(" |"))
    rest = F.regexp_extract(text, r"(?s)^Company: [^|]*\|(.*)$", 1)
    return rows.withColumns({meta: new, text: F.when(F.col(text).rlike(r"^Company: [^|]*\|"), F.concat(start, rest)).otherwise(F.col(text))})


def cascaded(tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (with the columns that name the deleted key in it) without the rows of the deleted keys."""
    out = {}
    for name, (df, columns) in tables.items():
        keys = gone.toDF(*columns).distinct()
        out[name] = df.join(keys, columns, "left_anti").select(*df.columns)
    return out


def compacted(rows: DataFrame, polluted: Column, group: list[str], key: str, variant: str) -> tuple[DataFrame, DataFrame]:
    """(rows without polluted ones, a report for each group: n_before, n_removed, n_incomplete).

    A key is incomplete if one of its two variants is missing afterwards.
    """
    kept = rows.where(~F.coalesce(polluted, F.lit(False)))
    has = lambda v: F.bool_or(F.col(variant) == v)
    whole = kept.groupBy(*group, key).agg((has("header_only") & has("header_with_value")).alias("whole")).groupBy(*group).agg(F.count_if(~F.col("whole")).alias("n_incomplete"))
    report = rows.groupBy(*group).agg(F.count("*").alias("n_before"), F.count_if(F.coalesce(polluted, F.lit(False))).alias("n_removed"))
    return kept, report.join(whole, group, "left").withColumn("n_incomplete", F.coalesce("n_incomplete", F.lit(0)))


def period_samples(documents: DataFrame, group: list[str]) -> DataFrame:
    """One document for each period header of a group, those with a value first, then by coordinate.

    The header is the column header, or the value of a document with a value that has none; documents without are out.
    """
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    header = F.coalesce(clean("column_header"), F.when(F.col("variant") == "header_with_value", clean("cell_value")))
    w = Window.partitionBy(*group, "period_header").orderBy(F.when(F.col("variant") == "header_with_value", 0).otherwise(1), "cell_coord")
    out = documents.withColumn("period_header", header).where("period_header IS NOT NULL")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered_claims(queue: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first entries of a queue, numbered from 1; most is the claim's stated size."""
    first = queue.orderBy(*order).limit(most)
    return first.withColumn("number", F.row_number().over(Window.orderBy(*order)))
