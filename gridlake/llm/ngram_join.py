"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles.  Shingles that few documents hold (the rare and the common class)
are indexed one by one; those of the frequent class are indexed as combinations of k neighbours in the global order, within a prefix
extended so far that a pair over the threshold must share one.  Candidates are verified on whole sets.

Global order: shingles not known to repeat, then the common, then the frequent class, each by hash.  "Rare" below means
the first two.  Any order gives the same links; this one keeps shared shingles out of prefixes.  With n shingles, t = ceil(threshold * n) and
p = n - t + 1, two sets over the threshold share a shingle among the first p of both.  If that one is rare, the single
entries meet.  Otherwise all first-p rare shingles of both are unshared, so both hold fewer than p rare ones, and at
most h = floor(n * (1 - threshold) / threshold) shingles differ (n the smaller size).  Of the first h + 1 disjoint runs
of k frequent shingles a difference spoils one at most, so a run of k neighbours is common to both; it begins no later
than k * (h + 1) + h in the other's order.  Each such set therefore indexes the sliding runs of its first
(k + 1) * h + k frequent shingles.  The argument needs k * (h + 1) frequent shingles that both have, and so t of at
least that; where a set's partners may be too small for it (short texts, low thresholds), the frequent shingles of its
prefix are indexed one by one as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import LocalForest, connected_components
from .storage import Scratch
from .text import U, mix, shingle_sets, string_chunks, to_long, word_hashes

#: A shingle of more sets than this belongs to the frequent class.
FREQUENT_DF = 100
#: Shingles that repeat are broadcast; while there are more of them than this (16 MB), the least df of the list doubles.
MAX_LISTED = 2_000_000
_FLUSH = 4_000_000


def _bound(n: int, threshold: tuple[int, int]) -> tuple[int, int]:
    """(prefix length, most shingles that differ) of a set of n shingles."""
    num, den = threshold
    return n - -(-num * n // den) + 1, n * (den - num) // num


def _needs_singles(n: int, threshold: tuple[int, int], k: int) -> bool:
    """Whether a partner of n shingles or fewer may share too few for a common run of k (see the module's docstring)."""
    num, den = threshold
    # a partner of m shingles is safe if k * (m * (den - num) / num + 1) <= m * num / den
    gain = num * num - k * den * (den - num)
    return gain <= 0 or -(-num * n // den) * gain < k * num * den


def _set_ids(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One id for each set, whose shingles stand one after the other in flat."""
    total = np.zeros(len(flat) + 1, dtype=U)
    np.cumsum(mix(flat), out=total[1:])
    ends = np.cumsum(sizes)
    return mix(total[ends] - total[ends - sizes] + sizes.astype(U))


def _statistics(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "id", "token", "df"]
        pending: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            # shingles that stand once in a flush are left out: a df is short by one a flush at most
            v, c = np.unique(np.concatenate(pending), return_counts=True)
            v, c = v[c > 1], c[c > 1]
            none = pa.nulls(len(v), pa.int64())
            return pa.record_batch([none, none, none, pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in string_chunks(batch, "text"):
                words, first = word_hashes(data, off)
                sets = list(shingle_sets(words, first, width))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets)
                none = pa.nulls(b - a, pa.int64())
                yield pa.record_batch([ids.slice(a, b - a), pa.array(sizes), to_long(_set_ids(flat, sizes)), none, none], names=names)
                pending.append(flat)
                held += len(flat)
                if held >= _FLUSH:
                    yield counted()
                    pending, held = [], 0
        if pending:
            yield counted()

    return run


def _signatures(width: int, threshold: tuple[int, int], listed, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = listed.value

        for batch in batches:
            for _, _, data, off in string_chunks(batch, "text"):
                words, first = word_hashes(data, off)
                sets = list(shingle_sets(words, first, width))
                flat = np.concatenate(sets)
                rank = np.zeros(len(flat), dtype=np.int8)
                if len(repeated):
                    at = np.minimum(np.searchsorted(repeated, flat), len(repeated) - 1)
                    rank = np.where(repeated[at] == flat, 1 + frequent[at], 0)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                ids = _set_ids(flat, sizes)
                ends = np.cumsum(sizes)
                out, many = [], np.zeros(len(sets), dtype=np.int64)
                for i, s in enumerate(sets):
                    n = len(s)
                    if not n:
                        continue
                    p, h = _bound(n, threshold)
                    r = rank[ends[i] - n : ends[i]]
                    rare = s[r == 0]
                    if len(rare) < p:
                        rare = np.concatenate([rare, s[r == 1]])
                    sig = [rare[:p]]
                    if len(rare) < p:
                        freq = s[r == 2]
                        if _needs_singles(n, threshold, k):
                            sig.append(freq[: p - len(rare)])
                        near = freq[: (k + 1) * h + k]
                        m = len(near) - k + 1
                        if m > 0:
                            combo = np.full(m, U(k), dtype=U)
                            for j in range(k):
                                combo = mix(combo * U(0x9E3779B97F4A7C15) + near[j : j + m])
                            sig.append(combo)
                    out += sig
                    many[i] = sum(map(len, sig))
                if out:
                    yield pa.record_batch([to_long(np.concatenate(out)), to_long(np.repeat(ids, many))], names=["sig", "id"])

    return run


def _sketch(tokens: np.ndarray) -> bytes:
    """Counts of the shingles in equal ranges of hashes, a quarter to a half of a byte for each shingle."""
    bits = max(6, int(len(tokens)).bit_length() - 2)
    counts = np.bincount((tokens >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _may_share(x: np.ndarray, y: np.ndarray) -> int:
    """At least as many shingles as the two sketched sets share."""
    if x.max() == 255 or y.max() == 255:
        return 1 << 60
    m = min(len(x), len(y))
    x, y = (v.reshape(m, -1).sum(axis=1, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def _of_sets(width: int, chosen, make):
    """make(set) in bytes for the documents whose bit is set in the bitmap chosen; other documents are not parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = chosen.value
        for batch in batches:
            batch = batch.filter(pa.array(_bit(bitmap, batch.column(0).to_numpy(zero_copy_only=False))))
            for _, _, data, off in string_chunks(batch, "text"):
                words, first = word_hashes(data, off)
                sets = list(shingle_sets(words, first, width))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ids = _set_ids(np.concatenate(sets), sizes)
                yield pa.record_batch([to_long(ids), pa.array(sizes), pa.array([make(s) for s in sets], pa.binary())], names=["id", "n", "data"])

    return run


#: Bits of the bitmap that stands for a set of documents (8 MB); more documents only mean more false positives.
_BITMAP = 26


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(U)) >> U(64 - _BITMAP)).astype(np.int64)


def _bit(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slots(ids)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = np.unique(np.concatenate([np.zeros(0, np.int64), *(_slots(b.column(0).to_numpy(zero_copy_only=False)) for b in batches)]))
    yield pa.record_batch([pa.array(at)], names=["slot"])


def _bitmap(docs: DataFrame):
    """A broadcast bitmap of fixed size with the bits of all doc_ids set, gathered as one word for each 64 bits."""
    words = docs.select("doc_id").mapInArrow(_bitmap_parts, "slot long").groupBy(F.expr("slot >> 6").alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_BITMAP - 6), dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))


def _likely(threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                if den * min(na[i], nb[i]) < num * max(na[i], nb[i]):
                    continue
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y))
                shared = min(_may_share(x, y), na[i], nb[i])
                if den * shared >= num * (na[i] + nb[i] - shared):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return run


def _verified(threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared = [], []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if den * same >= num * (len(both) - same):
                    keep.append(i)
                    shared.append(same)
            rows = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(shared, pa.int64())], names=["a", "b", "shared"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the blocks of a sorted partition: (block, id, n, weight, comp, data), BLOCK sets or BLOCK_BYTES at most in a block."""
    n = size = 0
    name = None
    for batch in batches:
        ids, data = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1)
        out = []
        for i, length in zip(ids, pa.compute.binary_length(data).to_pylist(), strict=True):
            if name is None or n >= BLOCK or size + length > BLOCK_BYTES:
                name, n, size = i, 0, 0
            n, size = n + 1, size + length
            out.append(name)
        yield pa.record_batch([pa.array(out, pa.int64()), *batch.columns], names=["block", *batch.schema.names])


#: Sets of a block, and bytes of its shingles (a single larger set is a block of its own).
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Buckets of more sets than this, of several components still, are compared block by block, smaller ones pair by pair.
HOT = 64


def _join_blocks(threshold: tuple[int, int]):
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        side = np.array(table["side"].to_pylist()) == "b"
        table = table.take(pa.array(np.argsort(side, kind="stable")))
        ids = table["id"].to_numpy()
        n_a = int((~side).sum())
        sets = [np.frombuffer(x.as_buffer(), dtype=U) for x in table["data"]]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        again = count[token] > 1
        owner, token = owner[again], token[again]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], np.unique(token[order], return_inverse=True)[1]
        own = n_a == len(sets)  # a block with itself
        left, right = (slice(0, n_a), slice(0, n_a)) if own else (slice(0, n_a), slice(n_a, len(sets)))
        shared = np.zeros((n_a, len(sets) if own else len(sets) - n_a), dtype=np.float32)
        step = 4096
        for t in range(0, int(token[-1]) + 1 if len(token) else 0, step):
            x, y = np.searchsorted(token, [t, t + step])
            part = np.zeros((len(sets), step), dtype=np.float32)
            part[owner[x:y], token[x:y] - t] = 1
            shared += part[left] @ part[right].T
        shared = np.rint(shared).astype(np.int64)
        near = den * shared >= num * (size[left][:, None] + size[right] - shared)
        if own:
            np.fill_diagonal(near, False)
        rows, cols = np.arange(len(sets))[left], np.arange(len(sets))[right]
        weight = table["weight"].to_numpy()
        links = np.zeros(len(sets), dtype=np.int64)
        links[rows] += near @ weight[cols]
        if not own:
            links[cols] += weight[rows] @ near
        forest = LocalForest(len(sets))
        forest.add(near, rows, cols)
        root = forest.roots()
        got = np.flatnonzero((links > 0) | (root != np.arange(len(sets))))
        return pa.table({"id": ids[got], "links": links[got], "with": ids[root[got]]})

    return run


def ngram_jaccard_join(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5), k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between documents whose shingle sets have a Jaccard similarity of at least threshold.

    Returns (members, links).  members: doc_id, n_shingles, set_id (null without shingles), n_links (other documents
    linked directly, copies included), component_id, one row for each input row.  links: a, b (set ids): verified pairs
    that join all sets of each component; n_links counts the others as well.

    Defined cases: a null or empty text, or one of white space, has no shingles and its own component; a text of fewer
    than width words is one shingle; repeated rows and exact copies share a set_id, and link with each other; rows with
    a null id are left out, as nothing can refer to them; further columns are ignored; an empty table gives empty
    tables.  Texts may be of any length.  Sets are told apart by 64-bit hashes of their shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    spark = docs.sparkSession
    num, den = threshold
    tmp = Scratch()
    stats = tmp.written(docs.mapInArrow(_statistics(width), "doc_id long, n long, id long, token long, df long"), "shingle-stats")

    counts = tmp.written(stats.where("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")), "shingle-df")
    least = 2
    while counts.where(F.col("df") >= least).count() > MAX_LISTED:
        least *= 2
    frequent_df = max(FREQUENT_DF, least)
    listed = counts.where(F.col("df") >= least).select("token", (F.col("df") > frequent_df).cast("byte").alias("often")).toArrow()
    tokens, often = listed["token"].to_numpy().view(U), listed["often"].to_numpy()
    order = np.argsort(tokens)
    listed = spark.sparkContext.broadcast((tokens[order], often[order]))

    members = stats.where("doc_id IS NOT NULL").select("doc_id", "n", F.when(F.col("n") > 0, F.col("id")).alias("id"))
    classes = tmp.written(members.where("id IS NOT NULL").groupBy("id", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")), "shingle-sets")

    posts = docs.mapInArrow(_signatures(width, threshold, listed, k), "sig long, id long")
    shared = posts.groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low <> high").select("sig", "size")
    buckets = tmp.written(posts.join(shared, "sig").select("sig", "id", "size").distinct(), "signature-buckets")

    # The centre of a bucket is the set that meets most others in its buckets: of a group of altered copies the original
    met = buckets.groupBy("id").agg(F.sum("size").alias("met"))
    ranked = buckets.join(met, "id").select("sig", "id", F.struct("met", "id").alias("rank"))
    centres = ranked.groupBy("sig").agg(F.max("rank").alias("centre")).select("sig", F.col("centre.id").alias("pivot"))
    stars = buckets.join(centres, "sig").where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    stars = tmp.written(stars, "star-pairs")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    def parsed(ids: DataFrame, make, name: str) -> DataFrame:
        """make(set) of the sets of these ids: their documents are read again."""
        reps = ids.distinct().join(classes, "id").select(F.col("rep").alias("doc_id"))
        return tmp.written(docs.mapInArrow(_of_sets(width, _bitmap(reps), make), "id long, n long, data binary"), name)

    def joined(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
        """pairs (a, b) with the columns of either set, those of a first."""
        for end in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(end), *(F.col(c).alias(c + end) for c in columns)), end)
        return pairs.select("a", "b", *(c + end for c in columns for end in "ab"))

    sketches = parsed(buckets.select("id"), _sketch, "sketches")

    def likely(pairs: DataFrame) -> DataFrame:
        return tmp.written(joined(pairs, sketches, ["n", "data"]).mapInArrow(_likely(threshold), "a long, b long").distinct(), "likely-pairs")

    def verified(pairs: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
        return tmp.written(joined(pairs, tokens, ["data"]).mapInArrow(_verified(threshold), "a long, b long, shared long").distinct().select("a", "b"), name)

    pairs = likely(stars)
    first = verified(pairs, parsed(ends_of(pairs), np.ndarray.tobytes, "token-sets"), "star-links")
    comp = tmp.adopt(connected_components(first)).withColumnRenamed("node", "id")

    # Pairs of a bucket whose ends are still in different components, other than those of the stars
    placed = buckets.join(comp, "id", "left").select("sig", "id", "size", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
    open_ = tmp.written(placed.join(mixed, "sig"), "open-buckets")
    small = open_.where(F.col("size") <= HOT)
    x, y = (small.select("sig", F.col("id").alias(i), F.col("comp").alias(f"c{i}")) for i in "ab")
    rest = likely(x.join(y, "sig").where("a < b AND ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))

    # Sets of components of three or more, and those of large open buckets, are laid in blocks, alike ones together; two
    # blocks that share a component or such a bucket are compared as a whole, once.  What comes back is a count of links
    # for each set and a spanning forest, so a group of any size yields no more rows than it has sets
    large = comp.groupBy("component").count().where("count > 2").select("component")
    hot = open_.where(F.col("size") > HOT).select("sig", "id", "comp")
    laid = comp.join(large, "component").select("id", F.col("component").alias("comp")).unionByName(hot.select("id", "comp")).distinct()
    laid = tmp.written(laid, "laid-sets")
    token_sets = parsed(laid.select("id").union(ends_of(rest)), np.ndarray.tobytes, "token-sets")
    second = verified(rest, token_sets, "more-links")
    parts = 1 + laid.count() // (4 * BLOCK)  # whole blocks, however many partitions the session deals to
    ordered = laid.join(classes.select("id", "n", "weight"), "id").join(token_sets.select("id", "data").dropDuplicates(["id"]), "id")
    ordered = ordered.repartitionByRange("comp", "n", "id").sortWithinPartitions("comp", "n", "id").coalesce(parts)
    blocks = tmp.written(ordered.select("id", "n", "weight", "comp", "data").mapInArrow(_blocks, "block long, id long, n long, weight long, comp long, data binary"), "set-blocks")
    span = blocks.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    block_of = blocks.select("id", "block")
    held = blocks.select(F.lit("comp").alias("kind"), F.col("comp").alias("what"), "block").unionByName(hot.join(block_of, "id").select(F.lit("sig").alias("kind"), F.col("sig").alias("what"), "block"))
    held = tmp.written(held.distinct().join(span, "block"), "block-keys")
    x, y = (held.select("kind", "what", F.col("block").alias(i), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")) for i in "pq")
    # blocks of sets too unlike in size are no pair
    pairs = x.join(y, ["kind", "what"]).where(f"p <= q AND {den} * hip >= {num} * loq AND {den} * hiq >= {num} * lop").select("p", "q").distinct()
    pairs = tmp.written(pairs, "block-pairs")
    ends = pairs.select("p", "q", F.col("p").alias("block"), F.lit("a").alias("side")).unionByName(pairs.where("p <> q").select("p", "q", F.col("q").alias("block"), F.lit("b").alias("side")))
    third = ends.join(blocks.select("block", "id", "weight", "data"), "block").groupBy("p", "q").applyInArrow(_join_blocks(threshold), "id long, links long, with long")
    third = tmp.written(third, "block-links")

    # Links found one by one, but for those that a pair of blocks has counted
    single = first.unionByName(second)
    for end, name in (("a", "p"), ("b", "q")):
        single = single.join(block_of.select(F.col("id").alias(end), F.col("block").alias(name)), end, "left")
    counted = pairs.select("p", "q", F.lit(True).alias("counted"))
    single = single.select("a", "b", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p").isNotNull() & F.col("q").isNotNull()).alias("both"))
    single = single.join(counted.withColumnsRenamed({"p": "x", "q": "y"}), ["x", "y"], "left").where("NOT both OR counted IS NULL").select("a", "b")
    single = tmp.written(single, "single-links")
    weights = classes.select("id", "weight")
    mutual = single.unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mutual = mutual.join(weights.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("weight").alias("links"))
    n_links = mutual.unionByName(third.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))

    links = tmp.written(single.unionByName(third.where("id <> with").select(F.col("with").alias("a"), F.col("id").alias("b"))).distinct(), "links")
    comp = tmp.adopt(connected_components(links)).withColumnRenamed("node", "id")
    of_set = classes.join(comp, "id", "left").join(n_links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_doc = of_set.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(least_doc, "component").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    of_set = tmp.written(of_set, "set-components")
    tmp.clear(stats, links, of_set)
    listed.unpersist()
    out = members.join(of_set, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")), links
