"""Keyword search with cover density over a table of postings.

A posting is a word of a text with its length and all places of the word there.  Postings are stored in buckets of words, so
a search reads only the buckets of the words that are asked for, and the join on words needs no exchange of postings.
Texts that are searched once need no stored postings: those of the asked words are taken in one pass over the texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of the texts' table for each file of postings, from which layout() takes buckets and shares.
FILE_BYTES = 64 << 20
#: Buckets of words and shares of a bucket at the least and the most, and those for tables of unknown size.
LEAST, MOST, UNKNOWN = (8, 2), 4096, (64, 4)
#: Words of all queries up to which buckets are picked by a list, which is broadcast; more are met by a join of two tables.
LISTED = 1000
#: Words that a task sorts by text and word at once, or those of one text.
AT_ONCE = 1 << 18
#: What a word of the lowest weight class counts in a cover.
WEIGHT = 0.1

_POSTINGS = "word string, doc_id long, length long, places array<int>"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1), lambda x: x != "")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts of a batch, as many at a time as have AT_ONCE words, one at the least: Arrow counts rows, whatever their size."""
    ends = np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0)), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + AT_ONCE, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word of a text; a text is in one row, so nothing is dealt out for it."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        lists = batch.column(1)
        size = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + 1
        code = flat.indices.to_numpy()
        order = np.lexsort((code, doc))  # stable: places stay in order
        doc, code, place = doc[order], code[order], place[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else doc
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))
        whose = pa.array(doc[first])
        yield pa.record_batch([flat.dictionary.take(pa.array(code[first])), batch.column(0).take(whose), pa.array(size[doc[first]].astype(np.int64)), places], names=["word", "doc_id", "length", "places"])


def _worded(docs: DataFrame) -> DataFrame:
    """The words of each text; texts without any stay, as a condition on the words would split each text twice."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))


def _asked(queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(query_id, need, word) of the queries' distinct words, and their list, or None where there are more than LISTED rows."""
    wanted = queries.select("query_id", F.array_distinct(F.array_compact("words")).alias("words"))
    wanted = wanted.select("query_id", F.size("words").alias("need"), F.explode("words").alias("word"))
    listed = [r["word"] for r in wanted.select("word").limit(LISTED + 1).collect()]
    return (F.broadcast(wanted), sorted(set(listed))) if len(listed) <= LISTED else (wanted, None)


def occurrences(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of docs (doc_id, text) for the words of queries (query_id, words), not stored: for a search that is made once.

    Up to LISTED words of all queries are picked out where a text is read, so nothing else leaves its row; with more of them, the postings
    of all words are made and the search's join picks.  match_all gives the same rows on both and on stored postings.
    """
    _, listed = _asked(queries)
    rows = _worded(docs)
    if listed is None:
        return rows.mapInArrow(_by_word, _POSTINGS)
    if not listed:
        return docs.sparkSession.createDataFrame([], _POSTINGS)
    seen = F.array_compact(F.transform("words", lambda x, i: F.when(x.isin(listed), F.struct(x.alias("word"), (i + 1).alias("place")))))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("length"), seen.alias("seen"))
    rows = rows.select("doc_id", "length", "seen", F.explode(F.array_distinct(F.col("seen.word"))).alias("word"))
    places = F.transform(F.filter("seen", lambda h: h["word"] == F.col("word")), lambda h: h["place"])
    return rows.select("word", "doc_id", "length", places.alias("places"))


def layout(size: int) -> tuple[int, int]:
    """(buckets, shares) for a table of size bytes.

    Buckets and the files of each grow alike, with the root of the size: a search for a word reads the fewer of all files the
    larger the table is, and a word of every text is written by the more tasks.
    """
    if size >= 1 << 60:  # what Spark says where it knows nothing
        return UNKNOWN
    side = math.ceil(math.sqrt(size / FILE_BYTES))
    return min(max(LEAST[0], side), MOST), min(max(LEAST[1], side), MOST)


def postings(docs: DataFrame, buckets: int | None = None, shares: int | None = None) -> DataFrame:
    """The stored postings (word, doc_id, length, places from 1) of docs (doc_id, text); a null text has no words.

    buckets: of words; shares: files, each written by a task, of a bucket.  Both follow the table's size unless given.
    """
    spark, name = docs.sparkSession, f"postings_{uuid.uuid4().hex}"
    by_size = layout(int(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets, shares = buckets or by_size[0], shares or by_size[1]
    rows = _worded(docs).mapInArrow(_by_word, _POSTINGS)
    # a task for each bucket and share, so that a bucket is that many files, however many tasks read the texts
    dealt = rows.repartitionById(buckets * shares, F.pmod(F.hash("word"), F.lit(buckets)) * shares + F.pmod(F.hash("doc_id"), F.lit(shares)))
    dealt.write.bucketBy(buckets, "word").sortBy("word").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop_postings(stored: DataFrame) -> None:
    """Delete stored postings."""
    spark = stored.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _covers(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, places of query words inside) of each minimal cover: a stretch that holds all words and no
    shorter one that does.  lists has the ascending places of each word.
    """
    every = np.sort(np.concatenate(lists))
    begin = np.full(len(every), np.iinfo(np.int64).max)
    for own in lists:  # the latest place of each word up to here
        at = np.searchsorted(own, every, side="right") - 1
        begin = np.minimum(begin, np.where(at >= 0, own[np.maximum(at, 0)], -1))
    ends = np.flatnonzero((begin >= 0) & np.append(True, begin[1:] != begin[:-1]))
    begin, end = begin[ends], every[ends]
    return begin, end, ends - np.searchsorted(every, begin) + 1


def density(lists: list[np.ndarray]) -> float:
    """Sum over the minimal covers of WEIGHT by one more than the words in it that are not asked for."""
    begin, end, inside = _covers(lists)
    return float((WEIGHT / (1 + (end - begin) - (inside - 1))).sum())


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(2)
        scores = [density([np.asarray(x.values, dtype=np.int64) for x in held[k]]) for k in range(len(held))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query_id", "doc_id", "score"])


def match_all(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Texts that hold every word of a query, best first: query_id, doc_id, score, rank.

    stored: postings or occurrences; queries: query_id, words (array).  The score is the cover density: each shortest stretch of a text that
    holds all words counts the more the fewer other words stand in it.  All places of a text count, however long it is.
    Equal scores (to nine digits) are ordered by doc_id.  Defined cases: words of a query that are repeated or null count
    once or not at all; a query without words finds nothing.
    """
    wanted, listed = _asked(queries)
    if listed is not None:
        stored = stored.where(F.col("word").isin(listed) if listed else F.lit(False))
    hits = stored.join(wanted, "word").groupBy("query_id", "doc_id", "need").agg(F.collect_list("places").alias("held"))
    found = hits.where("size(held) = need").select("query_id", "doc_id", "held")
    found = found.mapInArrow(_scored, f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score double").withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
