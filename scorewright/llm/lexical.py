"""Ranked lexical search over document-sharded postings.

The index is a table with a row per shard, some megabytes of documents: the shard's terms in order, the start of each
term's postings, and in the postings the document's number in the shard and its impact, an integer that holds all of a
score but the term's weight (compressed sparse rows). A search reads it twice without shuffling it: the first pass takes the
document frequencies of the terms asked, from the starts alone; the second adds up weighted impacts, term after term, in a
dense array over the shard's documents, and hands on the shard's best. Scores are 64-bit integers, so the order in which
they are added does not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import give_back, materialize, small_batches, utf8
from scorewright.llm.words import _FOLD, words

#: Characters of a term; A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text, and documents, in a shard at most (a single longer text is one).
SHARD_BYTES, SHARD_DOCS = 8_000_000, 1 << 16
#: Pairs of item and term that go to the tasks at once; items beyond are searched for in further passes.
PAIRS_SENT = 1_000_000
#: Documents that an item gets.
BEST = 20


def shard_of(texts: list[np.ndarray], vocabulary: dict[bytes, int], n_docs: int, n_terms: int) -> dict[str, np.ndarray | bytes]:
    """The postings of a shard whose documents are given as numbers of the vocabulary, for a corpus of n_docs and n_terms."""
    spelt = sorted(vocabulary)
    rank = np.zeros(len(spelt), np.int64)
    rank[[vocabulary[t] for t in spelt]] = np.arange(len(spelt))
    lengths = np.array([len(x) for x in texts], np.int64)
    term = rank[np.concatenate(texts)] if texts else np.zeros(0, np.int64)
    keys, tf = np.unique(term << 16 | np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    doc = (keys & 0xFFFF).astype(np.uint16)
    damped = 100 - 25 + 25 * lengths * n_docs // max(1, n_terms)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * damped[doc])
    starts = np.searchsorted(keys >> 16, np.arange(len(spelt) + 1))
    return {"terms": b" ".join(spelt), "starts": starts.astype(np.int32), "docs": doc, "impacts": impact.astype(np.uint32)}


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index of docs, written under the shared folder, and the number of documents with a term.

    Every row is a document, also if its doc_id repeats or is null. Null, empty and other termless texts are in no shard.
    """
    small_batches(docs.sparkSession)
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    n_docs, n_terms = (x or 0 for x in docs.agg(F.sum((n > 0).cast("long")), F.sum(n)).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        vocabulary = defaultdict(count().__next__)

        def shard() -> pa.RecordBatch:
            made = shard_of(texts, vocabulary, n_docs, n_terms)
            columns = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in made.values())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_ids", *made])

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for doc_id, start, stop in zip(batch.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                found = data[start:stop].tobytes().translate(_FOLD).split()
                if found:
                    ids.append(doc_id)
                    texts.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                    held += stop - start
                if held >= SHARD_BYTES or len(ids) == SHARD_DOCS:
                    yield shard()
                    ids, texts, held = [], [], 0
                    vocabulary = defaultdict(count().__next__)
        if ids:
            yield shard()
        give_back()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(given.mapInArrow(run, "doc_ids array<long>, terms binary, starts binary, docs binary, impacts binary"), "postings"), n_docs


def asked_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term, q): how often each item's texts hold each of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(x) for x in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([t for x in found for t in x], pa.binary())], names=["item_id", "term"])

    given = queries.select("item_id", "text")
    return given.mapInArrow(run, f"item_id {given.schema['item_id'].dataType.simpleString()}, term binary").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores above 0, of equal scores those of the least ids."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]  # all that tie with the last one
        at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return at


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item_id of queries the k documents with the highest scores above 0.

    Equal scores rank by ascending doc_id, null last. The texts of an item_id that repeats are one item; a null item_id is one
    like others. Items whose terms no document has get no row.
    """
    asked = materialize(asked_terms(queries), "asked")
    passes = max(1, -(-asked.count() // PAIRS_SENT))
    found = None
    for part in range(passes):
        own = _found(index, n_docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part), k)
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _found(index: DataFrame, n_docs: int, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best k of each shard for the items in asked, PAIRS_SENT pairs or so."""
    pairs = asked.toArrow()
    spelt = pairs.column("term").combine_chunks().dictionary_encode()
    number = {term: k for k, term in enumerate(spelt.dictionary.to_pylist())}
    items: dict = {}
    for item, term, q in zip(pairs.column("item_id").to_pylist(), spelt.indices.to_pylist(), pairs.column("q").to_pylist()):
        items.setdefault(item, []).append((term, q))
    context = index.sparkSession.sparkContext
    sent = context.broadcast(number)

    def places(terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard of the terms asked, and their numbers."""
        own = np.array([sent.value.get(t, -1) for t in terms.split(b" ")], np.int64)
        at = np.flatnonzero(own >= 0)
        return at, own[at]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                at, own = places(terms.as_py())
                starts = np.frombuffer(starts.as_buffer(), np.int32)
                total[own] += starts[at + 1] - starts[at]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "df"])

    df = index.select("terms", "starts").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weight = np.zeros(len(number), np.int64)
    weight[df.column("term").to_numpy()] = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.column("df").to_numpy() + 1))).astype(np.int64)
    queries = context.broadcast((list(items), list(items.values()), weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, wanted, weight), none = queries.value, [np.zeros(0, np.int64)]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, terms, *arrays = (batch.column(c)[row] for c in range(5))
                ids = ids.values
                order = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                starts, docs, impacts = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(arrays, (np.int32, np.uint16, np.uint32)))
                place = np.full(len(weight), -1)
                at, own = places(terms.as_py())
                place[own] = at
                of, where, scores = [], [], []
                for item, pairs in enumerate(wanted):
                    sums = np.zeros(len(ids), np.int64)
                    for term, q in pairs:
                        if (p := place[term]) >= 0:
                            sums[docs[starts[p] : starts[p + 1]]] += q * weight[term] * impacts[starts[p] : starts[p + 1]].astype(np.int64)
                    top = best(sums, order, k)
                    of += [item] * len(top)
                    where.append(top)
                    scores.append(sums[top])
                item_ids = pa.array([names[x] for x in of], item_type)
                yield pa.RecordBatch.from_arrays([item_ids, ids.take(pa.array(np.concatenate(where or none))), pa.array(np.concatenate(scores or none))], names=["item_id", "doc_id", "score"])

    item_type = pairs.schema.field("item_id").type
    return index.select("doc_ids", "terms", "starts", "docs", "impacts").mapInArrow(score, f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id long, score long")


def ranked_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows."""
    index, n_docs = build_index(docs)
    return search(index, n_docs, benchmark)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANKED_SQL = rf"""
WITH tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM documents) GROUP BY r, term),
len AS (SELECT r, sum(tf)::bigint AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS all_docs, sum(n)::bigint AS all_terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
  sum(q * floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::bigint AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (r), tot GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::integer AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {BEST}
"""
