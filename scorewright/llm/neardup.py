"""Near-duplicate classes by ProbMinHash over five-word shingles.

Each different shingle of a document sends a Poisson process of arrivals; every arrival picks one of the registers, which
keeps its earliest arrival. A process ends once it is later than every register's. All rates are 1, however often a shingle
is repeated, so two documents agree in a register with the Jaccard similarity of their shingle sets, by which links are
defined. Documents that agree in all registers of a band are candidates; candidates are links if the Jaccard similarity of
their shingle sets is at least 0.8, and classes are the connected components of the links.

Candidates are not all pairs of a band's bucket. In rounds, a hub is compared with the rest of its bucket: the member that
meets most others over all bands, so in a group of near copies the text that they come from; then the most popular of
those still apart. Members that the links found so far already connect need no comparison. What is still apart when a round
finds no more links, such as many documents that share a passage, is joined exactly by the rarest of their shingles: two
sets of this similarity share one among the first fifth of each (prefix and position filter), or they are not similar. The
pairs of that join are compared as they are; only hub pairs are first pruned by their registers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import discard, forget, free_shuffles, give_back, materialize, on_shelf, placed, recorded, shelve, small_batches
from scorewright.llm.components import components
from scorewright.llm.words import batches_of, grams, mixed, word_hashes

#: Words in a shingle; bands; registers in a band. At 0.8, (1 - 0.8^4)^24 = 3e-6 of the pairs are missed.
WORDS, BANDS, ROWS = 5, 24, 4
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
#: Rounds at most in which one hub of a bucket is compared with the rest, before the exact join of what is left.
HUB_ROUNDS = 8
#: Part of a round's pairs that must be similar for another round; below it the exact join takes over.
WORTH = 0.05
#: Ids that are broadcast at most (2 million: 16 MB) to filter the sketches; with more they are joined by a shuffle.
IDS_SENT = 2_000_000
#: Registers that agree in a hub pair that is worth an exact comparison: at 0.8, 4.8 deviations below what is expected.
AGREE = 58


def prob_minhash(shingles: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """uint64 (n_rows, registers): the shingle with the earliest arrival in each register."""
    earliest = np.full(n_rows * registers, np.inf)
    first = np.zeros(n_rows * registers, np.uint64)
    at, step = np.zeros(len(shingles)), 0
    while len(shingles):
        step += 1
        draw = mixed(shingles + np.uint64(step * 0xA0761D6478BD642F % 2**64))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        cell = row * registers + (mixed(draw ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, cell, at)
        won = earliest[cell] == at
        first[cell[won]] = shingles[won]
        rows, place = np.unique(row, return_inverse=True)
        going = at < earliest.reshape(n_rows, registers)[rows].max(1)[place]
        shingles, row, weight, at = shingles[going], row[going], weight[going], at[going]
    return first.reshape(n_rows, registers)


def sketches(docs: DataFrame) -> DataFrame:
    """Of each row with words the columns but text, and words_key, n, bands, registers, shingles; words_key is a digest of its words in their order.

    A text of fewer than five words has one shingle, of them all. shingles are the sorted upper 32 bits of the different
    shingle hashes: two sets of a thousand have 0.0002 false common elements on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in batches_of(batch.column(0)):
                yield one(batch.slice(start, stop - start))
        give_back()

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = word_hashes(part.column(0))
        all_grams = grams(hashes, WORDS)
        rows = np.flatnonzero(np.diff(offsets))
        keys, sets, found = [], [], []
        for k in rows.tolist():
            a, b = int(offsets[k]), int(offsets[k + 1])
            keys.append(xxhash.xxh3_128_digest(hashes[a:b].tobytes()))
            got = all_grams[a : b - WORDS + 1] if b - a >= WORDS else grams(hashes[a:b], b - a)
            got = np.unique(got)
            found.append(got)
            sets.append(np.unique((got >> np.uint64(32)).astype(np.uint32)).tobytes())
        n = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found or [np.zeros(0, np.uint64)])
        first = prob_minhash(flat, np.repeat(np.arange(len(rows)), n), np.ones(len(flat)), len(rows), BANDS * ROWS)
        bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(rows), BANDS)).copy()
        for j in range(ROWS):
            bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + first.reshape(len(rows), BANDS, ROWS)[:, :, j])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
        registers = [x.tobytes() for x in (first >> np.uint64(56)).astype(np.uint8)]  # a byte each: enough to tell whether they agree
        own = [part.column(k).take(pa.array(rows)) for k in range(1, part.num_columns)]
        columns = [*own, pa.array(keys, pa.binary()), pa.array([len(x) // 4 for x in sets], pa.int32()), lists, pa.array(registers, pa.binary()), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    others = docs.drop("text")
    names = [*others.columns, "words_key", "n", "bands", "registers", "shingles"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema), "words_key binary, n int, bands array<long>, registers binary, shingles binary"])
    return docs.select("text", *others.columns).mapInArrow(run, schema)


def _with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, of_a, of_b): the pairs with a column of both. Rows of table that no pair needs are dropped before any shuffle."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= IDS_SENT else ids
    table = table.join(ids, "id", "left_semi").select("id", column)
    one = pairs.join(table.select(F.col("id").alias("a"), F.col(column).alias("of_a")), "a")
    return one.join(table.select(F.col("id").alias("b"), F.col(column).alias("of_b")), "b").select("a", "b", "of_a", "of_b")


def _filtered(rows: DataFrame, test) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def probable(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in at least AGREE registers."""
    count = lambda x, y: int(np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) >= AGREE
    return _filtered(_with(pairs, sketch, "registers"), count)


def similar(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILAR."""
    up, down = SIMILAR

    def test(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return down * both >= up * (len(x) + len(y) - both)

    return _filtered(_with(pairs, sketch, "shingles"), test)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (id, other) as (a, b), a < b, each once."""
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def hub_pairs(members: DataFrame, first: bool) -> DataFrame:
    """(id, other): in each bucket with several labels the hub and the members of other labels.

    The hub is the most popular member, later the most popular one without the bucket's most frequent label.
    """
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n_label"), F.max(F.struct("popular", (-F.col("id")).alias("minus"))).alias("best"))
    most = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n_label", (-F.col("label")).alias("minus"))).alias("main")).filter("labels > 1")
    hub = per.join(most, "bucket")
    if not first:
        hub = hub.filter("label <> -main.minus")
    hub = hub.groupBy("bucket").agg(F.max(F.struct("best.popular", "best.minus", "label")).alias("hub"))
    hub = hub.select("bucket", (-F.col("hub.minus")).alias("other"), F.col("hub.label").alias("other_label"))
    return members.join(hub, "bucket").filter("label <> other_label").select("id", "other")


def apart(members: DataFrame) -> DataFrame:
    """(id, label, minor) of the members of buckets with several labels; minor: not of the most frequent label in one of them."""
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n_label"))
    most = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n_label", (-F.col("label")).alias("minus"))).alias("main")).filter("labels > 1")
    j = members.join(most, "bucket").select("id", "label", (F.col("label") != -F.col("main.minus")).alias("minor"))
    return j.groupBy("id", "label").agg(F.bool_or("minor").alias("minor"))


def prefix_pairs(left: DataFrame, sketch: DataFrame) -> DataFrame:
    """(id, other) among `left` (id, label, minor), one of them minor and of different labels, that can be similar at all."""
    up, down = SIMILAR
    sets = sketch.select("id", "n", "shingles").join(left, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(1)]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(np.concatenate(sets).astype(np.int64))], names=["id", "token"])

    tokens = materialize(sets.select("id", "shingles").mapInArrow(run, "id long, token long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = tokens.join(shared, "token")
    # tokens of one document only come first in its order: they fill the prefix, but meet nothing
    order = Window.partitionBy("id").orderBy("df", "token")
    ranked = common.withColumn("place", F.row_number().over(order))
    many = common.groupBy("id").agg(F.count(F.lit(1)).alias("n_common"))
    about = sets.select("id", "n", "label", "minor").join(many, "id").filter(F.col("n_common") * down >= F.col("n") * up)
    prefix = ranked.join(about, "id").withColumn("place", F.col("place") + F.col("n") - F.col("n_common"))
    prefix = prefix.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(up / down) - 1e-9) + 1)
    prefix = materialize(prefix.select("token", "id", "n", "label", "minor", "place"), "prefix")
    x = prefix.filter("minor").toDF("token", "id", "n", "label", "minor", "place")
    y = prefix.toDF("token", "other", "n_other", "label_other", "minor_other", "place_other")
    reach = 1 + F.least(F.col("n") - F.col("place"), F.col("n_other") - F.col("place_other"))
    enough = reach * (up + down) >= up * (F.col("n") + F.col("n_other"))
    return x.join(y, "token").filter((F.col("label") != F.col("label_other")) & enough & (~F.col("minor_other") | (F.col("id") < F.col("other")))).select("id", "other")


def class_labels(drafts: DataFrame, copies: DataFrame) -> DataFrame | None:
    """(id, label) of the different texts that are not the least of their class; None if no two are candidates.

    drafts are sketches with an `id`, copies has the least id (`rep`) of each words_key. Tables that are done with are
    deleted at once.
    """
    spark, sketch = drafts.sparkSession, drafts
    reps = copies.select(F.col("words_key").alias("key"), "rep").join(sketch.select("id", "words_key", "bands"), (F.col("words_key") == F.col("key")) & (F.col("id") == F.col("rep")))
    bands = materialize(reps.select("id", F.explode("bands").alias("bucket")).distinct(), "bands")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = bands.join(shared, "bucket")
    popular = members.groupBy("id").agg(F.sum("size").alias("popular"))
    members = materialize(members.join(popular, "id").select("bucket", "id", "popular", F.col("id").alias("label")), "members")
    forget(bands)
    free_shuffles(spark)

    links = None

    def add(pairs: DataFrame, prune: bool = True) -> tuple[int, int]:
        """Adds the similar ones to the links; how many pairs there were, and how many of them are similar."""
        nonlocal links
        pairs = materialize(_ordered(pairs), "pairs")
        likely = materialize(probable(pairs, sketch), "probable") if prune else pairs
        found = materialize(similar(likely, sketch), "similar")
        links = found if links is None else links.union(found)
        counts = pairs.count(), found.count()
        for table in {id(x): x for x in (pairs, likely)}.values():
            forget(table)
        return counts

    for step in range(HUB_ROUNDS):
        compared, found = add(hub_pairs(members, step == 0))
        if found <= compared * WORTH:
            break
        known = components(links).withColumnRenamed("label", "now")
        old, members = members, materialize(members.join(known, "id", "left").select("bucket", "id", "popular", F.coalesce("now", "id").alias("label")), "members")
        forget(old)
        free_shuffles(spark)
    left = materialize(apart(members), "apart")
    forget(members)
    if not left.isEmpty():
        add(prefix_pairs(left, sketch), prune=False)
    free_shuffles(spark)
    return None if links is None else components(links)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id), a row for each row of docs; class_id is the least doc_id of the class.

    Rows with the same words in the same order are copies and in one class. A text without words (null, empty) is in a
    class of its own, and so is a row with a null doc_id, whose class is null. Rows of the same doc_id with different texts
    count as one document with all of them. Other columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    drafts = materialize(sketches(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")), "sketch")
    copies = materialize(drafts.groupBy("words_key").agg(F.min("id").alias("rep")), "copies")
    labels = class_labels(drafts, copies)
    own = drafts.select("id", "words_key").join(copies, "words_key").select(F.col("id").alias("doc_id"), "rep")
    own = own.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id")) if labels is not None else own.withColumnRenamed("rep", "class_id")
    own = own.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates: that with the least doc_id (null is greater than all), the first by
    place of those that share it.

    Every row is a document of its own here, also where a doc_id repeats or is null. Rows without words (null, empty) have
    no near duplicates and stay. No text is shuffled: what stays is listed by file, and the files are read again.
    """
    small_batches(docs.sparkSession)
    docs = placed(docs)
    with recorded() as made:
        own = sketches(docs.select("doc_id", "file__", "row__", "text")).withColumn("id", F.monotonically_increasing_id())
        drafts = materialize(own, "sketch")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file__", "row__"))
        copies = materialize(drafts.groupBy("words_key").agg(F.min("id").alias("rep"), first.alias("first")), "copies")
        labels = class_labels(drafts, copies)
        texts = copies.select("rep", "first")
        if labels is not None:
            texts = texts.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("label", "rep"))
        kept = texts.groupBy("rep").agg(F.min("first").alias("first")).select("first.file__", "first.row__")
        shelf = shelve(kept, "kept")
    discard(docs.sparkSession, made, docs, shelf)
    stays = on_shelf(shelf)
    wordless = F.coalesce(~F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(True))
    return docs.filter(wordless | stays("file__", "row__")).drop("file__", "row__")
