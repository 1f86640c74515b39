"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

The model is trained on the trusted documents (labels with quality 1) but those held out: one in HELD_OUT, by a hash of the
id. A task counts the n-grams of its texts before they are summed over the cluster. Every n-gram that occurs in any document then gets its probability by joining it with the
counts of its own order and of its context, order by order (the joins are sharded by n-gram, as Spark joins are). Last,
the probabilities go back to the documents. Quantiles of the held-out documents' perplexities, by language, are the
bounds within which a document is kept: they are what good text that the model has not seen scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import claim, discard, give_back, materialize, on_shelf, placed, recorded, shelve, small_batches, utf8
from scorewright.llm.words import batches_of

#: Bytes in an n-gram (7 at most, so that it fits into a long).
ORDER = 5
#: Ids of trusted documents that are broadcast at most (2 million: 16 MB); more are joined by a shuffle.
IDS_SENT = 2_000_000
#: n-grams whose probabilities every worker reads as a whole at most (3 million: 36 MB as a file, 70 MB as a table); with
#: more, blocks of documents are grouped with their own.
GRAMS_READ = 3_000_000
#: Bytes of text that a worker takes at once (its arrays have eight bytes for each), and n-grams of a block that it holds
#: before it merges them.
CHUNK, HELD_ROWS = 400_000, 800_000
#: Documents whose ids fall into one range of this length form a block.
BLOCK = 4_096
#: One in so many trusted documents is held out of the training and gives the bounds instead.
HELD_OUT = 4
#: Quantile of the held-out documents' perplexities by language up to which documents are kept (as a rank, to one in
#: 10,000), and the number of these documents below which a language takes the bound of all languages together.
HIGH, LEAST_TRUSTED = 0.998, 100
#: Languages whose averages and bounds are broadcast at most (a few MB); with more they are joined by a shuffle.
LANGS_SENT = 100_000
#: As many bytes of average trusted text of its language are added to each document, so that chance does not reject short ones.
PRIOR = 100


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, as a number, and the offsets of the texts; zero bytes come first."""
    data, offsets = utf8(texts)
    n, pad = len(offsets) - 1, ORDER - 1
    wide = np.zeros(len(data) + pad * n, np.uint8)
    row = np.repeat(np.arange(1, n + 1), np.diff(offsets))
    at = np.arange(len(data)) + pad * row
    wide[at] = data
    out = np.zeros(len(data), np.int64)
    for j in range(pad, -1, -1):
        out = (out << 8) | wide[at - j]
    return out, offsets


def _counted(df: DataFrame, group: str | None) -> DataFrame:
    """(block, g, c): the n-grams in each task's texts and how often they occur; block is 0 if no group is named."""
    given = df.select((F.coalesce(F.col(group), F.lit(-1)) if group else F.lit(0)).cast("long").alias("block"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality").clear()
        held: dict[int, list] = {}
        rows = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            g, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return g, np.bincount(place, np.concatenate([c for _, c in parts]), len(g)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                g, c = merged(parts)
                for k in range(0, len(g), 100_000):
                    part = g[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part), pa.array(c[k : k + 100_000])], names=["block", "g", "c"])
            held.clear()

        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for start, stop in batches_of(batch.column(1), CHUNK):
                grams, offsets = packed(batch.column(1).slice(start, stop - start))
                own = np.repeat(blocks[start:stop], np.diff(offsets))
                for block in np.unique(blocks[start:stop]).tolist():
                    found = np.sort(grams[own == block])
                    first = np.flatnonzero(np.diff(found, prepend=-1))
                    parts = held.setdefault(block, [])
                    parts.append((found[first], np.diff(first, append=len(found))))
                    rows += len(first)
                    if len(parts) > 40 or sum(len(x) for x, _ in parts[1:]) > HELD_ROWS:
                        rows -= sum(len(x) for x, _ in parts)
                        held[block] = [merged(parts)]
                        rows += len(held[block][0][0])
            if rows > 3 * HELD_ROWS:
                yield from out()
                rows = 0
        yield from out()
        give_back()

    return given.mapInArrow(run, "block long, g long, c long")


def model(trusted: DataFrame) -> list[dict]:
    """Per order, from 1 up: counts (g, c), contexts (h, total, n1, n2, n3) and the three discounts.

    The highest order has the counts of the text, lower ones the number of different bytes that precede the n-gram.
    """
    counts = _counted(trusted, None).groupBy("g").agg(F.sum("c").alias("c"))
    out = []
    for n in range(ORDER, 0, -1):
        counts = materialize(counts, f"counts{n}")
        kinds = [F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]
        n1, n2, n3, n4 = (x or 0 for x in counts.agg(*kinds).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        steps = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        discounts = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(steps, 1)]
        of = [F.sum(x.cast("long")).alias(f"n{k}") for k, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))]
        contexts = counts.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), *of)
        out.append({"n": n, "counts": counts, "contexts": contexts, "discounts": discounts})
        counts = counts.groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    return out[::-1]


def log_probabilities(grams: DataFrame, orders: list[dict]) -> DataFrame:
    """(g, lp): the natural logarithm of the probability of each n-gram's last byte after the bytes before it."""
    known = None
    for order in orders:
        n, (d1, d2, d3) = order["n"], order["discounts"]
        asked = grams.select(F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("g")).distinct() if n < ORDER else grams
        asked = asked.withColumn("h", F.shiftright("g", 8)).join(order["counts"], "g", "left").join(order["contexts"], "h", "left")
        if known is None:
            asked = asked.withColumn("below", F.lit(1 / 256))
        else:
            asked = asked.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            asked = asked.join(known.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
        c, off = F.coalesce("c", F.lit(0)), F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        seen = F.when(c > 0, (c - off) / F.col("total")).otherwise(0.0)
        rest = (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(seen + rest * F.col("below"))
        known = materialize(asked.select("g", p.alias("p")), f"probabilities{n}")
    return known.select("g", F.log("p").cast("float").alias("lp"))


class Lookup:
    """Numbers to values in a few random reads each: a table of at least as many slots as numbers, a second one for what collides, and so on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(len(keys) - 1).bit_length())
            slot = self._slot(keys, bits, len(self.levels))
            table, found = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, values.dtype)
            table[slot] = keys
            placed = table[slot] == keys
            found[slot[placed]] = values[placed]
            self.levels.append((bits, table, found))
            keys, values = keys[~placed], values[~placed]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        spread = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x1000193)
        return (spread >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """The values of numbers that are all there."""
        if not self.levels and len(asked):
            raise KeyError("an n-gram has no probability")
        out = np.zeros(len(asked), self.levels[0][2].dtype if self.levels else np.float32)
        rest = None
        for level, (bits, table, found) in enumerate(self.levels):
            now = asked if rest is None else asked[rest]
            slot = self._slot(now, bits, level)
            good = table[slot] == now
            if rest is None:
                out = np.where(good, found[slot], out)
                rest = np.flatnonzero(~good)
            else:
                out[rest[good]] = found[slot[good]]
                rest = rest[~good]
            if not len(rest):
                return out
        raise KeyError("an n-gram has no probability")


def _lookup(files: list[str]) -> Lookup:
    """The table (g, lp) in these Parquet files of the shared folder, which a worker reads once."""
    from pyarrow import fs, parquet

    key, read = tuple(files), claim("quality")
    if key not in read:
        parts = []
        for file in files:
            system, path = fs.FileSystem.from_uri(file)
            parts.append(parquet.read_table(path, filesystem=system, columns=["g", "lp"]))
        table = pa.concat_tables(parts) if parts else pa.table({"g": pa.array([], pa.int64()), "lp": pa.array([], pa.float32())})
        parts.clear()
        read.clear()
        read[key] = Lookup(table.column("g").to_numpy(), table.column("lp").to_numpy())
        del table
        give_back()
    return read[key]


def _sums(texts: pa.Array, lookup: Lookup) -> list[pa.Array]:
    """The bytes of each text and the sum of their log probabilities."""
    out = []
    for start, stop in batches_of(texts, CHUNK):
        grams, offsets = packed(texts.slice(start, stop - start))
        total = np.concatenate([[0.0], np.cumsum(lookup(grams).astype(np.float64))]) if len(grams) else np.zeros(1)
        lengths = np.diff(offsets)
        out.append((lengths, total[offsets[1:]] - total[offsets[:-1]]))
    return [pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, kind)) for k, kind in ((0, np.int64), (1, np.float64))]


def log_likelihoods(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, trusted, held, n_bytes, lp) of each row of docs: lp is the sum of the log probabilities of its bytes.

    trusted: the model was trained on it; held: it would have been, but is held out. carry names more columns of docs to keep.
    """
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    ids = materialize(ids.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0), "trusted")
    if ids.filter("NOT held").isEmpty():  # so few that none is left to train on
        ids = ids.withColumn("held", F.lit(False))
    if ids.count() <= IDS_SENT:
        ids = F.broadcast(ids)
    # rows without an id are dealt to as many blocks as they would have with one
    nulls = docs.filter("doc_id IS NULL").count() // BLOCK + 1
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), -1 - F.pmod(F.xxhash64("text"), F.lit(nulls))).cast("long").alias("block")
    orders = model(docs.select("doc_id", "text").join(ids.filter("NOT held"), "doc_id", "left_semi"))
    asked = materialize(_counted(docs.select("text", block), "block").select("block", "g"), "grams")
    lp = materialize(log_probabilities(asked.select("g").distinct(), orders), "log-probabilities")
    marked = docs.select("doc_id", "lang", block, *carry, "text").join(ids, "doc_id", "left")
    marked = marked.select("doc_id", "lang", F.coalesce(~F.col("held"), F.lit(False)).alias("trusted"), F.coalesce("held", F.lit(False)).alias("held"), *carry, "text", "block")
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.drop("text", "block").schema)
    names, schema = [*marked.drop("text", "block").columns, "n_bytes", "lp"], f"{own}, n_bytes long, lp double"
    if lp.count() > GRAMS_READ:
        return _by_blocks(marked, asked, lp, names, schema)
    files = lp.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(files)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_sums(batch.column(batch.num_columns - 1), lookup)], names=names)

    return marked.drop("block").mapInArrow(run, schema)


def _by_blocks(marked: DataFrame, asked: DataFrame, lp: DataFrame, names: list[str], schema: str) -> DataFrame:
    """Where the probabilities may not be broadcast: each block of documents meets those of its own n-grams."""
    needed = asked.distinct().join(lp, "g").select("block", "g", "lp")

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        lookup = Lookup(own.column("g").to_numpy(), own.column("lp").to_numpy())
        batches = texts.to_batches()
        found = [pa.RecordBatch.from_arrays([*(x.column(c) for c in names[:-2]), *_sums(x.column("text"), lookup)], names=names) for x in batches]
        return pa.Table.from_batches(found) if found else texts.select(names[:-2]).append_column("n_bytes", pa.array([], pa.int64())).append_column("lp", pa.array([], pa.float64()))

    return marked.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(score, schema)


def _by_language(df: DataFrame, known: DataFrame) -> DataFrame:
    """df with the columns of known (lang, ...) for its language; null is one."""
    known = materialize(known.withColumnRenamed("lang", "its_lang"), "languages")
    known = F.broadcast(known) if known.count() <= LANGS_SENT else known
    return df.join(known, F.col("lang").eqNullSafe(F.col("its_lang")), "left").drop("its_lang")


def _judged(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, score, bound, keep) of the rows with text, and the columns in carry."""
    small_batches(docs.sparkSession)
    with recorded() as made:
        scored = materialize(log_likelihoods(docs, labels, carry), "likelihoods")
    discard(docs.sparkSession, made, scored)
    scored = scored.filter("n_bytes > 0")
    average = (-F.sum("lp") / F.sum("n_bytes")).alias("average")
    trusted = scored.filter("trusted OR held")
    every = trusted.agg(average).first()[0]
    by_lang = trusted.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), average).filter(F.col("n") >= LEAST_TRUSTED).drop("n")
    mean = F.coalesce("average", F.lit(every).cast("double"))
    scored = _by_language(scored, by_lang)
    scored = scored.select("doc_id", "lang", "trusted", "held", "n_bytes", *carry, F.exp(-F.col("lp") / F.col("n_bytes")).alias("perplexity"),
                           F.exp((-F.col("lp") + PRIOR * mean) / (F.col("n_bytes") + PRIOR)).alias("score"))
    held = scored.filter("held")
    bound = F.percentile_approx("score", F.lit(HIGH), F.lit(10_000)).alias("bound")
    every = held.agg(bound).first()[0]
    if every is None:  # too few trusted documents to hold any out
        every = scored.filter("trusted").agg(bound).first()[0]
    by_lang = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), bound).filter(F.col("n") >= LEAST_TRUSTED).drop("n")
    out = _by_language(scored, by_lang).withColumn("bound", F.coalesce("bound", F.lit(every).cast("double")))
    return out.withColumn("keep", F.coalesce(F.col("score") <= F.col("bound"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, score, bound, keep), a row for each row of docs.

    score: the perplexity with PRIOR bytes of the language's average added. keep: it is up to the language's bound (equal is
    kept); where a language (null is one) has fewer than LEAST_TRUSTED trusted documents, or held-out ones, average or bound
    of all languages hold. Null and empty texts have no perplexity and are not kept; with no trusted text at all, every
    other document is. Labels that repeat count once, contradictory ones as trusted. Other columns of docs are ignored.
    """
    names = ["doc_id", "lang", "n_bytes", "perplexity", "score", "bound", "keep"]
    empty = docs.filter("text IS NULL OR text = ''").select("doc_id", "lang", F.lit(0).cast("long").alias("n_bytes"))
    return _judged(docs.select("doc_id", "lang", "text"), labels).select(*names).unionByName(empty.withColumn("keep", F.lit(False)), allowMissingColumns=True)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify keeps, each judged by its own text, also where a doc_id repeats or is null.

    What stays is listed by file and row, and the files are read again: the texts are not written a second time.
    """
    docs = placed(docs)
    with recorded() as made:
        kept = _judged(docs.select("doc_id", "lang", "text", "file__", "row__"), labels, ("file__", "row__")).filter("keep")
        shelf = shelve(kept.select("file__", "row__"), "accepted")
    discard(docs.sparkSession, made, docs, shelf)
    return docs.filter(on_shelf(shelf)("file__", "row__")).drop("file__", "row__")
