"""Exact substring deduplication with suffix arrays in a logarithmic family.

Suffixes are sampled: each 100-byte window has an anchor, the leftmost of the least 24-byte fingerprints in it, so equal
windows have equal anchors at equal places. Successive windows with one anchor are a stretch.

1. Stretches meet by anchor and content. All but the first of equal stretches are repeats. Stretches of an anchor that
   occurs with one content only cannot share a window with any other.
2. The first of each content of the other anchors go on with their bytes. In each partition of the anchors they come in
   document order, a batch at a time: the batch's windows (suffixes cut at 100 bytes) are sorted into a suffix array,
   which is merge-scanned against the levels of the family for equal windows and then becomes a level; levels of about
   equal size merge, so there are logarithmically many. Suffixes are ordered by the fingerprint of their 100 bytes, as
   only equality of these counts. Anchors with very many contents have their windows counted by Spark instead, one by one.
3. The repeats are removed from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import free_shuffles, materialize, utf8
from scorewright.llm.words import batches_of, mixed

#: Bytes in a window, and in an anchor's fingerprint.
LENGTH, GRAM = 100, 24
#: Contents of an anchor beyond which its windows are not compared in one task; rows that such a task gets at most, about.
HOT, PART_ROWS = 100_000, 500_000
_CHUNK = 1_000_000
_BASE, _MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 20) - 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            out = np.full(max(n, _CHUNK + 200_000), base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _prefixes(data: np.ndarray) -> np.ndarray:
    """Sums from which the fingerprint of any substring follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data))[0], out=out[1:])
    return out


def _print_of(prefixes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mixed((prefixes[stop] - prefixes[start]) * _powers(len(prefixes))[1][start])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, n, anchor, content) of the stretches in texts of up to 2^20 bytes in all: the text, the first of n
    windows, the fingerprints of the anchor and of all bytes of the windows with the anchor's place."""
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefixes = _prefixes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _print_of(prefixes, at, at + GRAM)
    least = (grams & ~_MASK) | at.astype(np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: windows], least[span - width : span - width + windows])
    inside = np.arange(windows) + LENGTH <= np.repeat(offsets[1:], np.diff(offsets))[:windows]
    place = np.flatnonzero(inside)
    anchor = (least[place] & _MASK).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    n = np.diff(first, append=len(anchor))
    start, anchor = place[first], anchor[first]
    content = _print_of(prefixes, start, start + n - 1 + LENGTH) + (anchor - start).astype(np.uint64) * np.uint64(1021) + n.astype(np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], n, grams[anchor], content


def long_stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of one text longer than a chunk: chunks overlap, and each gives the stretches that begin in its own part,
    which it sees as a whole."""
    parts, reach = [], 4 * LENGTH
    for begin in range(0, max(1, len(data) - LENGTH + 1), _CHUNK - 2 * reach):
        low, high = max(0, begin - reach), min(len(data), begin + _CHUNK - reach)
        _, start, n, anchor, content = stretches(data[low:high], np.array([0, high - low]))
        end_of_text, start = high == len(data), start + low
        whole = ((start >= begin) | (low == 0)) & (end_of_text | (start < begin + _CHUNK - 2 * reach))
        parts.append((np.zeros(whole.sum(), np.int64), start[whole], n[whole], anchor[whole], content[whole]))
        if end_of_text:
            break
    return tuple(np.concatenate(x) for x in zip(*parts))


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, sub, text): doc is the id (the greatest number for null); sub tells rows of the same doc apart, 0 if there are none,
    which is the second value."""
    n, different = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    doc = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc")
    sub = F.lit(0).cast("long") if n == different else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(doc, sub.alias("sub"), "text"), n == different


def _sketch(keyed: DataFrame) -> DataFrame:
    """(g, c, doc, sub, start, n, dup) of all stretches; dup: an equal one of the same batch comes earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sub = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for begin, end in batches_of(batch.column(2), _CHUNK):
                data, offsets = utf8(batch.column(2).slice(begin, end - begin))
                row, start, n, g, c = stretches(data, offsets) if len(data) < 1 << 20 else long_stretches(data)
                parts.append((doc[begin + row], sub[begin + row], start, n, g, c))
            d, s, start, n, g, c = map(np.concatenate, zip(*parts))
            order = np.argsort(c)
            same = np.diff(c[order], prepend=c[order][:1] + np.uint64(1)) == 0
            group = np.cumsum(~same)
            many = np.flatnonzero(np.bincount(group, minlength=len(group) + 1)[group] > 1)
            rows, group = order[many], group[many]
            ranked = np.lexsort((start[rows], s[rows], d[rows], g[rows], group))
            rows, group = rows[ranked], group[ranked]
            later = np.zeros(len(rows), bool)
            later[1:] = (group[1:] == group[:-1]) & (g[rows[1:]] == g[rows[:-1]])
            dup = np.zeros(len(c), bool)
            dup[rows[later]] = True
            g = np.where(dup, mixed(d.astype(np.uint64) + start.astype(np.uint64)), g)  # dups only pass: spread them
            for k in range(0, len(c), 100_000):
                cut = slice(k, k + 100_000)
                columns = [g[cut].view(np.int64), c[cut].view(np.int64), d[cut], s[cut], start[cut].astype(np.int32), n[cut].astype(np.int16), dup[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "c", "doc", "sub", "start", "n", "dup"])

    return keyed.mapInArrow(run, "g long, c long, doc long, sub long, start int, n short, dup boolean")


def _meet(sketch: DataFrame, parts: int) -> DataFrame:
    """(g, doc, sub, start, n, dup): the repeats, and with dup = false the first of each content of anchors with several."""
    names = ["g", "c", "doc", "sub", "start", "n", "dup"]
    given = sketch.repartition(parts, "g").sortWithinPartitions("g", "c", "doc", "sub", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, dup: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("g", "doc", "sub", "start", "n")), pa.array(np.full(rows.num_rows, dup))], names=["g", "doc", "sub", "start", "n", "dup"])

        held, held_new, last = None, True, (None, None)  # the last first-of-its-content; whether its anchor began there
        for batch in batches:
            old = np.asarray(batch.column(6))
            yield out(batch.filter(pa.array(old)), True)
            batch = batch.filter(pa.array(~old))
            if not batch.num_rows:
                continue
            g, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new_g = np.ones(len(g), bool)
            new_g[1:] = g[1:] != g[:-1]
            new_c = new_g.copy()
            new_c[1:] |= c[1:] != c[:-1]
            if last[0] is not None and g[0] == last[0]:
                new_g[0] = False
                new_c[0] = c[0] != last[1]
            last = (g[-1], c[-1])
            yield out(batch.filter(pa.array(~new_c)), True)
            firsts, begins = batch.filter(pa.array(new_c)), new_g[new_c]
            if not firsts.num_rows:
                continue
            if held is not None:
                if not (held_new and begins[0]):
                    yield out(held, False)
            several = ~begins
            several[:-1] |= ~begins[1:]
            yield out(firsts.slice(0, firsts.num_rows - 1).filter(pa.array(several[:-1])), False)
            held, held_new = firsts.slice(firsts.num_rows - 1), bool(begins[-1])
        if held is not None and not held_new:
            yield out(held, False)

    return given.select(names).mapInArrow(run, "g long, doc long, sub long, start int, n short, dup boolean")


class Family:
    """Levels of sorted window fingerprints, each at least twice as long as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def known(self, found: np.ndarray) -> np.ndarray:
        """Which of the fingerprints some level has."""
        out = np.zeros(len(found), bool)
        for level in self.levels:
            place = np.minimum(np.searchsorted(level, found), len(level) - 1)
            out |= level[place] == found
        return out

    def add(self, level: np.ndarray) -> None:
        """A new level of sorted fingerprints that none has; levels not twice as long as it are merged with it."""
        while self.levels and len(self.levels[-1]) < 2 * len(level):
            level = np.concatenate([self.levels.pop(), level])
            level.sort(kind="stable")  # merges the two runs
        if len(level):
            self.levels.append(level)


def _windows(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with g and bytes: the row, the place and the fingerprint of each window."""
    data, offsets = utf8(rows.column("bytes"))
    prefixes = _prefixes(data)
    n = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(rows.num_rows), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + place
    g = rows.column("g").to_numpy().view(np.uint64)
    return row, place, mixed(_print_of(prefixes, start, start + LENGTH) + g[row])


def _compare(contents: DataFrame, parts: int) -> DataFrame:
    """(doc, sub, start, n): the windows of the contents (g, doc, sub, start, bytes) that an earlier content has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            for k in range(0, batch.num_rows, 4_000):
                part = batch.slice(k, 4_000)
                row, place, found = _windows(part)
                array, first = np.unique(found, return_index=True)  # the batch's suffix array; first in document order
                old = family.known(array)
                repeat = np.ones(len(found), bool)
                repeat[first[~old]] = False
                family.add(array[~old])
                edge = np.diff(np.concatenate([[0], repeat.view(np.int8), [0]]))
                # runs of repeats within a row
                cut = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
                begin = np.flatnonzero(repeat & ((edge[:-1] == 1) | cut))
                stop = np.flatnonzero(repeat & ((edge[1:] == -1) | np.concatenate([cut[1:], [True]]))) if len(row) else begin
                rows = pa.array(row[begin])
                start = part.column("start").take(rows).to_numpy() + place[begin]
                columns = [part.column("doc").take(rows), part.column("sub").take(rows), pa.array(start.astype(np.int32)), pa.array((stop - begin + 1).astype(np.int16))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "sub", "start", "n"])

    given = contents.repartition(parts, "g").sortWithinPartitions("doc", "sub", "start")
    return given.select("g", "doc", "sub", "start", "bytes").mapInArrow(run, "doc long, sub long, start int, n short")


def _compare_hot(contents: DataFrame) -> DataFrame:
    """The same by a table of all windows: for anchors that would not fit into one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4_000):
                part = batch.slice(k, 4_000)
                row, place, found = _windows(part)
                rows = pa.array(row)
                start = part.column("start").take(rows).to_numpy() + place
                columns = [pa.array(found.view(np.int64)), part.column("doc").take(rows), part.column("sub").take(rows), pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "doc", "sub", "start"])

    rows = materialize(contents.select("g", "doc", "sub", "start", "bytes").mapInArrow(run, "h long, doc long, sub long, start int"), "windows")
    first = rows.groupBy("h").agg(F.min(F.struct("doc", "sub", "start")).alias("first"))
    later = rows.join(first, "h").filter(F.struct("doc", "sub", "start") > F.col("first"))
    return later.select("doc", "sub", "start", F.lit(1).cast("short").alias("n"))


def _contents(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (g, doc, sub, start, n) with the bytes of their windows."""
    lists = wanted.groupBy("doc", "sub").agg(F.collect_list(F.struct("g", "start", "n")).alias("asked"))
    joined = keyed.join(lists, ["doc", "sub"]).select("doc", "sub", F.col("text").cast("binary").alias("raw"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 300):
                part = batch.slice(k, 300)
                asked = part.column(3)
                flat = asked.flatten()
                row = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
                g, start, n = (flat.field(j) for j in range(3))
                data, offsets = utf8(part.column(2))
                whole = memoryview(data)
                at = offsets[row] + start.to_numpy()
                found = [bytes(whole[a:b]) for a, b in zip(at.tolist(), (at + n.to_numpy() - 1 + LENGTH).tolist())]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([g, part.column(0).take(rows), part.column(1).take(rows), start, pa.array(found, pa.binary())], names=["g", "doc", "sub", "start", "bytes"])

    return joined.mapInArrow(run, "g long, doc long, sub long, start int, bytes binary")


def removed(data: bytes, packed: np.ndarray) -> np.ndarray:
    """Which bytes lie in the windows given as start * 1024 + n."""
    start, n = packed >> 10, packed & 1023
    steps = np.zeros(len(data) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + n - 1 + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text (null: empty) without the bytes that repeat 100 bytes or more from an earlier place.

    Places are ordered by doc_id (null last), then by where they start; strings are judged on the input. spans are the
    removed runs (start, end in bytes), kept the other bytes, which need not be valid UTF-8. Rows with the same doc_id and
    text are one document and give equal rows; those with the same doc_id and different texts are ordered by a hash of
    their texts. Other columns are ignored.
    """
    spark = docs.sparkSession
    keyed, unique = _keyed(docs)
    once = keyed if unique else keyed.dropDuplicates(["doc", "sub"])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), once.rdd.getNumPartitions())
    met = materialize(_meet(_sketch(once), parts), "stretches")
    free_shuffles(spark)
    wanted = met.filter("NOT dup").drop("dup")
    per = wanted.groupBy("g").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") > HOT)
    hot = materialize(per.select("g"), "hot")  # at most one in HOT rows
    contents = _contents(once, wanted)
    parts = max(parts, wanted.count() // PART_ROWS)
    if hot.isEmpty():
        again = _compare(contents, parts)
    else:
        contents = materialize(contents, "contents")
        again = _compare(contents.join(hot, "g", "left_anti"), parts).union(_compare_hot(contents.join(hot, "g", "left_semi")))
    again = materialize(again, "windows")
    free_shuffles(spark)
    runs = met.filter("dup").select("doc", "sub", "start", "n").union(again)
    packed = F.col("start").cast("long") * 1024 + F.col("n")
    lists = runs.select("doc", "sub", packed.alias("run")).groupBy("doc", "sub").agg(F.collect_list("run").alias("runs"))
    texts = keyed.withColumn("doc_id", F.when(F.col("doc") < 2**63 - 1, F.col("doc"))).withColumn("raw", F.col("text").cast("binary"))
    joined = texts.join(lists, ["doc", "sub"], "left").select("doc_id", "raw", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 300):
                part, sizes, spans, kept = batch.slice(k, 300), [], [], []
                for raw, runs in zip(part.column(1), part.column(2)):
                    data = raw.as_py() or b""
                    sizes.append(len(data))
                    if runs.is_valid and len(runs.values):
                        gone = removed(data, runs.values.to_numpy())
                        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                        spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                        kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                    else:
                        spans.append([])
                        kept.append(data)
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


REPORT_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p - 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS p FROM h)),
d AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM d)),
r AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS since FROM r),
o AS (SELECT k.doc_id, sum(e - s)::bigint AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since - 1, 2 * (s - since)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) - 1) AS kept FROM k JOIN h USING (doc_id) GROUP BY k.doc_id)
SELECT h.doc_id, n::bigint AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN o USING (doc_id)
"""
