"""Token-id matrices: documents packed into rows of fixed length by best fit decreasing.

Each task packs the documents of its own partition, so no token is shuffled. The rows' free space is kept in a segment
tree over capacities: the tightest row that still holds a piece is found in O(log length).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scorewright.llm.common import scratch

#: Tokens in a row of the matrix, and tokens after which a task begins another shard.
LENGTH, SHARD_TOKENS = 2048, 4_000_000


class Capacities:
    """A segment tree over the free space 0..length of rows: how many rows have it; finds the least that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, space: int, by: int) -> None:
        node = space + self.size
        while node:
            self.count[node] += by
            node //= 2

    def put(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (row, space) with the least space >= need; of equals the row put last."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.size
        self._add(space, -1)
        return self.rows[space].pop(), space


def best_fit_decreasing(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For pieces of 1..length tokens their rows and their places in them, and the number of rows."""
    rows, places, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    free = Capacities(length)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = free.take(need)
        row, space = found if found else (n, length)
        n += not found
        rows[piece], places[piece] = row, length - space
        free.put(row, space - need)
    return rows, places, n


def pack_shard(ids: list[np.ndarray], length: int, pad: int) -> dict[str, np.ndarray]:
    """A packed shard of documents: matrix (rows, length), cu_seqlens (starts of all segments and the end, row after row,
    padding as a segment), resets (places in the flattened matrix where positions begin at 0), and the pieces: doc (index),
    piece, row, place, n. Documents longer than a row are cut into rows' lengths; empty ones have no piece."""
    doc = np.concatenate([np.full(-(-len(x) // length), k) for k, x in enumerate(ids)] or [np.zeros(0)]).astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(ids)))
    piece = np.arange(len(doc)) - first[doc]
    total = np.array([len(x) for x in ids], np.int64)
    n = np.minimum(length, total[doc] - piece * length)
    row, place, rows = best_fit_decreasing(n, length)
    matrix = np.full((rows, length), pad, np.int32)
    for k in range(len(doc)):
        start = piece[k] * length
        matrix[row[k], place[k] : place[k] + n[k]] = ids[doc[k]][start : start + n[k]]
    used = np.bincount(row, n, rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    starts = np.sort(np.concatenate([row * length + place, (np.arange(rows) * length + used)[used < length]]))
    return {"matrix": matrix, "cu_seqlens": np.append(starts, rows * length), "resets": starts, "doc": doc, "piece": piece, "row": row, "place": place, "n": n}


def positions(shard_resets: np.ndarray, cells: int) -> np.ndarray:
    """The position id of each cell: the distance from the last reset."""
    at = np.arange(cells)
    return at - shard_resets[np.searchsorted(shard_resets, at, "right") - 1] if cells else at


def _write(where: str, name: str, array: np.ndarray) -> None:
    """An array as .npy under where, complete or not at all: attempts of a task write the same bytes to names of their own."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(where)
    system.create_dir(path, recursive=True)
    buffer = io.BytesIO()
    np.save(buffer, array)
    attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(attempt) as f:
        f.write(buffer.getbuffer())
    system.move(attempt, f"{path}/{name}")


def read_array(where: str, name: str) -> np.ndarray:
    """An array that was written by pack."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(where)
    with system.open_input_stream(f"{path}/{name}") as f:
        return np.load(io.BytesIO(f.read()))


def pack(encoded: DataFrame, where: str, vocabulary: int, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """Writes packed shards of encoded (doc_id, ids array<int>) under the folder `where` (a URL that all executors reach).

    Shard s has s.ids.npy (rows x length, uint16 if the vocabulary allows, else uint32), s.cu_seqlens.npy and s.resets.npy
    (int64). Returns one row per piece: doc_id, doc (number in the shard), shard, piece, row, place, n; a document without
    tokens (null or empty ids) has one row of n = 0 with null row and place. Repeated and null doc_ids are documents like
    others. Shards are named by partition and number, so a task that runs again replaces its own files by equal ones.
    """
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    names = ["doc_id", "doc", "shard", "piece", "row", "place", "n"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        keys, ids, held = [], [], 0
        for batch in batches:
            column = batch.column(1)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for key, end, n in zip(batch.column(0).to_pylist(), ends.tolist(), lengths.tolist()):
                keys.append(key)
                ids.append(flat[end - n : end].astype(kind))
                held += n
                if held >= SHARD_TOKENS:
                    yield keys, ids
                    keys, ids, held = [], [], 0
        if keys:
            yield keys, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (keys, ids) in enumerate(shards(batches)):
            name, got = f"{part:06d}-{k:04d}", pack_shard(ids, length, pad)
            _write(where, f"{name}.ids.npy", got["matrix"].astype(kind))
            _write(where, f"{name}.cu_seqlens.npy", got["cu_seqlens"].astype(np.int64))
            _write(where, f"{name}.resets.npy", got["resets"].astype(np.int64))
            keys = pa.array(keys, pa.int64())
            columns = [keys.take(pa.array(got["doc"])), pa.array(got["doc"]), pa.array([name] * len(got["doc"])), *(pa.array(got[c].astype(np.int64)) for c in names[3:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            empty = np.flatnonzero([not len(x) for x in ids])
            if len(empty):
                zero, none = pa.array(np.zeros(len(empty), np.int64)), pa.nulls(len(empty), pa.int64())
                columns = [keys.take(pa.array(empty)), pa.array(empty), pa.array([name] * len(empty)), zero, none, none, zero]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    given = encoded.select("doc_id", "ids")
    return given.mapInArrow(run, "doc_id long, doc long, shard string, piece long, row long, place long, n long")


def library_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) by the tiktoken library, for rank files; null texts have no ids."""
    from scorewright.llm.bpe import read_ranks

    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_to_numpy
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = [encode(x, disallowed_special=()) if x else np.zeros(0, np.uint32) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def packed_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Encodes and packs doc_id and text, with places written in the shared folder: the index of all pieces."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        vocabulary = sum(1 for _ in f)
    encoded = library_ids(docs, path, public_tokenizers.PATTERN)
    return pack(encoded, scratch(docs.sparkSession, "packed"), vocabulary, length)
