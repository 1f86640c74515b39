"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has exactly one last token: the one that ends the encoding of that prefix. A token t that
ends at byte i is that token if it starts where another prefix ends and the pair (last token of that prefix, t) encodes
to itself. Walking the stored last tokens backwards gives the encoding; an append only adds prefixes, and after an edit
the prefixes agree again with the old ones a few bytes behind it.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import claim, give_back, small_batches
from scorewright.llm.words import batches_of

#: Bytes that the remembered pieces of a Python worker take at most, and as many again its words; what an entry takes
#: besides its text and its tokens; the longest text that is remembered.
CACHE_BYTES, ENTRY_BYTES, LONGEST_KEPT = 48 << 20, 190, 64
#: Bytes of text that are encoded before the rows leave the worker.
CHUNK = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks with the pair tests that the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple | None] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The encoding of a short string by its definition: merge the leftmost adjacent pair of lowest rank; at most to stop parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple | None:
        """The parts that are the token's last (and first) while it is merged, each with the rank that ends it.

        None if the token's bytes do not encode to the token.
        """
        if token not in self._edges:
            data = self.bytes_of[token]
            right, left, found = [(data, 1 << 60)], [(data, 1 << 60)], True
            if len(data) > 1:
                halves = self.merged(data, 2)
                found = len(halves) == 2 and all(h in self.ranks and self.edges(self.ranks[h]) for h in halves)
                if found:
                    below = [self._edges[self.ranks[h]] for h in halves]
                    until = lambda part, end: (part, min(end, token))
                    right += [until(*x) for x in below[1][0]]
                    left += [until(*x) for x in below[0][1]]
            self._edges[token] = (right, left) if found else None
        return self._edges[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, one after the other, stay as they are: no merge across the boundary comes in time.

        Of equal merges the leftmost comes first, hence < on the left and <= on the right.
        """
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 150_000:
                self._pairs.clear()
            get, before, after = self.ranks.get, self.edges(left)[0], self.edges(right)
            known = after is not None and not any((rank := get(x + y)) is not None and rank < x_ends and rank <= y_ends for x, x_ends in before for y, y_ends in after[1])
            self._pairs[left, right] = known
        return known


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _grow(self, stop: int) -> None:
        """Store the last tokens of the prefixes up to stop bytes."""
        v, data, last = self.vocabulary, self.data, self.last
        get, pair, fits, edges, longest = v.ranks.get, v._pairs.get, v.fits, v.edges, v.longest
        for end in range(len(last), stop + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):  # only one token fits, and it is seldom a long one
                token = get(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    fit = edges(token)
                elif (fit := pair((last[start], token))) is None:
                    fit = fits(last[start], token)
                if fit:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")

    def become(self, data: bytes) -> None:
        """Go on to another piece; the prefixes that both share stay, so sorted pieces cost little more than what is new in each."""
        old, same = self.data, 0
        for x, y in zip(old, data):
            if x != y:
                break
            same += 1
        del self.last[same + 1 :]
        self.data = data[:same]
        self.append(data[same:])

    def append(self, more: bytes) -> None:
        """Extend the piece; the prefixes before stay."""
        self.data += more
        self._grow(len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in the place of bytes [start, stop); returns how many prefixes were computed anew.

        Once as many successive prefixes as the longest token has bytes are as they were, all later ones are, too:
        each depends on the bytes and last tokens within that reach only.
        """
        old_last, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, done = old_last[: start + 1], 0, 0
        for end in range(start + 1, len(self.data) + 1):
            self._grow(end)
            token, done = self.last[end], done + 1
            before = end - shift
            same = same + 1 if before > stop and old_last[before] == token else 0
            if same >= self.vocabulary.longest and before - stop >= 2 * self.vocabulary.longest:
                self.last += old_last[before + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        """The encoding of the piece."""
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class Pieces(dict):
    """Piece of text to its tokens (as int32 bytes), filled on demand; what comes when it is full is not kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.room = vocabulary, CACHE_BYTES

    def encoded(self, piece: str) -> bytes:
        return array("i", PrefixTable(self.vocabulary, piece.encode()).tokens()).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.encoded(piece)
        if len(piece) <= LONGEST_KEPT and (cost := len(piece) + len(out) + ENTRY_BYTES) <= self.room:
            self.room -= cost
            self[piece] = out
        return out


class Encoder:
    """Encodes texts whose matches of the pattern are encoded one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = cutter(pattern)
        self.pieces = Pieces(Vocabulary(ranks))
        # A match begins wherever a space follows something else than white space, and where one space stands between
        # white space and something else. So texts may be cut before their spaces, unless white space, a space and again
        # white space (or the end) follow one another. This holds for patterns whose matches have a space at their
        # beginning only, or consist of white space.
        self.unclear = re.compile(r"\s (?:\s|\Z)").search
        self.words: dict[str, bytes] = {}
        self.room = CACHE_BYTES
        self.by_words = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" in pattern

    def _learn(self, asked: set[str]) -> dict[str, bytes]:
        """The tokens of a space and the word, for each of these words. Those that are not remembered are taken in order, in one
        table of prefixes that grows and shrinks from word to word."""
        known = self.words
        out = {word: known[word] for word in asked if word in known}
        table = PrefixTable(self.pieces.vocabulary)
        for word in sorted(asked - out.keys()):
            first, *rest = self.find(f" {word}")
            table.become(first.encode())
            ids = array("i", table.tokens()).tobytes()
            out[word] = ids = b"".join([ids, *map(self.pieces.__getitem__, rest)]) if rest else ids
            if len(word) <= LONGEST_KEPT and (cost := len(word) + len(ids) + ENTRY_BYTES) <= self.room:
                self.room -= cost
                known[word] = ids
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        cut = [None if not text or not self.by_words or self.unclear(text) else text.split(" ") for text in texts]
        of = self._learn({word for words in cut if words for word in words[1:]}).__getitem__
        piece = self.pieces.__getitem__
        return [
            b"".join([*map(piece, self.find(words[0])), *map(of, words[1:])]) if words else b"".join(map(piece, self.find(text))) if text else b""
            for text, words in zip(texts, cut)
        ]

    def __call__(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """This Python worker's encoder for these ranks, with what it remembers from earlier tasks."""
    known, key = claim("bpe"), (pattern, len(ranks), next(reversed(ranks)))
    if key not in known:
        known.clear()
        known[key] = Encoder(ranks, pattern)
    return known[key]


def cutter(pattern: str):
    """findall of the pattern. The classes \\p{L} and \\p{N} become ranges of code points, which `re` searches several times faster than `regex`."""
    classes = {"L": [], "N": []}
    for kind, ranges in classes.items():
        start = None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # the White_Space property
    inside = {r"\p{L}": "".join(classes["L"]), r"\p{N}": "".join(classes["N"]), r"\s": space}
    out = ""
    depth = False
    for token in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        depth = (depth or token == "[") and token != "]"
        if token == r"\S":
            out += f"[^{space}]"
        else:
            out += inside[token] if depth and token in inside else f"[{inside[token]}]" if token in inside else token
    return re.compile(out).findall


def _int_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """df without its text, with the token ids (array<int>) of the whole text in out.

    The text is cut by pattern and each match is encoded separately, without special tokens. Null and empty texts give
    an empty array; other columns, repeated rows and their number stay as they are; a former column named out goes. With
    decoded, the ids are decoded again in the same pass, into a column (binary) of that name.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # bounded by the vocabulary file
    rest = [c for c in df.columns if c not in (text, out, decoded)]
    given = df.select(*rest, F.col(text).alias(f"{text}__in"))
    more = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    schema = T.StructType([*given.drop(f"{text}__in").schema, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value, pattern)
        token = ids_of.pieces.vocabulary.bytes_of.__getitem__
        for batch in batches:
            for start, stop in batches_of(batch.column(batch.num_columns - 1), CHUNK):
                part = batch.slice(start, stop - start)
                rows = ids_of.encode_all(part.column(part.num_columns - 1).to_pylist())
                columns = [*part.columns[:-1], _int_lists(rows)]
                if decoded:
                    columns.append(pa.array([b"".join(map(token, np.frombuffer(r, np.int32).tolist())) for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return given.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes (binary) of the token ids in out; null ids give empty bytes, an unknown id is an error."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = df.drop(out)
    names = kept.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: data for data, rank in shared.value.items()}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                column = part.column(at)
                flat = list(map(token.__getitem__, column.flatten().to_pylist()))
                ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
                data = [b"".join(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(out, T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """Per document the number of tokens and the digests of ids and decoded bytes, in the JVM."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """The contract's rows for a table with doc_id and text: encodes, decodes, digests."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded"))
