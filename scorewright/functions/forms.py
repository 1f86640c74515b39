"""Normal forms of texts that remember where each of their characters comes from."""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORM = T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
_TAG = re.compile(r"<[^>]+>")


def bare(text: str) -> str:
    """Entities as characters, tags as line ends."""
    return _TAG.sub("\n", html.unescape(text))


def _form(text: str) -> tuple[str, array]:
    out, at, space = [], array("i"), None
    for i, c in enumerate(bare(text)):
        units = unicodedata.normalize("NFKC", c)
        if not units or units.isspace():
            space = i if space is None and out else space
            continue
        if space is not None:
            out.append(" ")
            at.append(space)
            space = None
        out.append(units)
        at.extend([i] * len(units))
    return "".join(out), at


#: The UTF-8 bytes of the texts whose forms are held together, single longer texts excepted.
_TOGETHER = 1 << 21


def _shares(texts: pa.Array) -> Iterator[pa.Array]:
    """Successive parts of texts of up to _TOGETHER bytes, or of one text."""
    sizes, first, held = pc.fill_null(pc.binary_length(texts), 0), 0, 0
    for i, size in enumerate(sizes):
        held += size.as_py()
        if held > _TOGETHER and i > first:
            yield texts.slice(first, i - first)
            first, held = i, size.as_py()
    yield texts.slice(first)


@F.arrow_udf(FORM)
def _forms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["text", "offsets"]
    for batch in batches:
        for texts in _shares(batch):
            said, places, ends = [], array("i"), [0]
            for t in texts:
                text, at = _form(t.as_py()) if t.is_valid else (None, ())
                said.append(text)
                places.extend(at)
                ends.append(len(places))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(places), [None, pa.py_buffer(places)]))
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), lists], names, mask=texts.is_null())


@F.arrow_udf(T.StringType())
def _normal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for texts in _shares(batch):
            yield pa.array([None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", bare(t))).strip() for t in texts.to_pylist()], pa.string())


def offset_form(text: Column) -> Column:
    """Struct (text, offsets): the text without markup, each character in its compatibility form, white space as one space and
    none at the ends; and for each character the place in the bare text that it comes from, a space's being its first."""
    return _forms(text)


def normal_text(text: Column) -> Column:
    """What is looked for in the text of an offset_form: no markup, composed (NFKC), single spaces, none at the ends."""
    return _normal(text)


def raw_span(form: Column, wanted: Column, start: Column | int = 0) -> Column:
    """Struct (start, end), half open, of the first place at or after `start` of the bare text where a normal_text stands; null if
    it does not or is empty. The search itself stays in the JVM."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.size(F.filter(form["offsets"], lambda x: x < start))
    hit = F.call_function("locate", wanted, form["text"], first + 1)
    at = lambda i: F.try_element_at(form["offsets"], i)
    return F.when((hit > 0) & (wanted != ""), F.struct(at(hit).alias("start"), (at(hit + F.char_length(wanted) - 1) + 1).alias("end")))
