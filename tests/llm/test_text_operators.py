"""Encoding, secrets, pseudonyms, packing, archives: against definitions and round trips, with their edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.llm import bpe, packing, pii, secrets, warc
from scorewright.llm.common import materialize, scratch

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODE = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
DOCS = "doc_id long, text string"


def ids(text):
    return np.frombuffer(ENCODE(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeth éñ12\n\t  '!s中🙂 ", max_size=60))
def test_encode_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_every_character():
    for c in (chr(x) for x in range(0x3000) if not 0xD800 <= x < 0xE000):
        text = f"a {c}b {c}{c}1 {c} "
        assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=6), st.data())
def test_prefix_table_edits(data, new, draw):
    start = draw.draw(st.integers(0, len(data)))
    stop = draw.draw(st.integers(start, len(data)))
    v = ENCODE.pieces.vocabulary
    whole = lambda x: [RANKS[p] for p in v.merged(x)]
    t = bpe.PrefixTable(v, data[:start])
    t.append(data[start:])
    assert t.tokens() == whole(data)
    t.replace(start, stop, new)
    assert t.tokens() == whole(data[:start] + new + data[stop:])


def test_edit_is_local():
    t = bpe.PrefixTable(ENCODE.pieces.vocabulary, b"abcdefgh" * 200)
    assert t.replace(40, 41, b"x") < 400


def test_encode_rows(spark):
    rows = [(1, "the text"), (1, "the text"), (None, None), (2, ""), (3, "é" * 5000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert [(r.doc_id, bytes(r.decoded).decode(), r.ids) for r in got] == [(k, t or "", LIBRARY.encode_ordinary(t or "")) for k, t in rows]
    assert [bytes(r.back).decode() for r in bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, out="back").collect()] == [t or "" for _, t in rows]
    assert bpe.digests(bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN, decoded="decoded")).count() == 0


def test_trigram_query():
    query = secrets.trigram_query(secrets.BASE_RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in query[0] and len(query[0]) == 6
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("(?:abc|x)+def") == [[frozenset({"def"})]]


def base_spans(text):
    """By the contract's words, with Python's re."""
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return ",".join(x for _, _, x in sorted(out))


def test_secrets(spark):
    rng = random.Random(1)
    parts = ["token", "Api_Key", "PASSWORD", "passwd", "secret", "=", ": ", '"', "'", " ", "abcdefgh1", "xy", "AKIA", "ABCDEFGH", "é🙂", "0123456789abcdef", "\n", "toKen=token=abcdefgh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "token=abcdefgh " * 3000]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", secrets string, kinds string")
    got = secrets.scan(df)
    base = secrets.span_text(F.filter("secrets", lambda s: s["order"] < 3)).alias("base")
    found = got.select("doc_id", "text", base).collect()
    assert sorted((str(r.doc_id), str(r.text), r.base) for r in found) == sorted((str(k), str(t), base_spans(t or "")) for k, t in rows)
    assert secrets.secret_report(df.limit(0)).count() == 0


def test_more_rules(spark):
    text = f"x ghp_{'x' * 36} -----BEGIN RSA PRIVATE KEY----- AIza{'y' * 35}"
    row = secrets.secret_report(spark.createDataFrame([(1, text)], DOCS)).first()
    assert [s.split(":")[0] for s in row.spans.split(",")] == ["forge", "pem", "maps"] and row.base_sha256 == hashlib.sha256(b"").hexdigest()


F1 = pii.Feistel(b"one")


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_permutation(size, draw):
    value = draw.draw(st.integers(0, size - 1))
    new = F1.permute("k", value, size)
    assert 0 <= new < size and F1.permute("k", new, size, True) == value


def test_permutation_is_onto():
    assert sorted(F1.permute("k", x, 1000) for x in range(1000)) == list(range(1000))


@pytest.mark.parametrize("value", ["4111 1111 1111 1111", "078-05-1120", "2024-02-29", "31.12.1999", "GB82 WEST 1234 5698 7654 32", "+1 (805) 555-3764", "x.y7@mail.org", "10.0.0.1"])
def test_formats(value):
    new, spans = pii.pseudonymize(f"see {value} now", F1)
    assert len(spans) == 1 and new != f"see {value} now"
    assert pii.pseudonymize(new, F1, back=True)[0] == f"see {value} now"
    assert pii.pseudonymize(f"other {value}.", F1)[0].endswith(new.removeprefix("see ").removesuffix(" now") + ".")
    assert pii.pseudonymize(f"see {value} now", pii.Feistel(b"two"))[0] != new
    digits = re.sub("[^0-9]", "", new)
    if value.startswith("4111"):
        assert pii.luhn(digits[:-1]) == int(digits[-1])


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "999-99-0000", "2024-02-30", "256.1.1.1", "1.2.3.4.5", "12345678901234567890123", "plain", "a@b"])
def test_invalid_values_stay(text):
    assert pii.pseudonymize(text, F1) == (text, [])


@pytest.mark.parametrize("before, value, after", [
    ("", "4111 1111 1111 1111", " 123"), ("", "4111 1111 1111 1111", " 12/27"), ("id 12 ", "4111 1111 1111 1111", ""), ("1234 ", "4111 1111 1111 1111", ""), ("12-34 56 78 ", "4111 1111 1111 1111", " 1234 5678 x"),
    ("no 7 ", "4111111111111111", " 123"), ("12 ", "3782 822463 10005", " 1"), ("", "BE68 5390 0754 7034", " BIC"), ("", "AT61 1904 3002 3457 3201", " PAID"), ("XX12 ABCD ", "BE68 5390 0754 7034", " BIC"), ("BE68 5390 0754 7034 ", "4111 1111 1111 1111", ""),
])
def test_values_beside_digits_and_words(before, value, after):
    for key in range(40):  # with some keys the new value and its neighbours look valid together
        f = pii.Feistel(str(key).encode())
        text = f"{before}{value}{after}"
        new, spans = pii.pseudonymize(text, f)
        kind = "bank" if value[0].isalpha() else "card"
        assert (kind, len(before), len(before) + len(value)) in spans and value not in new
        assert pii.pseudonymize(new, f, back=True)[0] == text


def test_pseudonym_rows(spark):
    rows = [(1, "a@b.org"), (2, "a@b.org"), (2, "a@b.org"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("found", F.lit(1)).withColumn("other", F.lit("o"))
    got = pii.pseudonyms(df, b"k").collect()
    assert got[0].text == got[1].text == got[2].text != "a@b.org" and got[3].text is None and got[4].text == "" and got[3].found == [] and got[0].other == "o"
    back = pii.pseudonyms(pii.pseudonyms(df, b"k"), b"k", back=True).collect()
    assert [(r.doc_id, r.text) for r in back] == rows
    assert pii.pseudonym_report(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 100), max_size=60))
def test_best_fit_decreasing(length, sizes):
    docs = [np.arange(n) + 1 for n in sizes]
    got = packing.pack_shard(docs, length, 0)
    again = [[] for _ in docs]
    for d, _, row, place, n in sorted(zip(*(got[c] for c in ("doc", "piece", "row", "place", "n")))):
        again[d] += got["matrix"][row, place : place + n].tolist()
    assert again == [d.tolist() for d in docs]
    bins = []
    for n in sorted(got["n"].tolist(), reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else length) - n)
    assert len(bins) == len(got["matrix"])
    at = packing.positions(got["resets"], got["matrix"].size)
    for row, place, n in zip(got["row"], got["place"], got["n"]):
        assert (at[row * length + place :][:n] == np.arange(n)).all()
    assert got["cu_seqlens"][-1] == got["matrix"].size


def test_packed_files(spark):
    rows = [(1, "the text " * 40), (2, ""), (None, None), (2, "a"), (2, "a")]
    ids_of = packing.library_ids(spark.createDataFrame(rows, DOCS).coalesce(1), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    where = scratch(spark, "test-packed")
    index = materialize(packing.pack(ids_of, where, 50_256, length=16), "test-index").orderBy("shard", "doc", "piece").collect()
    matrix = packing.read_array(where, f"{index[0].shard}.ids.npy")
    found = {}
    for r in index:
        found.setdefault((r.doc, r.doc_id), []).extend(matrix[r.row, r.place : r.place + r.n].tolist() if r.n else [])
    assert [(k[1], v) for k, v in sorted(found.items(), key=lambda x: x[0][0])] == [(k, LIBRARY.encode_ordinary(t or "")) for k, t in rows]
    assert matrix.dtype == np.uint16 and matrix.shape[1] == 16
    assert packing.packed_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_archives(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, None), (8, "u", ""), (4, "u", "é\r\n\r\nWARC/1.1\r\n" * 5), (3, "again", "same"), (None, "n", "same"), (None, "n", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_round_trip(pages).collect()
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        least = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        first = least is None or page == least
        want.append((str(page), len(body), warc.payload_digest(body), "response" if first else "revisit", None if first else least))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: (*x[:4], str(x[4])))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "1 AS payload_bytes", "'x' AS record_type", "'y' AS file__", "2 AS row__")
    assert warc.archive_round_trip(clash).count() == len(rows)


def test_long_page(spark):
    html = "<p>é long</p>" * 400_000
    pages = spark.createDataFrame([(2, "u", html), (1, "v", html), (3, "w", "<p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()}
    n = len(html.encode())
    assert got == {1: (n, "response", None), 2: (n, "revisit", 1), 3: (3, "response", None)}


def test_monolithic_stream():
    import gzip
    import io

    made = [warc.page_record(k, "u", bytes([k]) * k * 1000, None if k % 2 else k - 1) for k in range(1, 30)]
    data = gzip.compress(b"".join(r.to_bytes() for r in made[:10])) + gzip.compress(b"".join(r.to_bytes() for r in made[10:]))
    back = [warc.Record.read(h, b) for h, b in warc.records(warc.inflated(io.BytesIO(data)))]
    assert [(r.fields["WARC-Record-ID"], r.block) for r in back] == [(r.fields["WARC-Record-ID"], r.block) for r in made]
    with pytest.raises(ValueError, match="no end"):
        list(warc.records(iter([made[3].to_bytes()[:-9]])))


def test_telephone_numbers_stay_linked(spark):
    """Equal numbers get equal digits in every notation, also beside other numbers; very long texts; repeated rows."""
    f = pii.Feistel(b"k")
    digits = lambda t: re.sub("[^0-9]", "", t)
    same = lambda *texts: {digits(pii.pseudonymize(t, f)[0])[-10:] for t in texts}
    assert len(same("+49 170 1234567", "+49-170-1234567", "+49.170.1234567", "+491701234567", "+49 (170) 1234567")) == 1
    assert len(same("+1 (974) 555-3436", "(974) 555-3436", "974-555-3436", "+1 974.555.3436", "+19745553436")) == 1
    assert same("+1 (974) 555-3436") != same("+1 (974) 555-3437")
    text = "call +1 (826) 555-4081 190.137.20.31 or +49 170 1234567"
    new, found = pii.pseudonymize(text, f)
    assert [k for k, _, _ in found] == ["phone", "address", "phone"] and pii.pseudonymize(new, f, back=True)[0] == text
    assert digits(new[5:22])[1:] == same("(826) 555-4081").pop()
    assert pii.pseudonymize("+1 234 56 and +123456", f)[1] == []
    long = "a@b.de +1 (974) 555-3436 x " * 20_000
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, None, 1), (3, "", 1)], DOCS + ", found int")
    rows = pii.pseudonyms(df, b"k").orderBy("doc_id").collect()
    assert rows[0] == rows[1] and len(rows[0].found) == 40_000 and (rows[2].text, rows[3].text) == (None, "")


def test_pseudonym_report(spark):
    texts = [(1, "born 1999-12-31, 4111 1111 1111 1111"), (2, None), (None, "mail a1@b.de")]
    rows = {r.doc_id: r for r in pii.pseudonym_report(spark.createDataFrame(texts, DOCS)).collect()}
    f = pii.Feistel(pii.QUERY_KEY)
    for k, t in texts:
        new, found = pii.pseudonymize(t, f) if t else (t, [])
        assert rows[k].text == new and rows[k].spans == ",".join(f"{x}:{a}:{b}" for x, a, b in found)
        assert all(rows[k][f"n_{kind}"] == sum(x == kind for x, _, _ in found) for kind, _, _ in pii.KINDS)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rows = [[], [5], list(range(64)), list(range(65)), [3] * 1000]
    got = spark.createDataFrame([(r,) for r in rows], "x array<long>").select(secrets.running(F.col("x"))).collect()
    assert [r[0] for r in got] == [[sum(r[:k]) for k in range(len(r))] for r in rows]


def test_boolean_queries_from_postings(spark):
    """Candidates by the postings alone are those whose lower-case text has the trigrams of the query."""
    rules = (secrets.Rule("a", "(?:abcd|xyz)[0-9]+(?:key|tok)"), secrets.Rule("b", "foobar.+qux"))
    texts = ["abcd1key", "abc bcd tok", "xyz", "XYZkey", "foobarqux", "fooobarqux foob oba", "", None, "xyz tok foobar qux"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    grams = sorted({r[0] for r in secrets.query_rows(rules)})
    got = {r.doc_id: set(r.kinds) for r in secrets.candidates(secrets.trigram_index(df, grams), rules).collect()}

    def holds(text, rule):
        return all(any(all(g in text for g in alternative) for alternative in clause) for clause in secrets.trigram_query(rule.pattern))

    want = {k: {r.kind for r in rules if holds(t.lower(), r)} for k, t in enumerate(texts) if t}
    assert got == {k: v for k, v in want.items() if v}
