"""Near duplicates, decontamination, repeats, quality, neighbours and the pipeline: against brute force on small tables."""

import hashlib
import math
import os
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from scorewright.llm import bpe, components, decontaminate, neardup, neighbours, quality, repeats
from scorewright.llm.common import recorded
from scorewright.llm.words import words

DOCS = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"


def classes_of(rows, threshold=0.8):
    sets, parent = {}, {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, t in rows:
        w = words(t)
        if k is not None and w:
            sets.setdefault(k, []).append((tuple(w), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}))
    for a in sets:
        for b in sets:
            if a < b and any(x[0] == y[0] or len(x[1] & y[1]) >= threshold * len(x[1] | y[1]) for x in sets[a] for y in sets[b]):
                a2, b2 = sorted((root(a), root(b)))
                parent[b2] = a2
    return {k: root(k) for k in parent}


def test_near_duplicates(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = [(100 + k, " ".join(w if rng.random() > 0.012 else word() for w in base)) for k in range(60)]  # many near copies
    passage = [word() for _ in range(60)]
    rows += [(300 + k, " ".join(passage + [word() for _ in range(60)])) for k in range(90)]  # a shared passage is no link
    rows += [(500, rows[0][1]), (7, rows[0][1].upper() + "!"), (8, "a b"), (9, "A, b"), (10, "a b c"), (11, ""), (12, None), (13, "..."), (None, "a b"), (14, "x " * 3000), (15, "x " * 3000), (8, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", class_id int")
    got = neardup.near_duplicate_classes(df).collect()
    want = classes_of(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {**want, None: None}
    assert neardup.near_duplicate_classes(df.limit(0)).count() == 0


def test_exact_join_finds_what_hubs_miss(spark, monkeypatch):
    rng = random.Random(4)
    base = [str(rng.random()) for _ in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.008 else str(rng.random()) for w in base)) for k in range(25)]
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == classes_of(rows)


@pytest.mark.parametrize("rounds", [0, 8])
@pytest.mark.parametrize("times", [20, 1000])
def test_repeated_blocks_do_not_part_near_copies(spark, monkeypatch, times, rounds):
    rng = random.Random(6)
    rows = []
    for k in range(20):  # a text, and the same with its second half repeated; from the eleventh on with some other words, at a Jaccard similarity of about 0.85
        base = [str(rng.random()) for _ in range(120)]
        near = base if k < 10 else [w if j not in (20, 50) else str(rng.random()) for j, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near[:60] + near[60:] * times))]
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()}
    want = classes_of(rows)
    assert all(want[2 * k + 1] == 2 * k for k in range(20))
    assert got == want


def test_prob_minhash_estimates():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), None
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    first = neardup.prob_minhash(np.concatenate([a, b]), np.repeat([0, 1], 400), np.ones(800), 2, 4096)
    assert abs((first[0] == first[1]).mean() - 300 / 500) < 0.03


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


def test_contamination(spark):
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice(["a", "b", "c", "Ünd", "x1"]) for _ in range(n))
    bench = [(k, draw(n)) for k, n in enumerate([1, 3, 5, 9, 10, 11, 12, 30, 30])] + [(20, None), (21, ""), (22, "..")]
    bench += [(23, bench[5][1].upper().replace("Ü", "ü")), (24, bench[5][1])]
    docs = [(k, draw(rng.randint(0, 60))) for k in range(60)] + [(100, bench[7][1] + " zz " + bench[4][1]), (101, None), (102, ""), (None, bench[6][1]), (103, bench[6][1]), (103, "other words"), (104, draw(9000))]
    want = []
    for k, text in docs:
        w = words(text)
        hit, items = set(), set()
        for item, t in bench:
            v = words(t)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items.add(str(item))
        want.append((str(k), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    df = spark.createDataFrame([(*r, "c") for r in docs], DOCS + ", items string")
    got = decontaminate.contamination_report(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == sorted(want)
    assert decontaminate.contamination_report(df, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0
    assert decontaminate.contamination_report(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_contamination_without_sent_prints(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(decontaminate.contamination_report(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SENT_AT_MOST", -1)
    assert sorted(decontaminate.contamination_report(docs, bench).collect()) == want


def repeats_of(rows):
    seen, out = {}, []
    order = sorted({(k is None, k or 0, t or "") for k, t in rows})
    for none, k, t in order:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (none, k, t, p)) != (none, k, t, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((str(None if none else k), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture
def repeated_rows():
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    a, b = noise(400), noise(99)
    rows = [(k, noise(rng.randint(0, 300)) + a[rng.randint(0, 150) : rng.randint(200, 400)] + noise(50)) for k in range(40)]
    rows += [(50, a), (51, a), (52, b), (53, b), (54, b + "x"), (55, "ab" * 400), (56, "z" * 350), (57, ""), (58, None), (None, a + "tail"), (59, noise(3000) + a + a), (60, noise(150) * 3)]
    return rows


def test_repeats(spark, repeated_rows):
    df = spark.createDataFrame([(*r, 0) for r in repeated_rows], DOCS + ", spans int")
    assert sorted((str(r.doc_id), *r[1:]) for r in repeats.repeat_report(df).collect()) == repeats_of(repeated_rows)
    assert repeats.repeat_report(df.limit(0)).count() == 0


def test_repeats_by_spark(spark, repeated_rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    got = repeats.repeat_report(spark.createDataFrame(repeated_rows, DOCS))
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == repeats_of(repeated_rows)


def test_repeats_of_repeated_ids(spark, repeated_rows):
    rows = [*repeated_rows, (1, repeated_rows[1][1])]
    got = sorted((str(r.doc_id), *r[1:]) for r in repeats.repeat_report(spark.createDataFrame(rows, DOCS)).collect())
    assert sorted(set(got)) == repeats_of(repeated_rows) and len(got) == len(rows)


def test_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 60_000).astype(np.uint8)
    want = repeats.stretches(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeats, "_CHUNK", 5_000)
    got = repeats.long_stretches(data)
    for x, y in zip(want, got):
        assert (x == y).all()


def test_family_levels():
    rng = np.random.default_rng(2)
    family, seen = repeats.Family(), set()
    for _ in range(50):
        batch = np.unique(rng.integers(0, 3000, 60).astype(np.uint64))
        old = family.known(batch)
        assert old.tolist() == [x in seen for x in batch.tolist()]
        family.add(batch[~old])
        seen |= set(batch.tolist())
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)


def kneser_ney(texts, order=quality.ORDER):
    """Probabilities by the definition, with dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    model = []
    for n in range(1, order + 1):
        k = [sum(c == i for c in counts[n].values()) for i in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0
        d = [0] + [min(max(i - (i + 1) * y * k[i + 1] / k[i] if k[i] and k[i + 1] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
        model.append((counts[n], d))

    def p(gram):
        if not gram:
            return 1 / 256
        c, d = model[len(gram) - 1]
        inside = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not inside:
            return p(gram[1:])
        own = c[gram]
        return (max(own - d[min(own, 3)], 0) + sum(d[min(v, 3)] for v in inside) * p(gram[1:])) / sum(inside)

    return p


def test_lookup():
    rng = np.random.default_rng(5)
    for n in (1, 2, 15, 16, 17, 70_000):
        keys = rng.permutation(np.unique(rng.integers(0, 1 << 40, n)))
        values = rng.random(len(keys)).astype(np.float32)
        lookup = quality.Lookup(keys, values)
        asked = rng.integers(0, len(keys), 3 * n)
        assert (lookup(keys[asked]) == values[asked]).all()
        with pytest.raises(KeyError):
            lookup(np.append(keys, (1 << 40) + 1))


def test_probabilities(spark):
    texts = ["abracadabra", "abba baab", "cab é"]
    orders = quality.model(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney(texts)
    asked = [b"\0\0\0\0a", b"abrac", b"zzzzz", b"adabr", b"abbaq", b"bra\xc3\xa9", *(b"abra" + bytes([c]) for c in range(256))]
    grams = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in asked], "g long").distinct()
    got = {r.g: math.exp(r.lp) for r in quality.log_probabilities(grams, orders).collect()}
    for g in asked:
        assert got[int.from_bytes(g, "big")] == pytest.approx(p(g), rel=1e-5)
    assert sum(got[int.from_bytes(b"abra" + bytes([c]), "big")] for c in range(256)) == pytest.approx(1, rel=1e-5)


def test_packed_grams():
    grams, offsets = quality.packed(pa.array(["abc", None, "", "é"]))
    assert offsets.tolist() == [0, 3, 3, 3, 5]
    assert [int(g).to_bytes(5, "big") for g in grams] == [b"\0\0\0\0a", b"\0\0\0ab", b"\0\0abc", b"\0\0\0\0\xc3", b"\0\0\0\xc3\xa9"]


def test_quality(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [got[k].keep for k, q in truth.items() if q == 1]
    junk = [got[k].keep for k, q in truth.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.15
    monkeypatch.setattr(quality, "GRAMS_READ", -1)
    monkeypatch.setattr(quality, "IDS_SENT", -1)
    again = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    assert all(again[k] == pytest.approx(r.perplexity, rel=1e-9) for k, r in got.items())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "some words", "en", 1), (1, "some words", "en", 1), (2, None, "en", 1), (3, "", None, 1), (None, "x", None, 1)], DOCS + ", lang string, keep int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert sorted((str(r.doc_id), r.keep) for r in got) == [("1", True), ("1", True), ("2", False), ("3", False), ("None", True)]
    assert quality.classify(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in quality.classify(docs, labels).filter("keep").collect()] == [1, 1]  # x is like no trusted text


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16)).round(2)
    x[1000:2000] = x[0]  # a quarter are copies of a query
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]), (9004, [1.0] * 15 + [float("nan")]), (9005, [1.0] * 3), (None, [1.0] * 16), (9006, [float("inf")] * 16), (9000, x[5].tolist())]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids, data = np.array([*range(4000), 9000]), np.vstack([x, x[5]])
    found = 0
    for q in [*range(0, 4000, 100), 9000]:
        d = np.sqrt(((data - data[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert [got[q][k][1] for k in range(1, 11)] == sorted(got[q][k][1] for k in range(1, 11))
        found += len({got[q][k][0] for k in range(1, 11)} & set(ids[want].tolist()))
        for k in range(1, 11):
            assert got[q][k][1] == pytest.approx(d[ids == got[q][k][0]][0])
    assert found / (10 * 41) >= 0.9 and len(got) == 41
    few = neighbours.nearest(df.filter("vec_id IN (0, 1, 2)"))
    assert few.count() == 2
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbour_blocks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 8))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    want = sorted(neighbours.nearest(df, every=20).collect())
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    assert sorted(neighbours.nearest(df, every=20).collect()) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        kept = corpus_pipeline.materialize(out, "test")
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0.4 * counts[0]
    rows = kept.select("doc_id", "text").collect()
    assert all(k == c for k, c in classes_of([(r.doc_id, r.text) for r in rows]).items())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == {r.doc_id for r in rows}


def test_pipeline_edges(spark):
    """Rows that share an id or have none are documents of their own; null, empty and very long texts; clashing columns."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text, other, long = (" ".join(word() for _ in range(n)) for n in (40, 40, 60_000))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (1, other), (5, long), (4, long + " end"), (None, None), (6, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(*r, "en", "src", len(r[1] or "")) for r in rows], DOCS + ", lang string, source string, n_chars int")
    clash = docs.selectExpr("*", "1 AS keep", "2 AS class_id", "3 AS n_hit", "4 AS secrets", "5 AS words_key", "6 AS row", "7 AS lp")
    stages = dict(corpus_pipeline.STAGES)
    for table in (docs, clash):
        out = stages["near_duplicates"](spark, table, SMALL)
        assert out.columns == table.columns
        assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted([("1", text), ("1", other), ("4", long + " end"), ("None", ""), ("6", ""), ("7", ""), ("7", "")])
        for name in ("decontaminate", "secrets"):
            out = stages[name](spark, table, SMALL)
            assert out.columns == table.columns
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)
        out = stages["quality"](spark, table, SMALL)
        assert out.columns == table.columns
        got = Counter((r.doc_id, len(r.text)) for r in out.collect())
        judged = quality.classify(table, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
        assert got == Counter((r.doc_id, r.n_bytes) for r in judged if r.keep) and len(judged) == len(rows)
        import tiktoken
        import public_tokenizers

        coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
        ids = {t: coder.encode_ordinary(t or "") for _, t in rows}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want = [(i, len(ids[t]), sha(",".join(map(str, ids[t])).encode()), sha((t or "").encode())) for i, t in rows]
        assert Counter(map(tuple, stages["encode"](spark, table, SMALL).collect())) == Counter(want)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table.limit(0), SMALL).count() == 0, name


def test_quality_stage_judges_rows(spark):
    trusted = [(k, " ".join(random.Random(k).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)), "en") for k in range(40)]
    rows = [*trusted, (1, "0x" * 300, "en"), (None, trusted[3][1], "en"), (None, "%" * 500, "en"), (1, None, "en")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    got = Counter((r.doc_id, r.text) for r in quality.accepted(docs, labels).collect())
    assert (1, "0x" * 300) not in got and (None, "%" * 500) not in got and (1, None) not in got
    assert got[(None, trusted[3][1])] == 1 and got[(1, trusted[1][1])] == 1


def test_bounds_are_of_unseen_text(spark):
    """The bound is the quantile of held-out documents, by brute force over their scores."""
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality._judged(docs, labels).collect()
    held = sorted(r.score for r in rows if r.held)
    trained = {r.doc_id for r in rows if r.trusted}
    assert held and not trained & {r.doc_id for r in rows if r.held}
    want = held[min(len(held) - 1, math.ceil(quality.HIGH * len(held)) - 1)]
    assert {r.bound for r in rows} == {want}  # fewer than LEAST_TRUSTED of a language
    assert all(r.keep == (r.score <= r.bound) for r in rows)


def test_stages_and_runs_leave_others_alone(spark):
    """A stage deletes nothing that another result reads, and two runs at once do not meet."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, SMALL)
    second = stages["near_duplicates"](spark, docs, SMALL)
    third = stages["decontaminate"](spark, docs, SMALL)
    n = first.count(), second.count(), third.count()
    assert (first.count(), second.count(), third.count()) == n
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: corpus_pipeline.run(spark, SMALL), range(2))
    assert sorted(one.collect()) == sorted(two.collect())
    with recorded() as made:
        assert corpus_pipeline.run(spark, SMALL).count() == one.count()
    where = {p for p in made if os.path.isdir(p.removeprefix("file://"))}
    assert len(made) > 20 and len(where) <= 2  # the rest went
