"""Sharding, lexical search and importance resampling: against brute force, with their edge cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scorewright.llm import common, lexical, resampling, sharding
from scorewright.llm.common import scratch

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed=5):
    """Words of any script, copies, ties, nulls, an empty and a very long text, a repeated id."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "ÉTÉ", "straße", "中文", "x1", "don't", "🙂ok", "zeta", "eta", "théta"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for k in range(120)]
    rows += [(200 + k, "one and the same text, of twenty words or more: " + "alpha beta gamma " * 8) for k in range(60)]  # a third
    rows += [(300, None), (None, None), (301, ""), (302, " .,! "), (303, "gamma " * 30_000 + "eta"), (7, rows[7][1]), (7, "beta beta"), (None, "alpha"), (None, "alpha")]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    clash = "1 AS shard, 2 AS slot, 3 AS digest, 4 AS n, 5 AS size, 6 AS score, 7 AS rank, 8 AS weight, 9 AS n_words, 10 AS item_id, 11 AS term, 12 AS place"
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *clash.split(", ")).repartition(3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 7))
def test_longest_first(sizes, shards):
    sizes.sort(reverse=True)
    loads = [0] * shards
    for size, shard in zip(sizes, sharding.longest_first(sizes, shards)):
        assert shard == min(range(shards), key=lambda s: (loads[s], s))
        loads[shard] += size


def test_balanced(spark, monkeypatch):
    rows = corpus()
    for units, bins, ranges in ((4096, 250_000, 500_000), (8, 20, 15)):
        monkeypatch.setattr(sharding, "UNITS", units)
        monkeypatch.setattr(sharding, "BIN_GROUPS", bins)
        monkeypatch.setattr(common, "RANGE_ROWS", ranges)
        for df in (table(spark, rows), spark.createDataFrame(rows, DOCS)):
            got = sharding.balanced(df, 5).collect()
            assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
            shards, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
            for r in got:
                shards[r.shard] += r.size
                slots[r.shard].append(r.slot)
                of_text[r.size, r.text_crc32].add(r.shard)
            assert all(sorted(x) == list(range(len(x))) for x in slots.values())
            assert all(len(x) == 1 for x in of_text.values())
            groups = Counter()
            for _, t in rows:
                groups[t or ""] += len((t or "").encode()) + 8
            if units == 4096:  # every group is an item: as the heap by definition gives
                heap = [(0, s) for s in range(5)]
                for t in sorted(groups, key=lambda t: (-groups[t], hashlib.sha256(t.encode()).digest())):
                    load, s = heapq.heappop(heap)
                    assert of_text[len(t.encode()) + 8, zlib.crc32(t.encode())] <= {s} or not t
                    heapq.heappush(heap, (load + groups[t], s))
            loads = sorted(shards[s] for s in range(5))
            quantum = math.ceil(sum(loads) / (5 * units))
            assert loads[2] - loads[0] <= 2 * max(quantum, 60) and loads[3:] == sorted(groups.values())[-2:]  # the longest text and the copies have a shard each
    assert sharding.balanced(table(spark, rows).limit(0)).count() == 0
    assert {r.shard for r in sharding.balanced(table(spark, [(1, "a"), (2, "b")])).collect()} == {0, 1}


def test_write_shards(spark):
    rows = [(k, f"text {k} " * (k % 9)) for k in range(300)]
    where = scratch(spark, "shards")
    back = sharding.write_shards(table(spark, rows), where, 4).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows) and {r.shard for r in back} == {0, 1, 2, 3}
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.balanced(table(spark, rows), 4).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back} == want


def ranking(rows, items, k):
    texts = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, wanted in items.items():
        scored = []
        for i, c in texts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, n, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search(spark, monkeypatch):
    rows = corpus(6)
    texts = [(1, "Alpha BETA beta, zeta?"), (2, "straße 中文 nowhere"), (3, None), (4, "absent"), (5, "été " * 5), (None, "eta"), (1, "gamma"), (6, "x1 " * 9_000), (7, "alpha")]
    items = defaultdict(Counter)
    for item, t in texts:
        items[item] += Counter(terms(t))
    queries = spark.createDataFrame(texts, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS q", "3 AS rank")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for size, docs, pairs in ((8_000_000, 1 << 16, 1_000_000), (900, 4, 3)):
        monkeypatch.setattr(lexical, "SHARD_BYTES", size)
        monkeypatch.setattr(lexical, "SHARD_DOCS", docs)
        monkeypatch.setattr(lexical, "PAIRS_SENT", pairs)
        index, n_docs = lexical.build_index(table(spark, rows))
        for k in (20, 3):
            got = [tuple(r) for r in lexical.search(index, n_docs, queries, k).collect()]
            assert sorted(got, key=key) == sorted(ranking(rows, items, k), key=key)
    empty, none = lexical.build_index(table(spark, rows).limit(0))
    assert lexical.search(empty, none, queries).count() == 0
    assert lexical.search(index, n_docs, queries.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30)), max_size=40), st.integers(1, 10))
def test_best_with_ties(rows, k):
    scores, ids = np.array([s for s, _ in rows], np.int64), np.array([i for _, i in rows], np.int64)
    got = [(-scores[x], ids[x]) for x in lexical.best(scores, ids, k)]
    assert sorted(got) == sorted((-s, i) for s, i in rows if s)[:k]


def importance(rows, target, buckets, longest, percent, least):
    def buckets_of(text):
        w = terms(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in buckets_of(x)[1]) for texts in ([x for _, x in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        n, own = buckets_of(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= least)
    drawn = Counter(able[: len(able) * percent // 100])
    return out, able, drawn


def test_importance(spark, monkeypatch):
    rows, target = corpus(7), ["alpha eta théta", None, "", "ÉTÉ 中文 " * 50]
    goal = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 AS n", "2 AS buckets")
    for buckets, longest, percent, hot, ranges in ((10_000, 1, 10, 10_000, 500_000), (64, 3, 30, 4, 20)):
        monkeypatch.setattr(common, "HOT_GROUPS", hot)
        monkeypatch.setattr(common, "RANGE_ROWS", ranges)
        want, able, drawn = importance(rows, target, buckets, longest, percent, 20)
        got = resampling.importance(table(spark, rows), goal, buckets, longest, percent).collect()
        assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(able) * percent // 100 + 1))
        assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == able[: len(ranked)] and drawn.total() == len(ranked)
    chosen = resampling.resampled(table(spark, rows), goal, percent=50)
    assert chosen.columns == table(spark, rows).columns
    texts = Counter(rows)
    assert chosen.count() == len(able) // 2 and not Counter((r.doc_id, r.text) for r in chosen.collect()) - texts
    assert resampling.importance(table(spark, rows).limit(0), goal).count() == 0
    assert resampling.importance(table(spark, rows), goal.limit(0)).count() == len(rows)
