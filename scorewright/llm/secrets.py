"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: every match must contain the trigrams of at least one of some
literal strings. The index has a posting (trigram, doc_id) for each trigram of these queries and each document with it; it is
written once. The queries are answered from it alone: postings meet the queries' table by trigram, an alternative holds where
the postings of all its trigrams intersect, a clause is the union of its alternatives, a query the intersection of its
clauses. Only candidates are searched with the regex. Rules without mandatory trigrams search every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import forget, materialize

_parser, _c = re._parser, re._constants


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ with 32 characters or more
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


#: Candidates whose ids and kinds are broadcast at most (1 million: some 60 MB); more are joined by a shuffle.
IDS_SENT = 1_000_000


def _strings(node) -> set[str] | None:
    """All strings that a piece of a regex can match, in lower case; None if they are many or unknown."""
    op, arg = node
    if op is _c.LITERAL:
        return {chr(arg).lower()}
    if op is _c.AT:
        return {""}
    if op is _c.IN and len(arg) <= 8 and all(kind is _c.LITERAL for kind, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is _c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _c.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] != _c.MAXREPEAT and arg[1] <= 3:
        one = _sequence(arg[2])
        return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(found) * len(out) > 64:
            return None
        out = {a + b for a in out for b in found}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of clauses; a clause lists alternatives; an alternative is a set of trigrams that must all occur.

    Trigrams are in lower case, and so is the index; a query can thus find more than the regex, never less. An empty list
    means that nothing is mandatory.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            found = _strings(node)
            if found is not None and len(found) * len(run) <= 64:
                run = {a + b for a in run for b in found}
                continue
            close(run)
            run = found if found is not None else {""}
            if found is None and node[0] is _c.SUBPATTERN:
                walk(node[1][-1])
            elif found is None and node[0] in (_c.MAX_REPEAT, _c.MIN_REPEAT) and node[1][0] > 0:
                walk(node[1][2])
        close(run)

    walk(_parser.parse(pattern))
    return clauses


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings (trigram, doc_id) of these trigrams over whole texts in lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(present).alias("trigram"))


def query_rows(rules: tuple[Rule, ...]) -> list[tuple]:
    """(trigram, kind, clauses, clause, whole, bit): the trigram is that bit of an alternative's mask `whole`, the alternative
    one of the clause with this number, and the kind's query has so many clauses."""
    rows = []
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        for number, clause in enumerate(clauses):
            for alternative, grams in enumerate(clause):
                used = sorted(grams)[:62]  # a longer conjunction finds more by some of its trigrams, never less
                rows += [(t, rule.kind, len(clauses), number, alternative, (1 << len(used)) - 1, 1 << k) for k, t in enumerate(used)]
    return rows


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the documents whose postings satisfy the trigram query of some rules, and the kinds of these."""
    schema = "trigram string, kind string, clauses int, clause int, alternative int, whole long, bit long"
    asked = F.broadcast(index.sparkSession.createDataFrame(query_rows(rules), schema))  # a row for each trigram of the rules
    met = index.join(asked, "trigram").groupBy("doc_id", "kind", "clauses", "clause", "alternative", "whole").agg(F.bit_or("bit").alias("bits"))
    met = met.filter("bits = whole").groupBy("doc_id", "kind", "clauses").agg(F.bit_or(F.expr("shiftleft(1L, clause)")).alias("held"))
    met = met.filter("held = shiftleft(1L, clauses) - 1")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # no more than there are rules


def let(value: Column, use) -> Column:
    """use(value), where value is computed once, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements that `running` sums at once: an aggregate copies its array with each.
_STEP = 64


def running(numbers: Column) -> Column:
    """array<long>: the sum of the numbers before each element. Blocks of _STEP are summed one by one, from what their
    predecessors come to, so that the work grows with the length and not with its square."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def sums(of: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("sums"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))
        return F.aggregate(of, first, step, lambda acc: acc["sums"])

    def whole(numbers: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _STEP).cast("int"))
        return let(F.transform(places, lambda k: F.slice(numbers, k * _STEP + 1, _STEP)), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, x: acc + x))
        pairs = F.arrays_zip(blocks.alias("block"), sums(totals, zero).alias("start"))
        return F.flatten(F.transform(pairs, lambda x: sums(x["block"], x["start"])))

    return let(numbers, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches: code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    whole, gaps = F.regexp_extract_all("text", pattern, F.lit(0)), F.split("text", rule.pattern, -1)
    tested = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    # a piece is the text before a match, and the match; arrays_zip pads the matches by a null for the text behind the last one
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), tested.alias("tested")),
        lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["whole"]).cast("long").alias("n"), (F.char_length(x["tested"]) >= rule.least).alias("counts")),
    )

    def spans(pieces: Column) -> Column:
        since = running(F.transform(pieces, lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))))
        found = F.filter(F.arrays_zip(pieces.alias("piece"), since.alias("since")), lambda x: F.coalesce(x["piece"]["counts"], F.lit(False)))
        start = lambda x: x["since"] + x["piece"]["gap"]
        return F.transform(found, lambda x: F.struct(start(x).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start(x) + x["piece"]["n"]).alias("end")))

    return let(pieces, spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text, and others as they are) with `secrets`: the spans of all rules by start, then order of rules.

    Per rule, matches are leftmost and do not overlap; spans of different rules may. Null text counts as empty; a doc_id
    may be null or occur on several rows, each row gets the spans of its own text. A former column `secrets` goes.
    """
    docs = docs.drop("secrets")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if queries[r.kind])
    grams = sorted({g for q in queries.values() for clause in q for grams in clause for g in grams})
    given = docs  # nothing is found in null
    if grams:
        index = materialize(trigram_index(given, grams), "postings")
        found = materialize(candidates(index, indexed), "candidates")
        forget(index)
        found = found.select(F.col("doc_id").alias("found__id"), F.col("kinds").alias("found__kinds"))
        found = F.broadcast(found) if found.count() <= IDS_SENT else found
        given = given.join(found, F.col("doc_id").eqNullSafe(F.col("found__id")), "left").drop("found__id")
    else:
        given = given.withColumn("found__kinds", F.array().cast("array<string>"))
    spans = []
    for order, rule in enumerate(rules):
        wanted = F.array_contains("found__kinds", rule.kind) if queries[rule.kind] else F.col("text").rlike(rule.pattern)
        none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
        spans.append(F.coalesce(F.when(wanted, _spans(rule, order)), none))
    return given.withColumn("secrets", F.array_sort(F.concat(*spans))).drop("found__kinds")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: counts of the base kinds, the digest of their spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["order"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE_RULES],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


def report_sql() -> str:
    """DuckDB SQL for secret_report over the table documents."""
    parts = []
    for order, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{"
            f"'start': coalesce(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))), 0)"
            f" + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda x: length(x))), 0), 'ord': {order}, 'kind': '{r.kind}',"
            f" 'n': length(regexp_extract_all(t, '{pattern}')[i]), 'ok': length(regexp_extract_all(t, '{pattern}', {r.group})[i]) >= {r.least}}}), lambda q: q.ok)"
        )
    text = "coalesce(list_aggregate(list_transform({}, lambda q: q.kind || ':' || q.start::bigint || ':' || (q.start + q.n)::bigint), 'string_agg', ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(parts)})) AS found FROM d)
SELECT doc_id, len(list_filter(found, lambda x: x.kind = 'assign'))::bigint AS n_assign, len(list_filter(found, lambda x: x.kind = 'access'))::bigint AS n_access,
 len(list_filter(found, lambda x: x.kind = 'hex'))::bigint AS n_hex,
 sha256({text.format("list_filter(found, lambda x: x.ord < 3)")}) AS base_sha256,
 {text.format("found")} AS spans
FROM f
"""
