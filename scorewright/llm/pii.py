"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value keeps its format: a card number becomes another card number with a right check digit, a date another date of the
same notation, a telephone number another one with the same punctuation. The permutation of each kind's value space is
keyed, so equal values become equal ones in all documents, and the key holder can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from bisect import bisect, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import small_batches

ROUNDS = 8
#: The key of the query. Users pass their own.
QUERY_KEY = b"pseudonym-key-of-the-example-query"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = key
        self.permute = lru_cache(100_000)(self._permute)

    def _round(self, kind: str, k: int, size: int, half: int) -> int:
        mac = hmac.digest(self.key, f"{kind}:{k}:{size}:{half}".encode(), hashlib.sha256)
        return int.from_bytes(mac, "big")

    def _permute(self, kind: str, value: int, size: int, back: bool = False) -> int:
        """A balanced network over the next square; results beyond the bound are permuted again until they are inside."""
        side = 1
        while side * side < size:
            side *= 2
        while True:
            left, right = divmod(value, side)
            if back:
                for k in reversed(range(ROUNDS)):
                    left, right = (right - self._round(kind, k, size, left)) % side, left
            else:
                for k in range(ROUNDS):
                    left, right = right, (left + self._round(kind, k, size, right)) % side
            value = left * side + right
            if value < size:
                return value

    def digits(self, kind: str, text: str, back: bool = False) -> str:
        """A string of digits to another one of its length."""
        return f"{self.permute(kind, int(text), 10 ** len(text), back):0{len(text)}d}" if text else text


def luhn(digits: str) -> int:
    """The check digit that these digits need."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return -(doubled + sum(map(int, digits[-2::-2]))) % 10


def _relay(text: str, digits: str) -> str:
    """text with its digits replaced one by one."""
    following = iter(digits)
    return "".join(next(following) if c in "0123456789" else c for c in text)


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + f.digits("card" + digits[0], digits[1:-1], back)  # the first digit tells the kind of card
    return _relay(m[0], body + str(luhn(body)))


#: Country codes of telephone numbers with one digit and with two; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Telephone numbers: the country code stays, the digits behind it are permuted, whatever separates them. Numbers without
    a country are of code 1. With code 1 they have ten digits, else six or more and 15 with the code at most."""
    digits, abroad = re.sub("[^0-9]", "", m[0]), m[0].startswith("+")
    code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3]) if abroad else "1"
    number = digits[len(code) :] if abroad else digits
    if len(number) != 10 if code == "1" else not 6 <= len(number) <= 15 - len(code):
        return None
    return _relay(m[0], (code if abroad else "") + f.digits(f"phone{code}", number, back))


def _national(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Social security numbers: area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value = f.permute("national", value, 898 * 99 * 9999, back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    iso = m["y"] is not None
    try:
        day = datetime.date(int(m["y"] or m["y2"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    day = datetime.date.fromordinal(FIRST_DAY + f.permute("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back))
    sep = m["s"] or m["s2"]
    return f"{day.year}{sep}{day.month:02d}{sep}{day.day:02d}" if iso else f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year}"


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = f.permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _bank(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Account numbers with a country, two check digits (mod 97) and a body whose digits and letters keep their places."""
    raw = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = raw[4:]
    sizes = [10 if c.isdigit() else 26 for c in body]
    value, size = 0, 1
    for c, n in zip(body, sizes):
        value, size = value * n + (int(c) if n == 10 else ord(c) - 65), size * n
    value = f.permute(f"bank{raw[:2]}{sizes}", value, size, back)
    out = ""
    for n in reversed(sizes):
        value, c = divmod(value, n)
        out = (str(c) if n == 10 else chr(65 + c)) + out
    whole = raw[:2] + f"{98 - number(out + raw[:2] + '00') % 97:02d}" + out
    following = iter(whole)
    return "".join(c if c == " " else next(following) for c in m[0])


def _email(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Letters of the part before the @ become letters, digits digits; the host stays."""
    name, out, value, size = m["name"], "", 0, 1
    spaces = [(c, 10, 48) if c.isdigit() else (c, 26, 97) if c.islower() else (c, 26, 65) for c in name if c.isalnum()]
    for c, n, base in spaces:
        value, size = value * n + ord(c) - base, size * n
    value = f.permute(f"mail{[n for _, n, _ in spaces]}", value, size, back) if spaces else 0
    for _, n, base in reversed(spaces):
        value, c = divmod(value, n)
        out = chr(base + c) + out
    following = iter(out)
    return "".join(next(following) if c.isalnum() else c for c in name) + "@" + m["host"]


_BANK = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Kind, pattern and rule, in the order in which overlapping finds take precedence.
KINDS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]{1,64})@(?P<host>[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"), _email),
    ("bank", _BANK, _bank),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])"), _card),
    ("address", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _address),
    ("date", re.compile(r"(?<![0-9])(?:(?P<y>[0-9]{4})(?P<s>[-/])(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})|(?P<d2>[0-9]{2})(?P<s2>[./])(?P<m2>[0-9]{2})(?P=s2)(?P<y2>[0-9]{4}))(?![0-9])"), _date),
    ("national", re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])"), _national),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[02-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|(?<![0-9][ .-])(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}))(?![0-9A-Za-z-])"), _phone),
)
_PHONE = dict((kind, pattern) for kind, pattern, _ in KINDS)["phone"]
_WHOLE = re.compile(r"(?s:.*)")
#: Digits with single separators, of any length; groups of a card as they are printed.
_RUN = re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,}")
_PRINTED = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{4}([ -])[0-9]{3}\3[0-9]{3}\3[0-9]{3}")
_BANK_START = re.compile(r"\b[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9])*))")
#: Length of a bank number by country.
BANK_LENGTHS = {
    country: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for country in countries.split()
}


def _card_parts(text: str) -> list[tuple[int, int]]:
    """Whole groups with 13 to 19 digits of each run of digits: first those that are grouped like a card, then the others, the longest first."""
    printed, others = [], []
    for run in _RUN.finditer(text):
        groups = [m.span() for m in re.finditer("[0-9]+", run[0])]
        base, last = run.start(), len(groups) - 1
        open_end = re.match("[A-Za-z-]", text[run.end() : run.end() + 1])
        for i, (a, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                if digits >= 13 and not (j == last and open_end):
                    span = base + a, base + groups[j][1]
                    (printed if _PRINTED.fullmatch(text, *span) else others).append(span)
    length = lambda x: x[0] - x[1]
    return sorted(printed, key=length) + sorted(others, key=length)


def _bank_parts(text: str) -> list[tuple[int, int]]:
    """From each beginning of a bank number the length of its country, or every length if the country has none, that ends with a word."""
    spans = []
    for m in _BANK_START.finditer(text):
        ends = [m.end() + k for k, c in enumerate(m[1], 1) if c != " "]  # of lengths 5 and more
        known = BANK_LENGTHS.get(m[0][:2])
        for n in [known] if known else range(34, 14, -1):
            if n - 5 < len(ends) and not re.match(r"\w", text[ends[n - 5] : ends[n - 5] + 1]) and _BANK.fullmatch(text, m.start(), ends[n - 5]):
                spans.append((m.start(), ends[n - 5]))
    return spans


def _phone_parts(text: str) -> list[tuple[int, int]]:
    """The beginnings of each match that end with a group of digits, the longest first: other numbers can follow."""
    return [(m.start(), m.start() + g.end()) for m in _PHONE.finditer(text) for g in reversed(list(re.finditer("[0-9]+", m[0])))]


#: Where else a value can be, in the order of trial, if the pattern's match is not valid.
PARTS = {"card": _card_parts, "bank": _bank_parts, "phone": _phone_parts}
#: Whether a text can have any of them: an @, or three digits not far from each other.
_MAYBE = re.compile(r"@|[0-9](?:[^0-9]{0,3}[0-9]){2}")


def find(text: str) -> list[tuple[int, int, str, re.Match, Callable]]:
    """(start, end, kind, match, rule) of validated values that do not overlap, by place."""
    taken: list[tuple] = []
    if not _MAYBE.search(text):
        return taken
    for kind, pattern, rule in KINDS:
        taken += [(m.start(), m.end(), kind, m, rule) for m in pattern.finditer(text)]
    return sorted(taken, key=lambda x: x[0])


#: Characters between a part and values that are permuted together with it.
NEAR = 40


def _chosen(text: str, f: Feistel, back: bool) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, whether it is a part, new value) of the values to replace, by place; kinds in their order, matches before parts."""
    found, chosen, taken = find(text), [], []

    def free(start: int, end: int) -> bool:
        at = bisect(taken, (end,))  # those before it begin before the end
        return not at or taken[at - 1][1] <= start

    for kind, _, rule in KINDS:
        spans, failed = [(m.start(), m.end(), m, False) for _, _, of, m, _ in found if of == kind], False
        for parts in (False, True):
            if parts:
                spans = [(a, b, _WHOLE.fullmatch(text, a, b), True) for a, b in PARTS[kind](text)] if failed and kind in PARTS else []
            for start, end, m, part in spans:
                if free(start, end) and (new := rule(f, m, back)) is not None:
                    chosen.append((start, end, kind, part, new))
                    insort(taken, (start, end))
                else:
                    failed = True
    return sorted(chosen)


def _put(text: str, chosen: list[tuple[int, int, str, bool, str]]) -> str:
    out, at = [], 0
    for start, end, _, _, new in chosen:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def pseudonymize(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, start, end) of each in the given text; back undoes it.

    New values of parts can look valid together with their neighbours. Then a part and the values near it are permuted
    once more, until the same spans are found again: so back finds them too, but equal values can differ there.
    """
    chosen = _chosen(text, f, back)
    parts = [x for x in chosen if x[3]]
    if parts:
        rules = {kind: (_WHOLE if kind in PARTS else pattern, rule) for kind, pattern, rule in KINDS}
        begins = [p[0] for p in parts]  # parts do not overlap, so that their ends are in order, too
        moving = [x for x in chosen if (k := bisect(begins, x[1] + NEAR - 1)) and parts[k - 1][1] + NEAR > x[0]]
        while [x[:4] for x in _chosen(_put(text, moving), f, back)] != [x[:4] for x in chosen]:
            moving = [(*x[:4], rules[x[2]][1](f, rules[x[2]][0].fullmatch(x[4]), back)) for x in moving]
        moved = {x[:2] for x in moving}
        chosen = sorted([x for x in chosen if x[:2] not in moved] + moving)
    return _put(text, chosen), [(kind, start, end) for start, end, kind, _, _ in chosen]


def pseudonyms(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with text replaced by its pseudonymized form, and `found`: array of (kind, start, end), in code points.

    Null and empty texts stay as they are, with nothing found. Repeated rows and ids are treated one by one; other
    columns stay, but for a former column `found`.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("found")
    names, at = docs.columns, docs.columns.index("text")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts, found = [], []
                for text in part.column(at).to_pylist():
                    new, spans = pseudonymize(text, f, back) if text else (text, [])
                    texts.append(new)
                    found.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, span)], names=[*names, "found"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, "found array<struct<kind:string,start:bigint,end:bigint>>"]))


def pseudonym_report(docs: DataFrame) -> DataFrame:
    """Per document the counts by kind, all spans, and the new text."""
    done = pseudonyms(docs.select("doc_id", "text"), QUERY_KEY)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select(
        "doc_id",
        *[count(kind) for kind, _, _ in KINDS],
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
        "text",
    )
