"""Text functions: normal forms, token sets, numbers, values in answers, splitting."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip().casefold())


@F.pandas_udf(T.StringType())
def _folded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(_plain, na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefolded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _compared(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()), na_action="ignore")


def normalize_ascii(text: Column) -> Column:
    """normalize_text for texts of ASCII characters only, inside the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))


def normalize_text(text: Column) -> Column:
    """NFKC, stripped, case-folded, white space collapsed; leaves the JVM for texts beyond ASCII only through one Arrow UDF."""
    return _folded(text)


def plain(text: Column) -> Column:
    """normalize_text, with only the texts beyond ASCII leaving the JVM."""
    ascii_only = text.rlike(r"\A[\x00-\x7F]*\z")
    return F.coalesce(F.when(ascii_only, normalize_ascii(text)), _folded(F.when(~ascii_only, text)))


def lowered(text: Column) -> Column:
    """Lower case letter by letter, runs of ASCII white space as one space, no spaces at the ends; never leaves the JVM. Unlike
    normalize_text it keeps ß, ligatures and wide forms apart from what they stand for."""
    one = F.regexp_replace(F.lower(F.translate(text, "İΣ", "iσ")), r"[\t\n\f\r ]+", " ")
    return F.regexp_replace(one, r"\A\p{Zs}+|\p{Zs}+\z", "")


def folded(text: Column) -> Column:
    """The text case-folded (ß is ss), with only the texts beyond ASCII leaving the JVM."""
    ascii_only = text.rlike(r"\A[\x00-\x7F]*\z")
    return F.coalesce(F.when(ascii_only, F.lower(text)), _casefolded(F.when(~ascii_only, text)))


#: Parts the values of a list while they are normalized together; no normal form changes it.
PART = "\u241e"


def plain_values(values: Column) -> Column:
    """The normalized values of an array<string> that are not empty."""
    joined = plain(F.array_join(values, PART))
    return F.filter(F.split(joined, f" ?{PART} ?"), lambda x: x != "")


def squeeze(text: Column) -> Column:
    """Case-folded and without any white space, to compare values."""
    return F.regexp_replace(folded(text), r"(?U)\s+", "")


def squeezed_values(values: Column) -> Column:
    """The squeezed values of an array<string> that are not empty."""
    return F.filter(F.split(squeeze(F.array_join(values, PART)), PART), lambda x: x != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _casefolded_each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: [None if t is None else t.casefold() for t in x], na_action="ignore")


def squeezed_together(texts: dict[str, Column], values: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
    """Adds squeeze of texts and squeezed_values of arrays under their names. All of a row leave the JVM in one step, as each
    call of a Python function has a process of its own in every task."""
    names = [*texts, *values]
    raw = F.array(*texts.values(), *(F.array_join(v, PART) for v in values.values()))
    ascii_only = lambda t: t.rlike(r"\A[\x00-\x7F]*\z")
    python = _casefolded_each(F.transform(raw, lambda t: F.when(~ascii_only(t), t)))

    def add(df: DataFrame) -> DataFrame:
        out = df.withColumns({"_raw": raw, "_python": python})
        folded = [F.coalesce(F.col("_python")[i], F.lower(F.col("_raw")[i])) for i in range(len(names))]
        squeezed = {n: F.regexp_replace(f, r"(?U)\s+", "") for n, f in zip(names, folded)}
        return out.withColumns({n: F.filter(F.split(c, PART), lambda x: x != "") if n in values else c for n, c in squeezed.items()}).drop("_raw", "_python")

    return add


def normalize_lines(text: Column) -> Column:
    """Line ends as LF, characters composed (NFC)."""
    return _composed(F.regexp_replace(text, "\r\n?", "\n"))


def comparison_text(text: Column) -> Column:
    """NFKC with single spaces, case kept."""
    return _compared(text)


#: The word forms that count as tokens of a question (latin words, numbers, short runs of Han characters).
LATIN_WORD, NUMBER, HAN_RUN = r"[A-Za-z][A-Za-z0-9_.-]{1,}", r"[0-9]+(?:\.[0-9]+)?", r"[\u4e00-\u9fff]{2,8}"


def tokens(text: Column) -> Column:
    """The distinct lower-case tokens of a text, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"{LATIN_WORD}|{NUMBER}|{HAN_RUN}"), F.lit(0)), F.lower))


def word_set(text: Column) -> Column:
    """The distinct case-folded alphanumeric words of a text."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit("[a-z0-9_.-]+|" + HAN_RUN), F.lit(0)))


#: The forms of a number from fine to coarse; those that cannot hold it are null.
NUMBER_FORMS = ("fine", "large", "any")


def numbers(text: Column) -> Column:
    """The signed numbers of a text as structs of NUMBER_FORMS: decimals of up to 20 and 32 integer digits, and a double for
    any; commas part thousands; no digit or dot may touch them."""
    pattern = r"(?<![0-9.])[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?![0-9.])"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def forms(x: Column) -> Column:
        bare = F.replace(x, F.lit(","), F.lit(""))
        return F.struct(*[bare.try_cast(kind).alias(name) for name, kind in zip(NUMBER_FORMS, ("decimal(38,18)", "decimal(38,6)", "double"))])

    return F.transform(found, forms)


def contains_value(text: Column, value: Column) -> Column:
    """Whether value occurs in text; at an ASCII letter or digit of its edges no further one may follow."""
    edge = "[A-Za-z0-9]"
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    left = F.when(value.rlike(f"^{edge}"), f"(?<!{edge})").otherwise("")
    right = F.when(value.rlike(f"{edge}$"), f"(?!{edge})").otherwise("")
    return F.when(value == "", F.lit(False)).otherwise(F.regexp_like(text, F.concat(left, quoted, right)))


def contains_unit(text: Column, unit: Column) -> Column:
    """Whether a unit occurs, both normalized: as a word if it is of ASCII letters only, else anywhere; never an empty one."""
    word = F.regexp_like(text, F.concat(F.lit("(?<![a-z])"), unit, F.lit("(?![a-z])")))
    return F.when(unit == "", F.lit(False)).when(unit.rlike("^[a-z]+$"), word).otherwise(F.contains(text, unit))


#: Phrases by which an answer declines.
DECLINES = (
    r"\bnot (?:mentioned|provided|specified|stated)\b",
    r"\b(?:cannot|can't|unable to) (?:determine|answer|provide)\b",
    r"\binsufficient information\b",
    r"(?:文档|上下文).{0,15}(?:没有|不存在|未提供|未提及|未包含)",
    r"(?:无法|不能)(?:提供|给出|确定|回答)",
)


def declines(text: Column) -> Column:
    """Whether a normalized answer looks like an abstention."""
    out = F.lit(False)
    for pattern in DECLINES:
        out = out | text.rlike(pattern)
    return out


#: The heading behind which an answer lists its sources, what makes it ambiguous, what introduces its value,
#: and what may follow the value.
SOURCES = r"(?is)(?:^|\n)\s{0,3}#{1,6}\s*(?:references?|sources?|citations?|参考资料|参考文献|引用|来源)\b.*$"
AMBIGUOUS = r"(?i)(?:不是|并非|非\s*[^。；;，,]*$|而不是|或者|或是|还是|either|or|not)|(?:\bno\b|\bneither\b)"
INTRODUCED = r"(?i)(?:是|为|:|：|=|\bis\b)\s*$"
CLOSED = r"[\s。．.!！?？,，;；:：\)）\]】]*"


def states_one_value(answer: str, values: list[str]) -> bool:
    """Whether an answer is a plain statement of one value: named once among all values, introduced as such, with only
    punctuation behind it, without negations or alternatives; its list of sources does not count."""
    body = re.split(SOURCES, answer, maxsplit=1)[0].strip()
    if not body or re.search(AMBIGUOUS, body):
        return False
    said = _plain(body)
    found = [m.span(1) for v in map(_plain, values) if v for m in re.finditer(f"(?=({re.escape(v)}))", said)]
    return len(found) == 1 and bool(re.search(INTRODUCED, said[: found[0][0]]) and re.fullmatch(CLOSED, said[found[0][1] :]))


@F.pandas_udf(T.BooleanType())
def unambiguous_statement(answers: pd.Series, values: pd.Series) -> pd.Series:
    """states_one_value of an answer and an array of values."""
    return pd.Series([a is not None and v is not None and states_one_value(a, [x for x in v if x]) for a, v in zip(answers, values)], dtype=bool)


_FORMULA = re.compile(r"\\mathrm\{eta\}|\\frac|\\left|\\right|\\times|\\cdot|.")


def canonical_formula_text(text: str) -> str:
    """A formula's comparable form: eta spelled out, a fraction of groups as a/b, products unwritten; of the rest the letters,
    digits and _=/+.- stay."""
    read = _FORMULA.findall(re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).casefold()))

    @cache
    def group(at: int) -> tuple[str, int] | None:
        """The form of the brace group that begins there, and its end; None if it has further groups within, or is empty."""
        if read[at : at + 1] != ["{"]:
            return None
        out, at = "", at + 1
        while at < len(read) and read[at] not in "{}":
            more, at = one(at)
            if more is None:
                return None
            out += more
        return (out, at + 1) if read[at : at + 1] == ["}"] and out else None

    def one(at: int) -> tuple[str | None, int]:
        token = read[at]
        if token == "\\frac":
            above = group(at + 1)
            below = above and group(above[1])
            return (f"{above[0]}/{below[0]}", below[1]) if below else (None if read[at + 1 : at + 2] == ["{"] else "frac", at + 1)
        return {"\\mathrm{eta}": "eta", "\u03b7": "eta", "\\left": "", "\\right": "", "\\times": "", "\\cdot": ""}.get(token, token if re.fullmatch("[a-z0-9_=/+.-]", token) else ""), at + 1

    out, at = "", 0
    while at < len(read):
        more, at = one(at)
        out += "frac" if more is None else more
    return out


@F.pandas_udf(T.StringType())
def canonical_formula(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(canonical_formula_text, na_action="ignore")


#: Characters behind which a text may be split.
BOUNDARIES = "\n。！？；.!?;，,、：:"


def split_text(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters that join to the text; each ends behind the window's last boundary, if any."""
    out, at = [], 0
    while len(text) - at > most:
        cut = 1 + max(text.rfind(c, at, at + most) for c in BOUNDARIES)
        cut = cut if cut > at else at + most
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out


def pieces(text: Column, most: int) -> Column:
    """array<string> of split_text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: split_text(x, most), na_action="ignore")

    return run(text)


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote occurs without overlap; 0 for the empty quote."""
    gone = F.char_length(text) - F.char_length(F.replace(text, quote, F.lit("")))
    return F.when(quote == "", F.lit(0)).otherwise((gone / F.char_length(quote)).cast("bigint")).cast("bigint")


def head_and_tail(text: Column, most: int, marker: str = "\n...\n") -> Column:
    """Three quarters of `most` characters from the beginning and a quarter from the end, if the text is longer."""
    head = most * 3 // 4
    tail = most - head
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail))))


def topic(sentence: Column, most: int = 28) -> Column:
    """A sentence's topic: its first clause, without numbering, before its copula."""
    first = F.regexp_extract(sentence, "^[^.,;:!?\n\u3002\uff0c\uff1b\uff1a]*", 0)
    bare = F.regexp_replace(first, r"^\s*(?:[0-9]+[.)]?)*\s*", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?i)\s+(?:is|are|was|were)\s.*$|\u662f.*$", "")), 1, most)


def overlap_score(question: Column, document: Column) -> Column:
    """The size of the common token set."""
    return F.size(F.array_intersect(tokens(question), tokens(document))).cast("bigint")


def strip_markup(text: Column) -> Column:
    """Text without comments, scripts, styles and tags, white space collapsed."""
    out = F.regexp_replace(text, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))
