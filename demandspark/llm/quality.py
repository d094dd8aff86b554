"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text. Rules are tried in turn and the first that rejects ends the trial, so
what a later rule would cost is saved for every text that an earlier one rejects. Their order is
found on a sample: each rule is run over it by itself, which gives its seconds a row (least of
``TRIALS`` runs, less what reading the sample takes) and the share that it rejects; rules then go
by rejections per second, most first. A text is kept if no rule rejects it, so the order
changes the work and never the result; the sample (at most ``SAMPLE`` rows) sets nothing else.

The base counts of ``counts`` work on whole texts row by row: nothing is shuffled, and a row's
work grows with its length times the logarithm of it. Repeated three-word windows are found by
sorting one long for each window (hash bits above, place below); windows of equal hash are
compared word by word.

Words are runs without white space (space, tab, line feed, vertical tab, form feed, carriage
return), case counts. Null counts as an empty text: no words, so the base rule on ``MIN_WORDS``
rejects it. Repeated rows are judged alike; ids are carried along, null ids too; no order of
rows matters.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.store import free_name, temporary, written

MIN_WORDS = 50
#: Rows on which cost and selectivity of the rules are estimated, at most.
SAMPLE = 2_000
TRIALS = 3
SYMBOLS = "#*$%&|<>"
_SPACE = r"\x20\x09-\x0D"
_WORD = rf"[^{_SPACE}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{_SPACE}]+"), "")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))


def repeat_words(w: Column, size: int = 3) -> Column:
    """Of the array ``w`` the words in windows of ``size`` words that are found twice or more."""
    n = F.size(w)
    room = n - F.lit(size - 1)
    windows = F.arrays_zip(*[F.slice(w, F.lit(k + 1), room).alias(f"w{k}") for k in range(size)])
    # So many bits hold any place.
    width = F.length(F.bin(n))
    shift = lambda name, value: F.call_function(name, value, width)

    def place(packed: Column) -> Column:
        return packed.bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1)

    def counted(z: Column) -> Column:
        packed = F.sort_array(F.transform(z, lambda x, i: shift("shiftleft", F.xxhash64(x)).bitwiseOR(i.cast("long"))))

        def covered(s: Column) -> Column:
            def equal(a: Column, b: Column) -> Column:
                at = lambda p: F.get(z, place(p).cast("int"))
                same = (shift("shiftright", a) == shift("shiftright", b)) & (at(a) == at(b))
                return F.when(same, F.array(place(a), place(b)))

            both = F.filter(F.zip_with(s, F.slice(s, F.lit(2), n), equal), lambda x: x.isNotNull())
            places = F.sort_array(F.array_distinct(F.flatten(both)))
            # The last place has no next one; least() skips its null.
            steps = lambda p: F.zip_with(p, F.slice(p, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(size).cast("long")))
            return F.aggregate(let(places, steps), F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(packed, covered)

    return F.when(n >= size, let(windows, counted)).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """A struct of the base counts of a text column: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words."""
    long = lambda c, name: c.cast("long").alias(name)

    def of(t: Column) -> Column:
        dup_lines = let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return let(
            words(t),
            lambda w: F.struct(
                long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(F.regexp_count(t, F.lit(f"[{SYMBOLS}]")), "n_symbols"),
                long(dup_lines, "n_dup_lines"), long(repeat_words(w), "n_repeat_words"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def base_fails(c: Column) -> Column:
    """Whether the counts fail the base: too few words, or over half of them in repeated windows."""
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a boolean column, never null, from a text column (not null)."""

    name: str
    rejects: Callable[[Column], Column]


def _share(part: Column, of: Column, over: int) -> Column:
    """Whether ``part`` is over so many percent of ``of``."""
    return 100 * part.cast("long") > over * of.cast("long")


def _letters(text: Column) -> Column:
    """Characters that are letters: Latin ones and all beyond ASCII."""
    return F.regexp_count(text, F.lit(r"[A-Za-z\x{80}-\x{10FFFF}]"))


#: All are shares of exact counts. Limits are wide, so that only text that is hardly prose goes.
RULES = (
    Rule("mean_word_length", lambda t: let(words(t), lambda w: let(F.length(F.array_join(w, "")), lambda n: (n < 2 * F.size(w)) | (n > 20 * F.size(w))))),
    Rule("symbols", lambda t: _share(F.regexp_count(t, F.lit(f"[{SYMBOLS}]")), F.regexp_count(t, F.lit(f"{_WORD}+")), 20)),
    Rule("few_letters", lambda t: _share(F.length(t) - _letters(t), F.length(t), 50)),
    Rule("digits", lambda t: _share(F.regexp_count(t, F.lit("[0-9]")), F.length(t), 30)),
    Rule("upper_case", lambda t: _share(F.regexp_count(t, F.lit("[A-Z]")), F.length(t), 50)),
    Rule("duplicate_lines", lambda t: let(lines(t), lambda x: _share(F.size(x) - F.size(F.array_distinct(x)), F.size(x), 50))),
    Rule("bullet_lines", lambda t: let(lines(t), lambda x: _share(F.size(F.filter(x, lambda y: y.rlike(rf"^[{_SPACE}]*[*•-]"))), F.size(x), 90))),
    Rule("cut_lines", lambda t: let(lines(t), lambda x: _share(F.size(F.filter(x, lambda y: y.rlike(rf"(\.\.\.|…)[{_SPACE}]*$"))), F.size(x), 50))),
)


@dataclass(frozen=True)
class Measured:
    """A rule, its seconds a row and the share of the sample that it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE) -> list[Measured]:
    """The rules in the order of the cascade, with what the sample shows of them.

    The sample is drawn from all of ``docs`` (a fraction of ``rows`` by the count), so it is
    bounded whatever the table's size.
    """
    spark = docs.sparkSession
    text = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = docs.count()
    with temporary(spark):
        sample = written(text.sample(min(1.0, rows / max(n, 1)), seed=17).limit(rows).coalesce(1), "rule-sample")

        def run(rejects: Column) -> tuple[float, int, int]:
            least = float("inf")
            for _ in range(TRIALS):
                began = time.perf_counter()
                total, hits = sample.agg(F.count("*"), F.count_if(rejects)).first()
                least = min(least, time.perf_counter() - began)
            return least, total, hits

        idle, total, _ = run(F.length("t") < 0)
        out = []
        for rule in rules:
            seconds, _, hits = run(rule.rejects(F.col("t")))
            out.append(Measured(rule, max(seconds - idle, 1e-6) / max(total, 1), hits / max(total, 1)))
    return sorted(out, key=lambda m: -m.gain)


def passes(text: Column, order: Sequence[Rule]) -> Column:
    """Whether no rule rejects the text; rules after the first that does aren't evaluated."""
    out = F.lit(True)
    for rule in reversed(order):
        out = F.when(rule.rejects(text), F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every
    row. The base counts are asked for of every text; the cascade runs where the base doesn't fail."""
    order = [m.rule for m in measured(docs, rules, text)]
    rows = docs.select(F.col(id_col), F.col(text).alias("t"), counts(F.col(text)).alias("c"))
    rows = rows.select(id_col, "t", "c", base_fails(F.col("c")).alias("base_failed"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(F.coalesce("t", F.lit("")), order))
    return rows.select(id_col, "c.*", "base_failed", kept.alias("kept"))


def good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` without rejected rows; the base rules take part in the cascade, so a text that an
    earlier rule rejects isn't counted."""
    few = Rule("few_words", lambda t: F.size(words(t)) < MIN_WORDS)
    repeated = Rule("repeated_words", lambda t: let(words(t), lambda w: 2 * repeat_words(w) > F.size(w)))
    order = [m.rule for m in measured(docs, (few, repeated, *rules), text)]
    at = free_name(docs, "kept")
    return docs.withColumn(at, passes(F.coalesce(F.col(text), F.lit("")), order)).where(at).drop(at)


def _oracle() -> str:
    def regex(pattern: str) -> str:
        return f"len(regexp_extract_all(t, '{pattern}'))"

    letters = regex(r"[A-Za-z\x{80}-\x{10FFFF}]")
    bullets = r"len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[*•-]')))"
    cut = r"len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))"
    dup = "(len(l) - len(list_distinct(l)))"
    rejects = [
        "word_chars < 2 * n_words", "word_chars > 20 * n_words", "100 * n_symbols > 20 * n_words", f"100 * (length(t) - {letters}) > 50 * length(t)",
        f"100 * {regex('[0-9]')} > 30 * length(t)", f"100 * {regex('[A-Z]')} > 50 * length(t)", f"100 * {dup} > 50 * len(l)", f"100 * {bullets} > 90 * len(l)", f"100 * {cut} > 50 * len(l)",
    ]
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                     list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
        m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM m) GROUP BY r),
        f AS (SELECT doc_id, t, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                {regex(f'[{SYMBOLS}]')}::BIGINT AS n_symbols, {dup}::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (r)),
        b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR {' OR '.join(rejects)}) AS kept FROM b"""


ORACLE_SQL = _oracle()
