"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the measurements and a bit per
failed rule; a policy is a versioned set of rules, so applying one, comparing two or taking a rule
out is bitwise work on the stored bits, without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.words import BASES, RangeHash, mix, plain, slices, sums, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letter_words", "longest_word")
LEDGER_TYPE = ", ".join(f"{name} long" for name in MEASURES)


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measurements; the rule's bit is its place in ``RULES``."""

    name: str
    fails: str


#: New rules go to the end: a bit keeps its meaning in ledgers already written.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letter_words < n_words"),
    Rule("huge_word", "longest_word > 1000"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versions stay as they are once used; a change of mind is a new version.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "few_letters"),
}
PRODUCTION = "1"


def repeated_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each document within 8-word windows that it has twice or more."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(len(codes))
    at = at[at + WINDOW <= np.repeat(starts[1:], np.diff(starts))]
    if not len(at):
        return np.zeros(len(starts) - 1, np.int64)
    hashes = RangeHash(mix(codes.astype(np.uint64) + np.uint64(1))).of(at, at + WINDOW)
    hashes = mix(hashes + doc[at].astype(np.uint64) * np.uint64(BASES[1]))
    order = np.argsort(hashes)
    one, two = order[:-1], order[1:]
    same = hashes[one] == hashes[two]
    one, two = at[one[same]], at[two[same]]
    equal = doc[one] == doc[two]
    for k in range(WINDOW):
        equal &= codes[one + k] == codes[two + k]
    if not equal.all():  # different windows with one hash: group the windows themselves
        rows = np.column_stack([doc[at], *(codes[at + k] for k in range(WINDOW))])
        _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        one = two = at[count[group.ravel()] > 1]
    marks = np.zeros(len(codes) + 1, np.int64)
    hit = np.unique(np.concatenate([one, two]))
    marks[hit] += 1
    marks[hit + WINDOW] -= 1
    return sums(np.cumsum(marks)[:-1] > 0, starts)


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line, for each text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    doc = np.asarray(pc.list_parent_indices(lists))
    real = np.asarray(pc.binary_length(pc.ascii_trim(lines, " \t\n\v\f\r"))) > 0
    doc, codes = doc[real], np.asarray(lines.filter(pa.array(real)).dictionary_encode().indices, dtype=np.int64)
    n = np.bincount(doc, minlength=len(texts))
    distinct = np.unique(doc * (len(codes) + 1) + codes) // (len(codes) + 1)
    return n, n - np.bincount(distinct, minlength=len(texts))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    found = words(texts)
    n, starts = found.counts, found.starts
    chars = np.asarray(pc.utf8_length(found.vocabulary), dtype=np.int64)
    letters = np.asarray(pc.match_substring_regex(found.vocabulary, r"\pL")).astype(np.int64)
    word_chars = chars[found.codes] if len(chars) else found.codes
    longest = np.zeros(len(n), np.int64)
    if len(found.codes):
        longest[n > 0] = np.maximum.reduceat(word_chars, starts[:-1][n > 0])
    lines, repeated = line_counts(texts)
    return {
        "n_words": n,
        "word_chars": found.sums(word_chars),
        "n_symbols": np.asarray(pc.count_substring_regex(texts, f"[{SYMBOLS}]"), dtype=np.int64),
        "n_dup_lines": repeated,
        "n_lines": lines,
        "n_repeat_words": repeated_words(found.codes, starts),
        "n_letter_words": found.sums(letters[found.codes] if len(letters) else found.codes),
        "longest_word": longest,
    }


def measures(text: Column) -> Column:
    """A struct of all measurements of a text column."""

    @F.arrow_udf(LEDGER_TYPE)
    def values(texts: pa.Array) -> pa.Array:
        texts = plain(texts)
        parts = [measure(texts.slice(a, b - a)) for a, b in slices(texts)]
        columns = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))

    return values(text)


def ledger(docs: DataFrame, text_col: str = "text", name: str = "_ledger") -> DataFrame:
    """``docs`` with a struct ``name`` of the measurements and the failure bits ``bits``.

    A null text counts as empty. Rows, their order and other columns stay, whatever their names; a column
    called ``name`` raises ``ValueError``, see ``store.free_name`` for one that is free.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {name} already")
    measured = docs.withColumn(name, measures(F.col(text_col)))
    row = F.col(name)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        fails = F.expr(_of(rule.fails, name))
        bits = bits.bitwiseOR(F.when(fails, F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn(name, F.struct(*[row[m].alias(m) for m in MEASURES], bits.alias("bits")))


def _of(condition: str, struct: str) -> str:
    return " ".join(f"{struct}.{word}" if word in MEASURES else word for word in condition.split())


def mask(rules: tuple[str, ...]) -> int:
    return sum(BIT[name] for name in rules)


def passes(bits: Column, policy: str) -> Column:
    """Whether a document with these failure bits is kept under a policy of ``POLICIES``."""
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(bits: DataFrame, policy: str, column: str = "bits") -> DataFrame:
    """``rule, failed, only_this, kept_without``: what each rule of a policy rejects, from failure bits alone.

    only_this counts documents that no other rule of the policy rejects; kept_without is how many
    the policy keeps when the rule is taken out. One aggregation with a map-side part; a row a rule.
    """
    whole = mask(POLICIES[policy])
    held = F.col(column).bitwiseAND(F.lit(whole).cast("long"))
    counts = []
    for name in POLICIES[policy]:
        others = F.lit(whole ^ BIT[name]).cast("long")
        counts += [
            F.count_if(held.bitwiseAND(F.lit(BIT[name]).cast("long")) != 0).alias(f"{name}.failed"),
            F.count_if(held == BIT[name]).alias(f"{name}.only"),
            F.count_if(held.bitwiseAND(others) == 0).alias(f"{name}.without"),
        ]
    total = bits.agg(*counts)
    rows = [
        F.struct(
            F.lit(name).alias("rule"), F.col(f"`{name}.failed`").alias("failed"),
            F.col(f"`{name}.only`").alias("only_this"), F.col(f"`{name}.without`").alias("kept_without"),
        )
        for name in POLICIES[policy]
    ]
    return total.select(F.inline(F.array(*rows)))
