"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document, from one pass over its text. The
ledger keeps the measurements and a mask with a bit for each failed rule; whether
a document is kept is a policy over the mask, so that another version of the
policy, or the effect of leaving a rule out, needs no text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LETTER = re.compile(rb"[A-Za-z\xc3-\xf4]")
#: The measurements of a document, all longs.
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words",
    "n_distinct_words", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines", "longest_word",
]


def measure(text: bytes | None) -> list[int]:
    """The ``MEASURES`` of a text; a null text measures as the empty one.

    Words are runs of characters other than ASCII white space; lines end at line
    feeds and count if they have a word; a repeated word lies in a window of three
    words that the text has twice or more. A word has a letter if it has an ASCII
    letter or a character beyond ASCII.
    """
    data = text or b""
    words = data.split()
    n = len(words)
    seen: set[bytes] = set()
    lines = dup_lines = dup_chars = bullets = ellipses = 0
    for line in data.split(b"\n"):
        bare = line.strip(_SPACE)
        if not bare:
            continue
        lines += 1
        bullets += bare.startswith((b"- ", b"* ", b"\xe2\x80\xa2"))
        ellipses += bare.endswith((b"...", b"\xe2\x80\xa6"))
        if line in seen:
            dup_lines += 1
            dup_chars += _code_points(bare)
        seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    return [
        n, _code_points(data.translate(None, _SPACE)), len(_SYMBOLS.findall(data)), lines, dup_lines, dup_chars, repeated_words(ids, len(number)), len(number),
        sum(1 for w in words if _LETTER.search(w)), bullets, ellipses, max(map(len, words), default=0),
    ]


def _code_points(data: bytes) -> int:
    """Code points of UTF-8: its bytes but for continuations."""
    return len(data.translate(None, bytes(range(0x80, 0xC0))))


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Positions covered by windows of three that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if n_distinct < 1 << 21:
        window = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:  # too many words for one number: number the pairs first
        _, pair = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)
        window = pair[:-1] * n_distinct + ids[2:]
    order = np.argsort(window, kind="stable")
    sorted_ = window[order]
    same = sorted_[1:] == sorted_[:-1]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """A rule's bit is 1 << its place in the list; ``fails`` is a condition on the measurements."""

    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: The order is part of the ledger's format: add new rules at the end.
RULES = [
    Rule("few_words", lambda: _c("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("short_words", lambda: 10 * _c("word_chars") < 22 * _c("n_words")),
    Rule("long_words", lambda: _c("word_chars") > 14 * _c("n_words")),
    Rule("many_symbols", lambda: 100 * _c("n_symbols") > 10 * _c("n_words")),
    Rule("few_letters", lambda: 100 * _c("n_letter_words") < 60 * _c("n_words")),
    Rule("repeated_lines", lambda: (_c("n_lines") >= 4) & (100 * _c("n_dup_lines") > 30 * _c("n_lines"))),
    Rule("bullets", lambda: (_c("n_lines") >= 4) & (100 * _c("n_bullet_lines") > 90 * _c("n_lines"))),
    Rule("ellipses", lambda: (_c("n_lines") >= 4) & (100 * _c("n_ellipsis_lines") > 30 * _c("n_lines"))),
    Rule("endless_word", lambda: _c("longest_word") > 1000),
]
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def failed_mask() -> Column:
    """The failure bits of a row of measurements."""
    mask = F.lit(0).cast("long")
    for rule in RULES:
        mask = mask + F.when(rule.fails(), F.lit(BIT[rule.name])).otherwise(0).cast("long")
    return mask


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails a rule of ``hard``, or ``at_least`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    at_least: int = 2

    def masks(self) -> tuple[int, int]:
        return sum(BIT[x] for x in self.hard), sum(BIT[x] for x in self.soft)

    def kept(self, mask: Column) -> Column:
        hard, soft = self.masks()
        few = F.bit_count(mask.bitwiseAND(F.lit(soft).cast("long"))) < self.at_least
        return (mask.bitwiseAND(F.lit(hard).cast("long")) == 0) & few


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = [
    BASE,
    Policy("v1", (*BASE.hard, "many_symbols", "few_letters", "repeated_lines", "bullets", "ellipses", "endless_word")),
    Policy("v2", (*BASE.hard, "many_symbols", "few_letters"), ("short_words", "long_words", "repeated_lines", "bullets", "ellipses", "endless_word"), 2),
]
CURRENT = POLICIES[-1]


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (the mask) of each row of ``docs``.

    Null ids and repeated rows stay; a null text is an empty one; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, k]) for k in range(len(MEASURES))]], ["doc_id", *MEASURES])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = rows.mapInArrow(run, ", ".join(f"{x} long" for x in ("doc_id", *MEASURES)))
    return out.withColumn("failed", failed_mask())


def verdicts(entries: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """The ledger with a column ``kept_<version>`` for each policy: nothing is measured again."""
    return entries.withColumns({f"kept_{p.version}": p.kept(F.col("failed")) for p in policies})


def ablations(entries: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """For each policy and rule, what the rule does there.

    ``n_failed`` documents fail the rule, ``n_rejected`` are rejected by the policy,
    and ``n_rescued`` of these would be kept without the rule. Documents are first
    counted by mask; there are at most 2 ** rules masks, whatever the documents are.
    """
    by_mask = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for p in policies:
        for name in sorted({*p.hard, *p.soft}, key=BIT.get):
            without = F.col("failed").bitwiseAND(F.lit(~BIT[name]).cast("long"))
            rows.append(F.struct(
                F.lit(p.version).alias("version"), F.lit(name).alias("rule"),
                F.col("failed").bitwiseAND(F.lit(BIT[name]).cast("long")).alias("bit"),
                p.kept(F.col("failed")).alias("kept"), p.kept(without).alias("kept_without"),
            ))
    each = by_mask.select("n", F.explode(F.array(*rows)).alias("x")).select("n", "x.*")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(
        count(F.col("bit") != 0).alias("n_failed"), count(~F.col("kept")).alias("n_rejected"),
        count(~F.col("kept") & F.col("kept_without")).alias("n_rescued"),
    )


def apply(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns.

    Measured in place, so that rows with equal or null ids keep their own verdicts. A
    null text is an empty one; an empty table gives no rows; columns may have any names.
    """
    mask = common.unused(docs.columns, "failed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(None if x is None else x.encode()) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
            measured = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, measured], [*batch.schema.names, mask])

    fields = ", ".join(f"{x}: long" for x in MEASURES)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    out = docs.mapInArrow(run, ", ".join([*columns, f"{mask} struct<{fields}>"]))
    # the measures become columns beside one struct of all that the rows had
    out = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), f"{mask}.*")
    return out.filter(policy.kept(failed_mask())).select("doc.*")
