"""Quality rules: a ledger of measurements and failure bits, and policies over it.

Every rule is evaluated once. The ledger keeps the measurements and one bit for
each failed rule. A policy is a versioned set of rules, that is a mask; applying
one, or asking what each rule contributes, needs bit operations only.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm._shared import WHITE, WORD

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_letters")
SYMBOLS = "#*$%&|<>"

#: Rule name -> bit and failure condition over the measurements. Bits are never reused.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    "short_words": (4, "n_words > 0 and word_chars < 2 * n_words"),
    "long_words": (5, "n_words > 0 and word_chars > 15 * n_words"),
    "shouting": (6, "n_letters >= 100 and 10 * n_caps > 8 * n_letters"),
    "no_letters": (7, "n_words > 0 and 2 * n_letters < word_chars"),
}
#: Version -> rules. A published version never changes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting", "no_letters"),
}


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Positions covered by windows of 8 ids that occur twice or more; exact, by doubling of ranks."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    ranks, width = ids, 1
    while width < window:
        left, right = ranks[:-width], ranks[width:]
        distinct, ranks = np.unique(left * (int(ranks.max()) + 1) + right, return_inverse=True)
        width *= 2
        if len(distinct) == len(ranks):
            return 0
    again = np.bincount(ranks)[ranks] > 1
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(again), 1)
    np.add.at(steps, np.flatnonzero(again) + window, -1)
    return int(np.count_nonzero(np.cumsum(steps)))


def measure(text: str, word=re.compile(WORD), letter=re.compile(r"[^\W\d_]+"), upper=re.compile(r"[A-ZÀ-ÖØ-Þ]+")) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = word.findall(text)
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            again += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in WHITE),
        sum(text.count(c) for c in SYMBOLS),
        again,
        repeated_words(ids) if len(codes) < len(words) else 0,
        lines,
        sum(map(len, upper.findall(text))),
        sum(map(len, letter.findall(text))),
    )


def measurements(text: Column) -> Column:
    """Struct of MEASURES as longs; null counts as empty."""
    kind = StructType([StructField(m, LongType()) for m in MEASURES])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [measure(t.as_py() or "") for t in texts]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(MEASURES), names=list(MEASURES))

    return run(text)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, tuple[int, str]] = RULES) -> DataFrame:
    """id, every measurement and failed_bits (bit b set: the rule with bit b failed), a row per input row.

    Null and empty texts measure 0 and so fail few_words; null ids stay null;
    repeated rows get a row each; other columns are not read.
    """
    # One projection holds the Python call, so each rule below reads columns and runs nothing again.
    rows = df.select(F.col(id_col), measurements(F.col(text_col)).alias("m")).select(id_col, *[F.col(f"m.{m}").alias(m) for m in MEASURES])
    bits = F.lit(0).cast("long")
    for bit, fails in rules.values():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(0).cast("long"))
    return rows.withColumn("failed_bits", bits)


def mask(version: str, rules: dict[str, tuple[int, str]] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    return sum(1 << rules[name][0] for name in policies[version])


def passes(version: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(mask(version)) == 0


def ablations(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    The ledger is first counted by bit pattern (at most 2 to the number of rules rows), so
    one partial aggregation answers every ablation. Nulls, empty texts and repeated rows count as the
    ledger's rows do; an empty ledger gives no rows.
    """
    whole = mask(version)
    patterns = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(whole).alias("bits")).count()
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << RULES[n][0]).cast("long").alias("bit")) for n in POLICIES[version]])).alias("r")
    each = patterns.select("bits", "count", rows).select("bits", "count", "r.rule", "r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        total(F.col("bits") == F.col("bit"))("failed_alone"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit")))("kept_without"),
    )
