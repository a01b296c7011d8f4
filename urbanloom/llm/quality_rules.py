"""Quality rules as a bitmask ledger.

Every measurement of a text is made once and every rule evaluated once; a row keeps the measurements and
one bit per failed rule. A policy is a versioned mask over those bits: applying one, or another version of
it, or asking what each rule alone removes, needs only bit operations on the stored ledger, not the texts.

Edge cases: a null or empty text, or one of white space, has no words; all its counts are 0 and it fails
``short``. Very long texts are measured whole, in time n log n. Repeated rows have a row each, alike. An
empty table gives an empty ledger. Input columns but the id and the text are not carried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import SPACE_RUN, text_or_empty, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (an SQL predicate over the measurements) holds. Its bit never changes."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "short", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "n_words > 0 and 4 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    Rule(5, "shouting", "n_upper_words > 0 and 2 * n_upper_words > n_words"),
    Rule(6, "same_word_runs", "n_words > 0 and 5 * n_same_as_previous > n_words"),
)
BIT = {rule.name: 1 << rule.bit for rule in RULES}
BASE_MASK = BIT["short"] | BIT["repeated_windows"]
#: Versioned policies: the mask of the rules that reject. Old versions stay as they were.
POLICIES: Mapping[str, int] = {
    "base/1": BASE_MASK,
    "strict/1": BASE_MASK | BIT["symbols"] | BIT["duplicate_lines"] | BIT["same_word_runs"],
    "strict/2": BASE_MASK | BIT["symbols"] | BIT["duplicate_lines"] | BIT["word_length"] | BIT["shouting"] | BIT["same_word_runs"],
}
CURRENT_POLICY = "strict/2"


def repeated_window_words(grams: Column, width: int = WINDOW) -> Column:
    """Positions covered by windows found twice or more. ``grams``: an array of the windows' hashes, in order."""
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(ordered: Column) -> Column:
        n = F.size(ordered)
        same = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (x["h"] == F.get(ordered, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(ordered, i + 1)["h"])),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gains = F.transform(at, lambda p, i: F.when(i < F.size(at) - 1, F.least(F.lit(width), F.get(at, i + 1) - p)).otherwise(F.lit(width)))
        return F.aggregate(gains, F.lit(0).cast("long"), lambda total, gain: total + gain)

    # array_distinct hashes, so texts without a repeated window, nearly all, are never sorted.
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(let(placed, starts), covered))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    text = F.col("__text")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(*row, F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__text"))
    base = base.withColumn("__words", words(text))
    word_array = F.col("__words")
    grams = F.when(
        F.size(word_array) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(word_array) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(word_array, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    base = base.withColumn("__grams", grams).withColumn("__lines", lines)
    previous = F.transform(word_array, lambda w, i: F.when(i > 0, w == F.get(word_array, i - 1)).otherwise(F.lit(False)))
    return base.select(
        *(["row"] if carry else []),
        "doc_id",
        F.size(word_array).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("__grams")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter(word_array, lambda w: w.rlike("^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"))).cast("long").alias("n_upper_words"),
        F.size(F.filter(previous, lambda same: same)).cast("long").alias("n_same_as_previous"),
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the measurements, and failed_bits: every rule evaluated once. ``carry`` adds the input row as ``row``."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    return measured(docs, id_col, text_col, carry).withColumn("failed_bits", bits)


def apply_policy(frame: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """Add base_failed, kept and policy to a ledger; only bits are read."""
    failed = F.col("failed_bits")
    return (
        frame.withColumn("base_failed", failed.bitwiseAND(F.lit(BASE_MASK)) != 0)
        .withColumn("kept", failed.bitwiseAND(F.lit(BASE_MASK | POLICIES[policy])) == 0)
        .withColumn("policy", F.lit(policy))
    )


def keep_good(docs: DataFrame, policy: str = CURRENT_POLICY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, that the policy keeps."""
    judged = apply_policy(ledger(docs, id_col=id_col, text_col=text_col, carry=True), policy)
    # A filter would be pushed below the ledger and repeat its measurements for every use; a generator is not.
    return judged.select(F.inline(F.when(F.col("kept"), F.array("row"))))


def ablation(frame: DataFrame, policy: str = CURRENT_POLICY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects. One pass over the bits."""
    hit = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]))
    used = [rule for rule in rules if POLICIES[policy] >> rule.bit & 1]
    counts = frame.agg(
        *[F.coalesce(F.sum(hit.bitwiseAND(F.lit(1 << r.bit)) / F.lit(float(1 << r.bit))), F.lit(0.0)).cast("long").alias(f"f{r.bit}") for r in used],
        *[F.count(F.when(hit == F.lit(1 << r.bit), 1)).alias(f"o{r.bit}") for r in used],
        F.bit_or(hit).alias("any"),
    )
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only_this")) for r in used])
    return counts.select(F.inline(rows))
