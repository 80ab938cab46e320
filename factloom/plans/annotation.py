"""Annotations of pairs: scores before and after, which kinds of facts were kept, what went wrong, and pictograms.

Null texts count as empty. Pairs are annotated one by one, repeated ones too; an empty table gives an empty result. Columns of the input that are called like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import computed, free_name
from factloom.operators import gate, pictograms, rules

# Category of each kind of fact, and the categories that are reported.
CATEGORY = {
    "numeric": "numbers", "date": "dates", "money": "amounts", "deadline": "deadlines", "scope": "eligibility", "agency": "entities", "contact": "entities", "person": "entities", "negation": "eligibility",
}
CATEGORIES = ("numbers", "dates", "amounts", "deadlines", "eligibility", "entities")


def annotated(judged: DataFrame) -> DataFrame:
    """judged: from the gate. Adds a boolean per category, exact_fail_count, failed_categories (sorted) and, if there are drift_flags, distortions (these, then the drift flags; none if the pair passes)."""
    table = F.create_map(*[x for k, v in CATEGORY.items() for x in (F.lit(k), F.lit(v))])
    failed = F.array_sort(F.array_distinct(F.transform("failed", lambda s: F.coalesce(F.try_element_at(table, s["type"]), s["type"]))))
    passed = F.col("verdict") == "pass"
    kept = {c: passed | ~F.array_contains("failed_categories", c) for c in CATEGORIES}
    flags = {"distortions": F.when(passed, F.array().cast("array<string>")).otherwise(F.concat("failed_categories", "drift_flags"))} if "drift_flags" in judged.columns else {}
    return judged.withColumn("failed_categories", failed).withColumns(kept | {"exact_fail_count": F.size("failed")} | flags)


def corpus_rows(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame] = gate.verified) -> DataFrame:
    """pairs: source_text, easy_text, ref_date, source_tokens, easy_tokens. Adds to annotated(): ker_score and before_score (one decimal, halves to the even one), delta, ker_level_estimate,
    ker_rule_violations (rule:span), pictogram_refs, slot_types (sorted).

    judge: the gate, or as much of it (gate.findings) as is wanted: with facts alone the columns of annotated() are left out."""
    before = rules.scored(pairs, "source_text", "source_tokens", only=rules.RULES)
    # the mean is taken once, and sub-scores go no further
    scores = free_name("scores", before.columns)
    mean = sum((F.col(scores)[r] for r in rules.RULES), F.lit(0.0)) / len(rules.RULES)
    before = computed(before, {scores: F.struct(*rules.RULES)}).select(*pairs.columns, mean.alias("before_score"))
    after = rules.scored(before, "easy_text", "easy_tokens")
    lines = F.transform("violations", lambda v: F.concat(v["rule"], F.lit(":"), v["span"]))
    after = after.select(*pairs.columns, F.bround("before_score", 1).alias("before_score"), F.bround("score", 1).alias("ker_score"), (F.bround(F.col("score") - F.col("before_score"), 1) + 0.0).alias("delta"), F.col("level_estimate").alias("ker_level_estimate"), lines.alias("ker_rule_violations"))
    out = judge(after)
    out = annotated(out) if "failed" in out.columns else out
    out = out.withColumn("slot_types", F.array_sort(F.array_distinct(F.transform("slots" if "slots" in out.columns else "facts", lambda s: s["type"]))))
    return pictograms.with_pictograms(out, "easy_text", "pictogram_refs")
