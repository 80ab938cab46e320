"""Injected distortions, and how well a gate catches them.

A pair without a trigger gives no case of that type; null easy texts give none at all. Repeated pairs give repeated cases. An empty table has shares of 0. Columns of the input that are
called like a result (case_id, distortion_type, is_clean) give way to it, all others pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import free_name, replaced_once

# Trigger and replacement of each distortion, in order.
REWRITES = (
    ("number_swap", "30,000", "3,000"),
    ("digit_drop", "1,295,400", "129,540"),
    ("krw_unit_error", "3억", "3천만"),
    ("date_shift", "7월 17일", "7월 7일"),
    ("inclusivity_flip", "까지", " 전에"),
    ("negation_drop", "빠집니다", "포함됩니다"),
    ("negation_drop", "제외됩니다", "포함됩니다"),
    ("condition_flip", "이상", "이하"),
    ("range_weaken", "미만", "이하"),
    ("entity_swap", "강서구청", "송파구청"),
)
INVENTED, INVENTED_SENTENCE = "국민건강보험공단", " 자세한 내용은 국민건강보험공단에 문의하세요."


def distorted(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per distortion that a pair's easy text allows, and a clean one: adds case_id (seed and type), distortion_type, is_clean; easy_text is the distorted text."""
    easy = F.col("easy_text")
    made: dict[str, list] = {}
    for kind, old, new in REWRITES:
        made.setdefault(kind, []).append(replaced_once(easy, old, new))
    cases = [(k, F.coalesce(*v)) for k, v in made.items()]
    cases.append(("hallucinated_entity", F.when(~easy.contains(INVENTED), F.concat(easy, F.lit(INVENTED_SENTENCE)))))
    rows = [F.struct(F.lit(k).alias("distortion_type"), F.lit(False).alias("is_clean"), v.alias("text")) for k, v in cases]
    rows.append(F.struct(F.lit("clean").alias("distortion_type"), F.lit(True).alias("is_clean"), easy.alias("text")))
    case = free_name("case", pairs.columns)
    kept = [F.col(c) for c in pairs.columns if c.lower() not in ("case_id", "distortion_type", "is_clean", "easy_text")]
    out = pairs.withColumn(case, F.explode(F.array(*rows)))
    at = F.col(case)
    out = out.where(at["text"].isNotNull() & (at["is_clean"] | (at["text"] != easy)))
    return out.select(*kept, F.concat(F.lit(f"{seed}-"), at["distortion_type"]).alias("case_id"), at["distortion_type"].alias("distortion_type"), at["is_clean"].alias("is_clean"), at["text"].alias("easy_text"))


def _share(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def by_type(cases: DataFrame, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """distortion_type, n_cases, n_caught, recall."""
    judged = cases.where(~F.col("is_clean")).transform(gate)
    out = judged.groupBy("distortion_type").agg(F.count("*").alias("n_cases"), F.count_if(F.col("verdict") != "pass").alias("n_caught"))
    return out.withColumn("recall", _share(F.col("n_caught"), F.col("n_cases")))


def overall(cases: DataFrame, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: n_cases, n_clean, tp, fn, fp, tn, clean_fp_rate, pass_residual_distortion_rate, precision, recall, f1."""
    flagged, clean = F.col("verdict") != "pass", F.col("is_clean")
    c = cases.transform(gate).agg(F.count("*").alias("n_cases"), F.count_if(clean).alias("n_clean"), F.count_if(~clean & flagged).alias("tp"), F.count_if(~clean & ~flagged).alias("fn"), F.count_if(clean & flagged).alias("fp"), F.count_if(clean & ~flagged).alias("tn"))
    c = c.withColumns({"clean_fp_rate": _share(F.col("fp"), F.col("n_clean")), "pass_residual_distortion_rate": _share(F.col("fn"), F.col("tp") + F.col("fn")), "precision": _share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
