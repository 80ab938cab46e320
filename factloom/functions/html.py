"""A result as an HTML page, as one string expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import escaped
from factloom.operators.pictograms import source_of

# Labels of the page, in our own words.
BADGES = {"pass": "통과", "revise": "수정 필요", "human_review": "사람 검수 필요"}
LEVEL_LABELS = {"plain": "보통 읽기", "easy": "쉬운 글"}
DISCLAIMER = "이 글은 자동으로 만든 쉬운 글 초안입니다. 중요한 내용은 원문을 확인하세요."
UNPROVEN = "점수는 규칙으로 매긴 것이며 사람이 확인한 값이 아닙니다."
NO_VIOLATIONS = "<p>고칠 곳이 없습니다.</p>"


def page(source: Column, easy: Column, score: Column, verdict: Column, violations: Column, pictures: Column, level: str = "easy") -> Column:
    """violations: array of struct rule, span, severity, suggestion; pictures: array of struct glyph_id, caption. Texts are escaped; the score is rounded half to even.

    Null texts, scores and arrays show as empty; glyphs that are no reference (data: addresses) are left out."""
    text = lambda c: escaped(F.coalesce(c, F.lit("")))
    badge = F.lit("")
    for k, v in BADGES.items():
        badge = F.when(verdict == k, v).otherwise(badge)
    item = lambda v: F.concat(
        F.lit('<li><span class="sev-'), text(v["severity"]), F.lit('">['), text(v["severity"]), F.lit("]</span> <strong>"), text(v["rule"]), F.lit("</strong>: "), text(v["span"]), F.lit(" → "), text(v["suggestion"]), F.lit("</li>")
    )
    figure = lambda p: F.concat(
        F.lit('<figure><img src="'), text(source_of(p["glyph_id"])), F.lit('" alt="'), text(p["caption"]), F.lit('"><figcaption>'), text(p["caption"]), F.lit("</figcaption></figure>")
    )
    items = F.concat(F.lit("<ul>"), F.array_join(F.transform(violations, item), ""), F.lit("</ul>"))
    shown = F.filter(pictures, lambda p: source_of(p["glyph_id"]).isNotNull())
    images = F.coalesce(F.array_join(F.transform(shown, figure), ""), F.lit(""))
    return F.concat(
        F.lit('<!doctype html><html lang="ko"><meta charset="utf-8"><main><section class="source">'), text(source), F.lit('</section><section class="easy">'), text(easy),
        F.lit('</section><p class="score">'), F.coalesce(F.bround(score, 0).cast("int").cast("string"), F.lit("")), F.lit(f'</p><p class="level">{LEVEL_LABELS[level]}</p><p class="verdict">'), badge, F.lit("</p>"),
        F.when(F.size(violations) > 0, items).otherwise(NO_VIOLATIONS), images, F.lit(f'<p class="note">{UNPROVEN}</p><p class="note">{DISCLAIMER}</p></main></html>'),
    )
