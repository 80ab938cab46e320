"""Pictograms for the concepts that a text names.

Null and empty texts have none. A glyph is shown once, at its first place in the text, with the caption of the keyword there; at one place the first of the lexicon wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import computed, free_name, stripped

# Keyword, glyph, caption.
LEXICON = (
    ("돈", "openmoji/money.svg", "돈"), ("금액", "openmoji/money.svg", "돈"), ("납부", "openmoji/pay.svg", "돈을 내요"), ("세금", "openmoji/tax.svg", "세금"),
    ("날짜", "openmoji/calendar.svg", "날짜"), ("기한", "openmoji/calendar.svg", "날짜"), ("마감", "openmoji/deadline.svg", "마감 날짜"), ("신청", "openmoji/apply.svg", "신청"),
    ("접수", "openmoji/apply.svg", "신청"), ("서류", "mulberry/document.svg", "서류"), ("전화", "mulberry/phone.svg", "전화"), ("연락", "mulberry/phone.svg", "전화"),
    ("주소", "openmoji/address.svg", "주소"), ("방문", "mulberry/visit.svg", "찾아가요"), ("병원", "mulberry/hospital.svg", "병원"), ("약", "mulberry/medicine.svg", "약"),
    ("건강", "openmoji/health.svg", "건강"), ("보험", "openmoji/insurance.svg", "보험"), ("은행", "mulberry/bank.svg", "은행"), ("계좌", "openmoji/bank_account.svg", "은행 계좌"),
    ("주민센터", "mulberry/office.svg", "주민센터"), ("구청", "mulberry/office.svg", "구청"), ("우편", "openmoji/mail.svg", "우편"), ("이메일", "openmoji/email.svg", "이메일"),
    ("홈페이지", "openmoji/website.svg", "홈페이지"), ("지원", "openmoji/support.svg", "도와줘요"), ("혜택", "openmoji/benefit.svg", "혜택"), ("자격", "mulberry/eligible.svg", "받을 수 있어요"),
    ("주의", "openmoji/warning.svg", "조심하세요"), ("금지", "openmoji/forbidden.svg", "하면 안 돼요"), ("시간", "mulberry/clock.svg", "시간"), ("장소", "openmoji/place.svg", "장소"),
)
# keyword -> a pattern of its places that are no part of another word
GUARDED = {"약": "(?<![계예요절규공조])약(?![간속관])"}


REF = "array<struct<concept:string,set:string,glyph_id:string,caption:string>>"


def matched(text: Column) -> Column:
    """array of concept, set, glyph_id, caption: by first place in the text, each glyph once, ties in the order of the lexicon. text should be a column, as each keyword is looked for in it."""
    glyphs: dict[str, list[Column]] = {}
    for i, (word, glyph, caption) in enumerate(LEXICON):
        at = F.regexp_instr(text, F.lit(GUARDED[word])) if word in GUARDED else F.locate(word, text)
        found = F.struct(at.alias("at"), F.lit(i).alias("i"), F.lit(word).alias("concept"), F.lit(glyph.split("/")[0]).alias("set"), F.lit(glyph).alias("glyph_id"), F.lit(caption).alias("caption"))
        glyphs.setdefault(glyph, []).append(F.when(text.contains(word) & (at > 0), found))
    # least skips keywords that are not there
    first = [F.least(*x) if len(x) > 1 else x[0] for x in glyphs.values()]
    here = F.array_sort(F.array_compact(F.array(*first)))
    return F.transform(here, lambda p: F.struct(*(p[c].alias(c) for c in ("concept", "set", "glyph_id", "caption")))).cast(REF)


def with_pictograms(docs: DataFrame, text_col: str = "text", name: str = "pictograms") -> DataFrame:
    """docs with their pictograms. The text is computed once, whatever expression it comes from."""
    text = free_name("picture_text", docs.columns)
    out = computed(docs, {text: F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    return out.select(*(c for c in docs.columns if c != name), matched(F.col(text)).alias(name))


def inlined(glyph_id: Column) -> Column:
    """Whether a glyph is no reference but a picture written out (a data: address), which no lexicon may hold."""
    return F.lower(stripped(glyph_id)).startswith("data:")


def source_of(glyph_id: Column) -> Column:
    """Where the picture is: addresses as they are, others under assets/pictograms/. Pictures written out have no place: null."""
    return F.when(inlined(glyph_id), F.lit(None).cast("string")).when(glyph_id.rlike("^https?://"), glyph_id).otherwise(F.concat(F.lit("assets/pictograms/"), glyph_id))
