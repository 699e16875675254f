"""Inputs of the reference queries: the driver's tables hold no Han text and no markup, so both
are derived, by expressions that Spark and DuckDB share word for word. Whole tables and whole
texts are used."""

from __future__ import annotations

#: Letters to Han characters and marks, one to one.
LATIN, HANZI = "aeioutnsrh.,", "一二三四五天人上日中●。"
ACCENTS, PLAIN = "éèêçàâîôùûëïüäößñáíóú", "ABCDEFGHIJKLMNOPQRSTU"


def ascii_image(c: str) -> str:
    """Accented letters as capitals, so that bytes and characters agree."""
    return f"translate(lower({c}), '{ACCENTS}', '{PLAIN}')"


def han(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{HANZI}')"


def bracketed(c: str) -> str:
    """Text with brackets of both kinds where common letter pairs stood."""
    return f"replace(replace(replace(replace({c}, 'th', '【'), 'er', '】'), 'on', '＜'), 'in', '＞')"


def tagged(c: str) -> str:
    """Han text with notes, comments and marks."""
    return f"replace(replace(replace(replace({han(c)}, '天中', '【'), '二日', '】'), '四人', '<'), '三人', '>')"


PREDICTIONS = {
    "model": "concat(case when conv_id % 4 = 0 then 'realphoto_' else '' end, 'm', conv_id % 3)",
    "image": "concat('/pages/【', case turn % 3 when 0 then '一期' when 1 then '二期' else '三期' end, '】/', (conv_id * 7 + turn) % 45, case when conv_id % 11 = 0 then 'x' else '' end, '.png')",
    "finish_reason": "case when conv_id % 5 = 0 then 'length' else 'stop' end",
    "ok": "conv_id % 10 = 0",
}
#: A head tag around the first word, so that each side has one entity.
HEADED = "concat('<head>', split_part({0}, ' ', 1), '</head>', {0})"
FIRST_TEXT = HEADED.format(ascii_image("text"))
THIRD_TEXT = tagged("text")

PREDICTIONS_SQL = ", ".join(f"{v} as {k}" for k, v in PREDICTIONS.items())
