"""Column functions over tagged text: markup, entities, marks, names and paths.

Inline notes stand in 【】, top-margin comments in <> or ＜＞, and ring marks follow the character
they belong to. Every function takes and returns a Column and stays inside the JVM. A null text
counts as an empty one unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of Han characters, marks, and punctuation.
HAN = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}"
RING_MARKS = "●◎○☆◇◆△▲▽▼※"
CIRCLE_MARKS = "○●◎〇△▲▽▼※☆◇◆。、"
CJK_PUNCTUATION = "。，、；：？！「」『』《》（）—…·～"
ASCII_PUNCTUATION = r"""[,.!?;:'"\[\]{}()<>/\\|@$%^&*+=`~]"""
PAIRS = "array<struct<ch:string,mark:string>>"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def chars(c: Column) -> Column:
    """Code points of a text, none for an empty one."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def outside(characters: str) -> str:
    """A regular expression's class of all but these characters, as the ranges between them.

    The predicate of a negated class, [^...], is slow in the JVM where several threads match at once: some
    twenty times as slow on eight threads of Java 17.
    """
    codes = sorted({*map(ord, characters), 0x110000})
    return "[" + "".join(rf"\x{{{a + 1:x}}}-\x{{{b - 1:x}}}" for a, b in zip([-1, *codes], codes) if b - a > 1) + "]"


def without(c: Column, characters: str) -> Column:
    """Text without these few characters, each dropped by a scan of bytes, which is cheaper than looking up every character."""
    for x in dict.fromkeys(characters):
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def strip_markup(c: Column | str) -> Column:
    """Text without tags, bracket symbols, ring marks and punctuation. Half-width <...> go with
    their content, while full-width and square ones leave theirs."""
    out = F.regexp_replace(_text(c), "</?(footnote|head)>", "")
    out = F.translate(out, "【】＜＞", "")
    out = F.regexp_replace(out, "<[^>]+>", "")
    return F.regexp_replace(out, f"[{RING_MARKS}{CJK_PUNCTUATION}]|{ASCII_PUNCTUATION}", "")


def one_line(c: Column | str) -> Column:
    return F.translate(_text(c), "\n\r", "")


def entities(c: Column | str) -> Column:
    """Contents of footnote tags, then of head tags, then of 【】, each in text order."""
    t = _text(c)
    return F.concat(*(F.regexp_extract_all(t, F.lit(p), 1) for p in ("(?s)<footnote>(.*?)</footnote>", "(?s)<head>(.*?)</head>", "(?s)【(.*?)】")))


def half_width_brackets(c: Column | str) -> Column:
    return F.translate(_text(c), "＜＞", "<>")


def top_comments(c: Column | str) -> Column:
    return F.regexp_extract_all(half_width_brackets(c), F.lit("(?s)<(.*?)>"), 1)


def inline_notes(c: Column | str) -> Column:
    return F.regexp_extract_all(_text(c), F.lit("(?s)【(.*?)】"), 1)


def is_han(c: Column) -> Column:
    """Whether a character is in the basic range or extension A or B."""
    code = F.ascii(c)
    return code.between(0x4E00, 0x9FFF) | code.between(0x3400, 0x4DBF) | code.between(0x20000, 0x2A6DF)


def strip_to_han(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), f"[^{HAN}]", "")


def main_text(c: Column | str) -> Column:
    """Han characters outside comments and notes."""
    out = F.regexp_replace(half_width_brackets(c), "(?s)<.*?>", "")
    return strip_to_han(F.regexp_replace(out, "(?s)【.*?】", ""))


def same_mark(c: Column) -> Column:
    """Circle variants of the full stop as the full stop."""
    return F.translate(c, "○〇", "。。")


def circle_pairs(c: Column | str) -> Column:
    """(ch, mark) for each circle mark: ch is the last Han character before it, whatever lies
    between. A character value gets two marks in a text at most."""
    # only Han characters and marks matter, and of the former only those that marks follow
    kept = F.regexp_replace(_text(c), f"[^{HAN}{CIRCLE_MARKS}]", "")
    marked = F.regexp_extract_all(kept, F.lit(f"[{HAN}][{CIRCLE_MARKS}]+"), 0)

    def step(pairs: Column, m: Column) -> Column:
        ch = F.substring(m, 1, 1)
        own = F.transform(F.split(F.substring(m, F.lit(2), F.least(F.length(m) - 1, F.lit(2))), ""), lambda mark: F.struct(ch.alias("ch"), same_mark(mark).alias("mark")))
        room = 2 - F.size(F.filter(pairs, lambda p: p["ch"] == ch))
        return F.when(room > 0, F.concat(pairs, F.slice(own, F.lit(1), F.greatest(room, F.lit(0))))).otherwise(pairs)

    return F.aggregate(marked, F.array().cast(PAIRS), step)


def circled_characters(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda p: p["ch"]))


def strip_space(c: Column | str) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def without_prompt(c: Column | str) -> Column:
    return F.regexp_replace(strip_space(c), r"(?U)^OCR:\s*", "")


def han_of_completion(c: Column | str) -> Column:
    return strip_to_han(without_prompt(c))


def readable_tags(c: Column | str) -> Column:
    """Model output with literal \\n and \\f as line breaks and tags as symbols: paired ones first,
    stray ones after; runs of blank lines shortened, trailing breaks dropped."""
    out = F.replace(F.replace(_text(c), F.lit("\\n"), F.lit("\n")), F.lit("\\f"), F.lit("\n"))
    out = F.regexp_replace(out, "(?s)<footnote>(.*?)</footnote>", "【$1】")
    out = F.regexp_replace(out, "(?s)<head>(.*?)</head>", "<$1>")
    for tag, symbol in (("<footnote>", "【"), ("</footnote>", "】"), ("<head>", "<"), ("</head>", ">")):
        out = F.replace(out, F.lit(tag), F.lit(symbol))
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "\n+\\z", "")


def completion_text(variant: Column) -> Column:
    """Text of a completion kept as VARIANT: a string, a list (its first element) or an object with
    content, itself a string or a list whose first part of type text counts."""
    def plain(v: Column) -> Column:
        content = F.try_variant_get(v, "$.content", "string")
        parts = F.try_variant_get(v, "$.content", "array<struct<type:string,text:string>>")
        first = F.element_at(F.filter(parts, lambda p: p["type"] == "text"), 1)["text"]
        whole = F.try_variant_get(v, "$", "string")
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(first, content, F.lit(""))).otherwise(F.coalesce(whole, F.lit("")))

    listed = F.try_variant_get(variant, "$[0]", "variant")
    return F.when(F.schema_of_variant(variant).startswith("ARRAY"), F.coalesce(plain(listed), F.lit(""))).otherwise(plain(variant))


def detect_period(path: Column | str) -> Column:
    """Benchmark phase named in an image path, or null."""
    p = _text(path)
    named = F.nullif(F.regexp_extract(p, "实拍图/[^/]+/([一二]期|三期)/", 1), F.lit(""))
    return F.coalesce(named, *(F.when(p.contains(f"【{x}】"), x) for x in ("一期", "二期", "三期")))


def extract_sequence(path: Column | str) -> Column:
    """Number that a file's stem consists of, or null."""
    name = F.regexp_extract(_text(path), "([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(stem.rlike("^[0-9]+$"), stem.try_cast("long"))


def valid_layout_id(c: Column | str) -> Column:
    return _text(c).rlike("^[A-Za-z0-9_-]+$")


def safe_name(c: Column | str) -> Column:
    """A file name with everything but letters, digits, dot, dash and underscore as underscore."""
    return F.regexp_replace(_text(c), r"(?U)[^\w.\-]", "_")


def base_name(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"\.[^.]+$", "")


def replace_pairs(c: Column, pairs: str) -> Column:
    """Replacements written as ab|cd: a becomes b, then c becomes d."""
    for p in pairs.split("|"):
        if len(p) >= 2:
            c = F.replace(c, F.lit(p[0]), F.lit(p[1]))
    return c


def normalize_book_line(c: Column | str, replace_comma: str = "", replace_number: str = "", delete: str = "", remove: str = "", to_period: str = "") -> Column:
    """A book's line before typesetting: replacements, deletions, marks to a single full stop that
    never leads, and @ to a space."""
    out = replace_pairs(replace_pairs(_text(c), replace_comma), replace_number)
    out = without(out, (delete + remove).replace("|", ""))
    if to_period:
        marks = to_period.replace("|", "")
        out = F.regexp_replace(F.translate(out, marks, "。" * len(marks)), "。+", "。")
        out = F.regexp_replace(out, "^。", "")
    return F.replace(out, F.lit("@"), F.lit(" "))


def page_content(c: Column | str, drop_comments: bool = False) -> Column:
    """Page text with control marks as line and form feeds, and without trailing space or runs of blank lines."""
    out = F.regexp_replace(_text(c), "＜[^＞]*＞", "") if drop_comments else _text(c)
    out = F.translate(F.replace(out, F.lit("\\h"), F.lit("\n")), "$%&", "\f")
    out = F.regexp_replace(out, r"(?U)[^\S\n]+(?=\n)|[^\S\n]+\z", "")
    return strip_space(F.regexp_replace(out, "\n{3,}", "\n\n"))


#: Named colours, fixed values.
COLOURS = {"black": (0, 0, 0), "white": (1, 1, 1), "red": (1, 0, 0), "blue": (0, 0, 1), "gray": (0.5, 0.5, 0.5)}


def parse_colour(c: Column | str) -> Column:
    """struct(r, g, b) from a name, rgb(r,g,b) or #rrggbb; black otherwise."""
    t = F.lower(F.trim(_text(c)))
    rgb, code = r"^rgb\((\d+),(\d+),(\d+)\)", "^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})"

    def part(i: int) -> Column:
        named = F.coalesce(*(F.when(t == k, F.lit(float(v[i]))) for k, v in COLOURS.items()))
        return F.coalesce(
            named,
            F.when(t.rlike(rgb), F.regexp_extract(t, rgb, i + 1).try_cast("double") / 255),
            F.when(t.rlike(code), F.conv(F.regexp_extract(t, code, i + 1), 16, 10).cast("double") / 255),
            F.lit(0.0),
        )

    return F.struct(*(part(i).alias(k) for i, k in enumerate("rgb")))


def note_width(c: Column | str, zero_width: str = "●◎", vertical_lines: bool = False) -> Column:
    """Cells of a note: half its characters, rounded up, without zero-width marks."""
    return F.ceil(F.length(without(_text(c), zero_width + ("《》" if vertical_lines else ""))) / 2).cast("int")


def flatten_brackets(c: Column | str) -> Column:
    """Outermost 【】 and ＜＞ only: nested symbols go and leave their content, stray closers go,
    and an open one is closed at the end."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("within"), F.lit(0).alias("depth"))

    def step(acc: Column, ch: Column) -> Column:
        opens, closes = F.lit("【＜").contains(ch), F.lit("】＞").contains(ch)
        free, note, comment = acc["within"] == "", acc["within"] == "【", acc["within"] == "＜"
        enters = free & opens
        leaves = (note & (ch == "】") & (acc["depth"] == 1)) | (comment & (ch == "＞"))
        depth = acc["depth"] + F.when(enters | (note & (ch == "【")), 1).when(note & (ch == "】"), -1).otherwise(0)
        return F.struct(
            F.when(enters | leaves | ~(opens | closes), F.concat(acc["out"], ch)).otherwise(acc["out"]).alias("out"),
            F.when(enters, ch).when(leaves, "").otherwise(acc["within"]).alias("within"),
            F.when(leaves, 0).otherwise(depth).cast("int").alias("depth"),
        )

    # pieces between brackets move as one, so the fold is as long as the number of brackets
    pieces = F.regexp_extract_all(_text(c), F.lit(f"[【】＜＞]|{outside('【】＜＞')}+"), 0)
    end = lambda acc: F.concat(acc["out"], F.when(acc["within"] == "【", "】").when(acc["within"] == "＜", "＞").otherwise(""))
    return F.aggregate(pieces, start, step, end)


def mark_set(config: Column | str, fixed: str = "●◎") -> Column:
    """Characters of a |-joined setting, each once, with those that always belong to the set."""
    own = F.array_distinct(chars(F.translate(_text(config), "|", "")))
    return F.array_union(own, F.array(*map(F.lit, fixed))) if fixed else own


def measure_line(c: Column | str, zero_width: str = "●◎", vertical_lines: bool = False) -> Column:
    """Main-text cells of a flattened line: comments count nothing, notes half a cell a character."""
    bare = F.regexp_replace(_text(c), rf"＜{outside('＞')}*(＞|\z)", "")
    notes = F.regexp_extract_all(bare, F.lit(rf"【({outside('】')}*)(?:】|\z)"), 1)
    widths = F.aggregate(notes, F.lit(0), lambda a, n: a + note_width(n, zero_width, vertical_lines))
    rest = without(F.regexp_replace(bare, rf"【{outside('】')}*(】|\z)", ""), "】" + zero_width + ("《》" if vertical_lines else ""))
    return (widths + F.length(rest)).cast("int")
