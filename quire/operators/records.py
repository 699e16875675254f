"""Nested records: chat training rows, image binding, OCR annotation pages, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

PROMPT = "<image>\nOCR:【】＜＞。、"


def chat_messages(content: Column, prompt: str = PROMPT) -> Column:
    """array<struct(role, content)> of one exchange."""
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(prompt).alias("content")), F.struct(F.lit("assistant").alias("role"), content.alias("content")))


def page_records(pages: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """(book, page_idx, content) to (book, page_idx, messages, images) with no images yet."""
    return pages.select("book", "page_idx", chat_messages(F.col("content"), prompt).alias("messages"), F.array().cast("array<string>").alias("images"))


def bind_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """Records with the image (book, page_idx, path) of their page, by number; none stays empty."""
    return records.drop("images").join(images, ["book", "page_idx"], "left").withColumn("images", F.when(F.col("path").isNotNull(), F.array("path")).otherwise(F.array().cast("array<string>"))).drop("path")


def training_samples(records: DataFrame, paths: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """(prompt, image_path) of a shuffled sample whose image exists: the order is that of a seeded
    hash of the record, so it is the same on any cluster, and the limit comes before the check."""
    told = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    shuffled = records.withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.array_join(told, "|"), F.array_join("images", "|"))))
    cut = shuffled.orderBy("_order").limit(limit) if limit is not None else shuffled
    first = cut.select(F.transform(F.slice("messages", 1, 1), lambda m: F.struct(F.lit("user").alias("role"), m["content"].alias("content"))).alias("prompt"), F.try_element_at("images", F.lit(1)).alias("image_path"), "_order")
    return first.join(paths.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi").select("prompt", "image_path", "_order")


def debug_samples(scored: DataFrame, order: str, every: int = 10, most: int = 3, characters: int = 80) -> DataFrame:
    """What a training log prints: of every ``every``-th call, the first samples (call, order, completion, ..) with a snippet on one line."""
    first = scored.filter(F.col("call") % every == 0).withColumn("_n", F.row_number().over(Window.partitionBy("call").orderBy(order))).filter(F.col("_n") <= most)
    snippet = F.replace(F.replace(F.substring(T.strip_space("completion"), 1, characters), F.lit("\n"), F.lit("\\n")), F.lit("\f"), F.lit("\\f"))
    return first.select("call", order, F.length(T.strip_space("completion")).alias("length"), F.length(T.strip_to_han("completion")).alias("han"), snippet.alias("snippet"))


def flatten_words(pages: DataFrame) -> DataFrame:
    """A row for each word of OCR pages(fileName, classifiedLines)."""
    lines = pages.select("fileName", F.posexplode("classifiedLines").alias("line", "_line"))
    return lines.select("fileName", "line", F.posexplode("_line.words").alias("word", "_word")).select("fileName", "line", "word", "_word.*")


def page_text(lines: Column) -> Column:
    """Line texts joined by line breaks."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), "")


def alert_counts(words: DataFrame) -> DataFrame:
    """Words and alerts of either level for each page, and all suggestions."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return words.groupBy("fileName").agg(F.count("*").alias("words"), F.count_if(flag("l1_alert")).alias("l1"), F.count_if(flag("l2_alert")).alias("l2"), F.count("suggest").alias("suggested"))


def numerals(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """Page numbers in words; digits where the lookup (n, zh) of a few hundred rows has none."""
    return pages.join(lookup, pages["page_idx"].cast("string") == lookup["n"], "left").withColumn("pager", F.coalesce("zh", F.col("page_idx").cast("string"))).drop("n", "zh")


def choose_fonts(chars: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The first font by priority that has each character of chars(ch); null if none has."""
    best = glyphs.groupBy("codepoint").agg(F.min_by("font", "priority").alias("font"))
    return chars.join(best, F.ascii(chars["ch"]) == best["codepoint"], "left").drop("codepoint")


def with_canvas(layouts: DataFrame, canvases: DataFrame, default: str) -> DataFrame:
    """Layouts with their canvas, or the default where its file is missing."""
    have = canvases.select("canvas_id").distinct().withColumn("_have", F.lit(True))
    return layouts.join(have, "canvas_id", "left").withColumn("canvas", F.when(F.col("_have"), F.col("canvas_id")).otherwise(F.lit(default))).drop("_have")


def copy_layout(layouts: DataFrame, base: str, new_id: str) -> DataFrame:
    """layouts and a copy of one under a new id, unless that id is taken."""
    copy = layouts.filter(F.col("canvas_id") == base).withColumn("canvas_id", F.lit(new_id))
    return layouts.unionByName(copy.join(layouts.select("canvas_id"), "canvas_id", "left_anti").select(layouts.columns))


def delete_layout(layouts: DataFrame, gone: str) -> DataFrame:
    return layouts.filter(F.col("canvas_id") != gone)


def status_of(done: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted item with whether it was done: a batch with a flag for each item."""
    have = done.select(key).distinct().withColumn("ok", F.lit(True))
    return wanted.join(have, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
