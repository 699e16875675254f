"""The fields of a layout, with their kinds, and settings typed by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, StringType, StructField, StructType


def _setting(name: str, kind: str, of: DataType) -> StructField:
    return StructField(name, of, metadata={"kind": kind})


def form_schema() -> StructType:
    """A field for each setting of a layout; its metadata has the kind of input that edits it."""
    whole, switch, words, colour, font = (lambda name, kind=kind, of=of: _setting(name, kind, of) for kind, of in (("int", IntegerType()), ("bool", BooleanType()), ("str", StringType()), ("color", StringType()), ("font", StringType())))
    return StructType(
        [
            # the grid that pages are laid out in
            whole("row_num"),
            whole("col_num"),
            whole("canvas_width"),
            whole("canvas_height"),
            whole("margins_left"),
            whole("margins_right"),
            whole("margins_top"),
            whole("margins_bottom"),
            whole("leaf_center_width"),
            whole("outline_width"),
            whole("outline_vmargin"),
            # how text, notes and comments are set
            font("font1"),
            font("font2"),
            font("font3"),
            words("text_fonts_array"),
            words("comment_fonts_array"),
            whole("text_font1_size"),
            whole("text_font2_size"),
            whole("comment_font1_size"),
            whole("topcmt_font_size"),
            colour("text_font_color"),
            colour("comment_font_color"),
            colour("topcmt_color"),
            switch("no_topcmt"),
            # marks beside the text
            switch("if_onlyperiod"),
            colour("onlyperiod_color"),
            switch("if_book_vline"),
            whole("book_line_width"),
            colour("book_line_color"),
            # titles and page numbers
            words("spine_title"),
            words("title_postfix"),
            switch("if_tpcenter"),
            whole("title_font_size"),
            colour("title_font_color"),
            whole("title_y"),
            whole("pager_font_size"),
            whole("pager_y"),
        ]
    )


def typed_settings(settings: Column) -> Column:
    """struct of all fields from map<string,string>: null where a setting is missing or not of its kind."""
    columns = []
    for f in form_schema():
        value = F.trim(F.element_at(settings, f.name))
        if f.metadata["kind"] == "int":
            value = F.round(value.try_cast("double")).try_cast("int")
        elif f.metadata["kind"] == "bool":
            value = F.when(F.lower(value).isin("1", "true", "yes"), True).when(F.lower(value).isin("0", "false", "no", ""), False)
        columns.append(value.alias(f.name))
    return F.struct(*columns)
