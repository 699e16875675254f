"""Page geometry as Column functions over layout rows and drawn shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "array<struct<x:double,w:double>>"


def numbers(c: Column | str) -> Column:
    """Doubles of a comma-separated text, blank ones left out."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v) != "")
    return F.transform(parts, lambda v: F.trim(v).try_cast("double"))


def column_boxes(positions: Column | str, widths: Column | str, rows_per_section: Column | int = 0) -> Column:
    """Columns array<struct(x, w)> from right to left.

    Widths that are missing or too few are taken from the next column's place, the last from the
    whole spread. With several sections, columns less than 20 pixels apart are one, averaged.
    """
    xs, ws = numbers(positions), numbers(widths)
    per = F.lit(rows_per_section) if isinstance(rows_per_section, int) else F.coalesce(rows_per_section, F.lit(0))
    paired = F.array_sort(F.zip_with(xs, ws, lambda x, w: F.struct(x.alias("x"), w.alias("w"))), lambda a, b: F.when(a["x"] > b["x"], -1).when(a["x"] < b["x"], 1).otherwise(0))
    falling = F.sort_array(xs, asc=False)
    spread = F.element_at(falling, 1) - F.element_at(falling, -1)
    derived = F.transform(falling, lambda x, i: F.struct(x.alias("x"), F.coalesce(x - F.try_element_at(falling, i + 2), spread).alias("w")))
    boxes = F.when(F.size(xs) == 0, F.array().cast(BOX)).when((F.size(ws) > 0) & (F.size(ws) == F.size(xs)), paired).otherwise(derived).cast(BOX)

    def merge(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(((last["x"] + b["x"]) / 2).alias("x"), ((last["w"] + b["w"]) / 2).alias("w"))
        near = F.abs(last["x"] - b["x"]) < 20
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(b)))

    return F.when(per > 0, F.aggregate(boxes, F.array().cast(BOX), merge)).otherwise(boxes)


def even_width(width: Column, left: Column, right: Column, centre: Column, columns: Column) -> Column:
    return (width - left - right - centre) / columns


def row_sections(row_positions: Column | str, row_num: Column, rows_per_section: Column) -> Column:
    """struct(row_ys, row_num, sections) from row lines: they part sections if rows of a section are given."""
    ys = F.sort_array(numbers(row_positions))
    n, per = F.size(ys), F.coalesce(rows_per_section, F.lit(0))
    return F.struct(
        ys.alias("row_ys"),
        F.when(n == 0, row_num).when(per > 0, (n + 1) * per).otherwise(n + 1).cast("int").alias("row_num"),
        F.when((n > 0) & (per > 0), n + 1).otherwise(1).cast("int").alias("sections"),
    )


def even_grid(width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column, centre: Column, columns: Column, rows: Column) -> Column:
    """Cells array<struct(cell, x, y, w)> in reading order of an even page: columns from the right,
    rows from the top, the spine's gap after half of the columns. y grows upwards."""
    cw, rh = even_width(width, left, right, centre, columns), (height - top - bottom) / rows
    x = lambda i: width - right - cw * i - F.when(i > F.floor(columns / 2), centre).otherwise(0)
    return F.flatten(
        F.transform(F.sequence(F.lit(1), columns), lambda i: F.transform(F.sequence(F.lit(1), rows), lambda j: F.struct(((i - 1) * rows + j).alias("cell"), x(i).alias("x"), (height - top - rh * j).alias("y"), cw.alias("w"))))
    )


def boxed_grid(boxes: Column, row_ys: Column, height: Column, top: Column, bottom: Column, rows: Column) -> Column:
    """Cells of drawn columns; drawn row lines, if any, give the rows' places."""
    n = F.size(row_ys)
    tops = F.transform(row_ys, lambda y: height - y)
    rh = F.when(n > 0, (F.element_at(tops, 1) - F.element_at(tops, -1)) / F.greatest(n - 1, F.lit(1))).otherwise((height - top - bottom) / rows)
    y = lambda j: F.when(j <= n, F.try_element_at(tops, j.cast("int")) - rh).otherwise(height - top - rh * j)
    return F.flatten(
        F.transform(boxes, lambda b, i: F.transform(F.sequence(F.lit(1), rows), lambda j: F.struct((i * rows + j).alias("cell"), b["x"].alias("x"), y(j).alias("y"), b["w"].alias("w"))))
    )


def sectioned_grid(boxes: Column, row_ys: Column, height: Column, top: Column, bottom: Column, per: Column) -> Column:
    """Cells of several sections: those of the right half of the columns first, from the top, then the left's."""
    edges = F.concat(F.array(top.cast("double")), row_ys, F.array((height - bottom).cast("double")))
    sections = F.size(row_ys) + 1
    half = F.floor(F.size(boxes) / 2).cast("int")
    halves = F.array(F.slice(boxes, F.lit(1), half), F.slice(boxes, half + 1, F.size(boxes) - half))

    def cells(cols: Column) -> Column:
        def section(s: Column) -> Column:
            rh = (F.element_at(edges, s.cast("int") + 1) - F.element_at(edges, s.cast("int"))) / per
            return F.flatten(F.transform(cols, lambda b: F.transform(F.sequence(F.lit(1), per), lambda j: F.struct(b["x"].alias("x"), (height - F.element_at(edges, s.cast("int")) - rh * j).alias("y"), b["w"].alias("w")))))

        return F.flatten(F.transform(F.sequence(F.lit(1), sections), section))

    flat = F.flatten(F.transform(halves, cells))
    return F.transform(flat, lambda c, i: F.struct((i + 1).alias("cell"), c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w")))


def image_zones(c: Column | str, height: Column) -> Column:
    """array<struct(x, y, w, h)> of x,y,w,h;... with y turned upwards; malformed ones are skipped."""
    c = F.col(c) if isinstance(c, str) else c
    zones = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda z: F.transform(F.split(z, ","), lambda v: F.trim(v).try_cast("double")))
    whole = F.filter(zones, lambda z: (F.size(z) == 4) & ~F.exists(z, lambda v: v.isNull()))
    return F.transform(whole, lambda z: F.struct(z[0].alias("x"), (height - z[1] - z[3]).alias("y"), z[2].alias("w"), z[3].alias("h")))


def cover_scale(zone_w: Column, zone_h: Column, image_w: Column, image_h: Column) -> Column:
    """Scale at which an image covers a zone; images are never shrunk."""
    return F.greatest(zone_w / image_w, zone_h / image_h, F.lit(1.0))


def crop_box(zone_w: Column, zone_h: Column, image_w: Column, image_h: Column, *key: Column, seed: int = 42) -> Column:
    """struct(scale, width, height, left, top): an image scaled to cover a zone, and the zone's place in it.

    The place is uniform over all that fit, drawn from a hash of the seed and the key, so it is the
    same on any cluster.
    """
    scale = cover_scale(zone_w, zone_h, image_w, image_h)
    grown = lambda size, zone: F.when(scale > 1, F.greatest((size * scale + 0.5).cast("int"), zone.cast("int"))).otherwise(size.cast("int"))
    width, height = grown(image_w, zone_w), grown(image_h, zone_h)

    def offset(axis: str, size: Column, zone: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{axis}"), *(k.cast("string") for k in key))), 1, 13), 16, 10).cast("long")
        return F.pmod(draw, F.greatest(size - zone.cast("int"), F.lit(0)) + 1).cast("int")

    return F.struct(scale.alias("scale"), width.alias("width"), height.alias("height"), offset("x", width, zone_w).alias("left"), offset("y", height, zone_h).alias("top"))


def fit_scale(most_w: Column, most_h: Column, w: Column, h: Column) -> Column:
    return F.least(most_w / w, most_h / h, F.lit(1.0))


def preview(width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column, centre: Column, columns: Column, rows: Column) -> Column:
    """struct(col_width, row_height, page_chars)."""
    return F.struct(even_width(width, left, right, centre, columns).alias("col_width"), ((height - top - bottom) / rows).alias("row_height"), (columns * rows).alias("page_chars"))


def comment_fit(length: Column, base: Column, columns: Column, height: Column, gap: float = 1.3, least: int = 15) -> Column:
    """Largest font size from base down by one, at least ``least``, at which a comment of so many
    characters fits the columns that are left; null if none does. A column holds one row at least,
    even where the height is negative."""
    size = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(base - least).cast("int"), F.lit(0))), lambda i: base - i)
    rows = lambda fs: F.greatest(F.lit(1), (height / (fs * gap)).cast("int"))
    return F.array_max(F.filter(size, lambda fs: (fs >= least) & (F.ceil(length / rows(fs)) <= columns)))


def normalized_rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(x, y, w, h) of a drag, or null if it is five pixels or less in a direction."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    return F.when((w > 5) & (h > 5), F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), w.alias("w"), h.alias("h")))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def derive_layout(shapes: Column, width: Column, height: Column, split_y: Column) -> dict[str, Column]:
    """Layout fields from drawn shapes array<struct(tool, x, y, w, h)>: body, margin, center,
    col_box and img_zone boxes, col and row lines. Fields without a shape are null."""
    of = lambda tool: F.filter(shapes, lambda s: s["tool"] == tool)
    first = lambda tool: F.try_element_at(of(tool), F.lit(1))
    body, margin, centre = first("body"), first("margin"), first("center")
    boxes = F.array_sort(of("col_box"), lambda a, b: F.when(a["x"] > b["x"], -1).when(a["x"] < b["x"], 1).otherwise(0))
    rows = F.array_sort(of("row"), lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(0))
    n, lines, old = F.size(boxes), F.size(rows), F.size(of("col"))
    joined = lambda a, f: F.array_join(F.transform(a, lambda s: half_up(f(s)).cast("string")), ",")
    font = F.greatest(F.lit(10), F.floor(F.array_min(F.transform(boxes, lambda b: b["w"])) * 0.85 / 2) * 2)
    drawn = n > 0
    upper = split_y < body["y"] + body["h"] / 2
    zones = of("img_zone")
    return {
        "margins_top": half_up(body["y"]),
        "margins_bottom": half_up(height - body["y"] - body["h"]),
        "margins_left": half_up(body["x"]),
        "margins_right": half_up(width - body["x"] - body["w"]),
        "fish_top_y": F.when(margin.isNotNull(), half_up(margin["y"] + margin["h"])).when(body.isNotNull(), half_up(split_y)),
        "fish_position": F.when(margin.isNotNull(), F.when(margin["y"] < F.coalesce(body["y"], height / 2), "top").otherwise("bottom")).when(body.isNotNull() & split_y.isNotNull(), F.when(upper, "top").otherwise("bottom")),
        "leaf_center_width": F.when(centre.isNotNull(), F.greatest(F.lit(10), half_up(centre["w"]))),
        "col_num": F.when(drawn, n).when(old > 0, old + 1),
        "col_positions": F.when(drawn, joined(boxes, lambda b: b["x"])),
        "col_widths": F.when(drawn, joined(boxes, lambda b: b["w"])),
        "text_font1_size": F.when(drawn, font),
        "text_font2_size": F.when(drawn, half_up(font * 0.7)),
        "comment_font1_size": F.when(drawn, half_up(font * 0.5)),
        "row_num": F.when(lines > 0, lines + 1).when(drawn & body.isNotNull(), F.greatest(F.lit(1), F.floor(body["h"] / (font * 1.1)))),
        "row_positions": F.when(lines > 0, joined(rows, lambda s: s["y"])),
        "image_zones": F.when(F.size(zones) > 0, F.array_join(F.transform(zones, lambda z: F.concat_ws(",", *(half_up(z[k]).cast("string") for k in "xywh"))), ";")),
        "no_topcmt": F.when(margin.isNotNull() | split_y.isNotNull(), 0).otherwise(1),
    }


def layout_yaml(fields: dict[str, Column]) -> Column:
    """YAML text of a layout; null fields are left out and strings are quoted."""
    return F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()))


def comment_area(width: Column, left: Column, right: Column, centre: Column, columns: Column, top: Column, outline: Column, outline_margin: Column, above: float = 30.0, below: float = 30.0) -> Column:
    """struct(half_columns, half_width, height): the room for top-margin comments, which may be negative in height."""
    half = columns * 2
    return F.struct(half.alias("half_columns"), ((width - left - right - centre) / half).alias("half_width"), (top - above - outline / 2 - outline_margin - below).alias("height"))


def tool_counts(shapes: Column) -> Column:
    """map of the number of drawn shapes by tool."""
    tools = F.transform(shapes, lambda s: s["tool"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(tools)), lambda t: F.struct(t, F.size(F.filter(tools, lambda x: x == t)))))


def training_steps(rows: Column, batch: Column, epochs: Column) -> Column:
    """Steps of a run over so many rows, not rounded."""
    return rows / batch * epochs
