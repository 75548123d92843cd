"""Column functions: casts that never raise, boxes, label vectors, names. All are built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_double(c: Column) -> Column:
    """A number, or NaN where the text is none."""
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def parse_int(c: Column) -> Column:
    """The whole part of a number, or null ("3.7" is 3)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 2**31), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))).cast("int")


def parse_int_strict(c: Column) -> Column:
    """An integer without a fraction, or null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d{1,9}$"), F.trim(c).try_cast("int"))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def is_upper_true(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)) == "TRUE", F.lit(False))


def is_lower_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def strict_bool(c: Column) -> Column:
    """True or false; any other text raises."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes", "y"), F.lit(True)).when(low.isin("false", "0", "no", "n"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def round_binary(c: Column, digits: int) -> Column:
    """Half away from zero of the number as it is held in binary, as most engines round, not of its shortest decimal text."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c * scale) + 0.5) / scale


def finite(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & ~F.isnan(c) & (F.abs(c) < float("inf")) & c.isNotNull()
    return out


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 0.0) -> dict[str, Column]:
    """Edges of a box, grown by a margin, within an image: floors at the left and top, ceilings at the right and bottom."""
    dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
    zero, one = F.lit(0.0), F.lit(1.0)
    left, top = F.floor(F.greatest(zero, F.least(x0 - dx, width - 1.0))), F.floor(F.greatest(zero, F.least(y0 - dy, height - 1.0)))
    right, bottom = F.ceil(F.greatest(one, F.least(x1 + dx, width.cast("double")))), F.ceil(F.greatest(one, F.least(y1 + dy, height.cast("double"))))
    return {"left": left, "top": top, "right": right, "bottom": bottom, "crop_width": F.greatest(F.lit(0), right - left), "crop_height": F.greatest(F.lit(0), bottom - top)}


def needs_clamp(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return (x0 < 0) | (y0 < 0) | (x1 > width) | (y1 > height)


def box_reason(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """The first reason why a box is invalid, or an empty string."""
    c = clamp_box(x0, y0, x1, y1, width, height, margin)
    return (
        F.when(~finite(x0, y0, x1, y1), "non_finite_bbox")
        .when((x1 <= x0) | (y1 <= y0), "non_positive_bbox_area")
        .when((x1 <= 0) | (y1 <= 0) | (x0 >= width) | (y0 >= height), "bbox_completely_outside_image")
        .when((c["crop_width"] <= 0) | (c["crop_height"] <= 0), "empty_after_clamp")
        .otherwise("")
    )


def label_vector(ids: Column, k: int) -> Column:
    """0/1 of each of k classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array_contains(ids, i).cast("int"))


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def at_least(p: Column, t: Column) -> Column:
    """0/1 of each class whose probability reaches its threshold."""
    return F.zip_with(p, t, lambda a, b: (a >= b).cast("int"))


def argmax(p: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def letterbox(width: Column, height: Column, size: int) -> dict[str, Column]:
    """Scaled size and paddings that fit an image into a square, without its pixels."""
    scale = F.least(size / width.cast("double"), size / height.cast("double"))
    w, h = F.greatest(F.lit(1), F.bround(width * scale).cast("int")), F.greatest(F.lit(1), F.bround(height * scale).cast("int"))
    left, top = F.floor((size - w) / 2).cast("int"), F.floor((size - h) / 2).cast("int")
    return {"resized_width": w, "resized_height": h, "pad_left": left, "pad_top": top, "pad_right": size - w - left, "pad_bottom": size - h - top}


def crop_name(source: Column, class_id: Column, box: Column) -> Column:
    """<source>_class<k>_bbox<0007>: the name of a crop."""
    return F.format_string("%s_class%d_bbox%04d", source.cast("string"), class_id, box)


def with_prefix(path: Column, old: str, new: str) -> Column:
    """Every ``old`` within a path as ``new``, with slashes for backslashes."""
    return F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(old), F.lit(new))


#: Names like img_1_class2_radR8_bbox0007__aug_brightness_0003_f097.png; the middle and last parts may be absent.
ROI_NAME = r"^(.+)_class(\d+)(?:_rad([^_]+))?_bbox(\d+)(?:__aug_brightness_(\d+)_f(\d+))?\.[A-Za-z]+$"


def roi_name(c: Column, pattern: str = ROI_NAME) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(c, pattern, i)
    stem = F.regexp_replace(c, r"\.[A-Za-z]+$", "")
    return {"source_image_id": part(1), "class_id": part(2).try_cast("int"), "rad_id": part(3), "annotation_index": part(4).try_cast("int"), "augmented": part(5) != "", "original_roi_id": F.substring_index(stem, "__aug_brightness_", 1)}


def hash_unit(seed: str, key: Column) -> Column:
    """An integer of 32 bits that any engine with SHA-256 can reproduce."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def moment(text: Column) -> Column:
    """A timestamp from text in ISO form, with or without a time, fraction or zone; null where it is none."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))


def slug(time: Column) -> Column:
    """A timestamp as 20240131_235959, for names."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def seconds_between(begin: Column, end: Column) -> Column:
    """Seconds with their fraction from one timestamp to another; negative where the second is earlier."""
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(1e6)


def collapsed(text: Column, most: int | None = None) -> Column:
    """White space of any kind as single blanks, none at the ends; cut to ``most`` characters, of which three dots are the last."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return plain if most is None else F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most - 3)), F.lit("..."))).otherwise(plain)


def folded(text: Column) -> Column:
    """Text for comparison without case: lower case after upper case, so that a sharp s equals two."""
    return F.lower(F.upper(text))


def section(text: Column, heading: str, following: str = "\n## ") -> Column:
    """What stands between the first place of a heading and the next heading, or the end; empty where it is absent."""
    at = F.instr(text, heading)
    rest = F.substring(text, at + len(heading), F.length(text))
    body = F.when(F.instr(rest, following) > 0, F.substring(rest, F.lit(1), F.instr(rest, following) - 1)).otherwise(rest)
    return F.when(at > 0, F.trim(body)).otherwise("")


def without_lines(text: Column, terms: list[str]) -> Column:
    """The lines that hold none of some terms, by case."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~reduce(or_, (line.contains(t) for t in terms)))
    return F.trim(F.array_join(kept, "\n"))
