"""Paths, names, label lines and other text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of archive members by extension (fixed values).
KINDS = {
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"],
    "label": [".txt"],
    "video": [".mp4", ".mov", ".avi", ".mkv"],
    "model": [".pt", ".pth", ".ckpt", ".onnx"],
    "archive": [".zip", ".tar", ".gz", ".tgz", ".rar", ".7z"],
    "config": [".yaml", ".yml", ".json", ".toml", ".ini", ".cfg"],
    "metadata": [".csv", ".md", ".xml", ".log"],
}
#: Words of a member's path that say what it holds (fixed values).
CONCEPTS = ["train", "training", "val", "validation", "test", "images", "imagenes", "labels", "etiquetas", "video", "videos"]
#: Names that a portable path may not have on some system (fixed values).
RESERVED = ["con", "prn", "aux", "nul", *[f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)]]


def forward(path: Column) -> Column:
    """Forward slashes, without leading ./ and doubled or trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), r"(?<=.)/+(?=/|$)", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(forward(path), "/"), lambda s: s != "")


def depth(path: Column) -> Column:
    return F.size(segments(path))


def stem(path: Column) -> Column:
    """The last segment in lower case, without its extension."""
    return F.lower(F.regexp_replace(F.element_at(F.split(forward(path), "/"), -1), r"(?<=.)\.[^.]*$", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(forward(path), "/"), -1), r".\.([A-Za-z0-9]+)$", 1))


def suffix(path: Column) -> Column:
    """The last segment's extension in lower case with its dot; empty for a leading or final dot alone."""
    return F.lower(F.regexp_extract(F.element_at(F.split(forward(path), "/"), -1), r".(\.[^.]+)$", 1))


def member_kind(path: Column) -> Column:
    """What a member is by its extension: one of KINDS, or other."""
    out = F.lit("other")
    for kind, names in reversed(KINDS.items()):
        out = F.when(suffix(path).isin(names), kind).otherwise(out)
    return out


def split_of(path: Column, folders: dict[str, list[str]]) -> Column:
    """The first split of `folders` that has a folder on the path, else unknown."""
    parts = F.transform(segments(path), lambda s: F.lower(s))
    out = F.lit("unknown")
    for name, aliases in reversed(folders.items()):
        out = F.when(F.arrays_overlap(parts, F.array(*[F.lit(a) for a in aliases])), name).otherwise(out)
    return out


def concepts(path: Column, vocabulary: list[str] = CONCEPTS) -> Column:
    """Words of the vocabulary among a path's tokens (between / _ . - and blanks), in the vocabulary's order, joined by commas."""
    tokens = F.split(F.lower(path), r"[/_. -]+")
    return F.array_join(F.filter(F.array(*[F.lit(w) for w in vocabulary]), lambda w: F.array_contains(tokens, w)), ",")


def portable(path: Column) -> Column:
    """A relative path that every system takes: no drive, root, backslash, empty, dot or reserved segment, colon or control."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda s: s.isin("", ".", "..") | F.lower(F.regexp_replace(s, r"\..*$", "")).isin(RESERVED) | s.rlike(r"[. ]$"))
    return F.coalesce((path != "") & ~path.rlike(r"[\\:\x00-\x1f]") & ~bad, F.lit(False))


def frame_parts(name: Column) -> Column:
    """struct<digits, series, frame, confidence> of a file stem.

    series: `vN`, `vidN` or `videoN`, else what stands before the frame's digits; frame: the digits of `frame_N`, else the
    first run of three digits or more. Confidence is medium with both by their own marks, low with a frame alone, else unknown.
    """
    digits = F.regexp_extract_all(name, F.lit(r"[0-9]+"), F.lit(0))
    series = F.regexp_extract(name, r"(?i)(?:^|[^a-z])((?:video|vid|v)_?[0-9]+)", 1)
    marked = F.regexp_extract(name, r"(?i)frame_?([0-9]+)", 1)
    loose = F.regexp_extract(name, r"([0-9]{3,})", 1)
    frame = F.when(marked != "", marked).when(loose != "", loose)
    before = F.regexp_replace(F.regexp_extract(name, r"^(.*?)[0-9]{3,}", 1), r"[_\-]+$", "")
    own = F.when(series != "", F.lower(series)).when((loose != "") & (before != ""), before)
    confidence = F.when((series != "") & (marked != ""), "medium").when(frame.isNotNull(), "low").otherwise("unknown")
    return F.struct(digits.alias("digits"), own.alias("series"), F.try_to_number(frame, F.lit("999999999999999999")).cast("long").alias("frame"), confidence.alias("confidence"))


def frame_rate(value: Column) -> Column:
    """A rational such as 30000/1001 as a double; null for 0/0, N/A and anything else that isn't a positive number."""
    parts = F.split(value, "/")
    top, below = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.when((F.size(parts) <= 2) & (below != 0) & (top / below > 0), top / below)


def utc_timestamp(value: Column) -> Column:
    """An ISO-8601 text with an explicit offset of zero as a timestamp, else null."""
    shaped = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-]00:?00)$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(value, r"(Z|[+-]00:?00)$", "+00:00")))


def slug(identity: Column, least: int = 40, tail: int = 8) -> Column:
    """A folder name: letters, digits and single hyphens, then the start of the identity's hash."""
    plain = F.trim(F.regexp_replace(F.lower(identity), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat_ws("-", F.substr(plain, F.lit(1), F.lit(least)), F.substr(F.sha2(identity, 256), F.lit(1), F.lit(tail)))


def label_boxes(text: Column, classes: int = 5, slack: float = 0.01) -> Column:
    """struct<boxes, issues, canonical> of a label file's text: lines of `class x y w h`, blank lines passed over.

    A line needs five fields, an integer class below `classes`, finite numbers, centres in 0..1 and sizes in (0, 1]; a box
    whose edges lie outside by more than rounding is an issue of its own (`outside`), and kept if within `slack`. canonical:
    sorted boxes rounded to ten digits, one a line.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")

    def numbers(f: Column) -> Column:
        num = lambda i: F.get(f, F.lit(i)).try_cast("double")
        return F.struct(F.size(f).alias("n"), F.get(f, F.lit(0)).try_cast("int").alias("c"), *[num(i).alias(k) for i, k in enumerate("xywh", 1)])

    def checked(r: Column) -> Column:
        c, x, y, w, h = (r[k] for k in "cxywh")
        finite = F.forall(F.array(x, y, w, h), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        beyond = F.greatest(w / 2 - x, h / 2 - y, x + w / 2 - 1, y + h / 2 - 1)
        issue = (
            F.when(r["n"] != 5, "fields").when(c.isNull() | ~F.coalesce(finite, F.lit(False)), "number").when((c < 0) | (c >= classes), "class")
            .when(~(x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)), "range")
            .when(beyond > slack, "outside").when(beyond > 1e-9, "edge")
        )
        return F.struct(*[r[k].alias(k) for k in "cxywh"], issue.alias("issue"))

    # Each step binds what the next one uses several times.
    rows = F.transform(F.transform(F.transform(lines, lambda s: F.split(s, r"\s+")), numbers), checked)
    kept = F.filter(rows, lambda r: r["issue"].isNull() | (r["issue"] == "edge"))
    boxes = F.transform(kept, lambda r: F.struct(*[r[k].alias(k) for k in ("c", "x", "y", "w", "h")]))
    issues = F.array_sort(F.transform(F.filter(rows, lambda r: r["issue"].isNotNull()), lambda r: r["issue"]))
    shown = F.transform(
        F.array_sort(boxes), lambda r: F.concat_ws(" ", r["c"].cast("string"), *[F.format_string("%.10f", r[k]) for k in ("x", "y", "w", "h")])
    )
    return F.struct(boxes.alias("boxes"), issues.alias("issues"), F.array_join(shown, "\n").alias("canonical"))


def sorted_boxes(text: Column) -> Column:
    """The boxes <c, x, y, w, h> of a label file's text in order: what its annotation is, whatever the order of its lines."""
    return F.array_sort(F.transform(F.filter(checked_lines(text), lambda r: r["box"]), lambda r: F.struct(*[r[k].alias(k) for k in "cxywh"])))


def checked_lines(text: Column) -> Column:
    """The lines of a label file's text with their numbers and what is wrong with each: box, off, slight, out; see label_report."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\\n\\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

    def parsed(f: Column) -> Column:
        fine = (F.size(f) == 5) & F.get(f, F.lit(0)).rlike(r"^\+?[0-9]+$|^-0+$") & F.forall(F.slice(f, 2, 4), lambda v: v.rlike(number))
        value = lambda i: F.when(fine, F.get(f, F.lit(i)).try_cast("double"))
        return F.struct(F.when(fine, F.get(f, F.lit(0)).try_cast("long")).alias("c"), *[value(i).alias(k) for i, k in enumerate("xywh", 1)])

    def checked(r: Column) -> Column:
        c, x, y, w, h = (r[k] for k in "cxywh")
        box = c.isNotNull() & F.forall(F.array(x, y, w, h), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
        low, high = F.least(x - w / 2, y - h / 2), F.greatest(x + w / 2, y + h / 2)
        normal = x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
        outside, slight = box & ~((low >= 0) & (high <= 1)), (low >= -0.01) & (high <= 1.01)
        return F.struct(*[r[k].alias(k) for k in "cxywh"], box.alias("box"), (box & ~normal).alias("off"), (outside & slight).alias("slight"), (outside & ~slight).alias("out"))

    return F.transform(F.transform(F.transform(lines, lambda s: F.split(s, " ")), parsed), checked)


def label_report(text: Column) -> Column:
    """struct<label_empty, syntax_valid, normalized_valid, geometry_valid, label_valid, num_objects, n_errors, n_warnings, classes,
    area_mean, area_min, area_max, width_mean, height_mean> of a label file's text, without changing it.

    A line of five fields, a class that is no negative integer and finite numbers is a box, whatever its values: centres outside
    0..1 or sizes outside (0, 1] break normalization, edges outside the image break geometry (a warning within 0.01, else an
    error). Other lines break the syntax and are no boxes. No lines but blank ones is an empty, valid label.
    """
    def report(rows: Column) -> Column:
        boxes = F.filter(rows, lambda r: r["box"])
        some = lambda k: F.exists(rows, lambda r: r[k])
        many = lambda test: F.size(F.filter(rows, test))
        syntax, normal, geometry = F.forall(rows, lambda r: r["box"]), ~some("off"), ~some("slight") & ~some("out")
        areas = F.transform(boxes, lambda r: r["w"] * r["h"])
        mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / F.size(xs))
        errors = many(lambda r: ~r["box"]) + many(lambda r: r["off"]) + many(lambda r: r["out"])
        return F.struct(
            (F.size(rows) == 0).alias("label_empty"), syntax.alias("syntax_valid"), normal.alias("normalized_valid"), geometry.alias("geometry_valid"),
            (syntax & normal & geometry).alias("label_valid"), F.size(boxes).alias("num_objects"), errors.alias("n_errors"), many(lambda r: r["slight"]).alias("n_warnings"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(boxes, lambda r: r["c"]))), ",").alias("classes"),
            mean(areas).alias("area_mean"), F.array_min(areas).alias("area_min"), F.array_max(areas).alias("area_max"),
            mean(F.transform(boxes, lambda r: r["w"])).alias("width_mean"), mean(F.transform(boxes, lambda r: r["h"])).alias("height_mean"),
        )

    return F.get(F.transform(F.array(checked_lines(text)), report), F.lit(0))  # binds the lines once
