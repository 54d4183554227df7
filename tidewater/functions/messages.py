"""Strings that hold lists, messages and names, as expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of messages.
DRIFT = r"at\s+(\d+),(\d+)\s+OFFSET\s+([\d.]+)\s+deg\.\s+([-\d.]+),([-\d.]+)\s+pix\."
QUALITIES = ("GOOD", "FAIR", "POOR")
KINDS = {"0": "scene", "1": "caption", "3": "microphone"}
NUMBER = r"[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?"
#: A quoted part of a list that was printed, or an unquoted one.
PART = r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([^\s,'\"\[\]()]+)"


def parts(text: Column) -> Column:
    """The parts of a printed (nested) list in order, quotes and blanks around them removed, empty ones too. A text that is
    no list has itself as its only part."""
    found = F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    plain = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^(['\"])(.*)\1$", "$2"), r"\\(.)", "$1")))
    listed = F.filter(plain, lambda x: x != "")
    return F.when(text.rlike(r"^\s*[\[(]"), listed).otherwise(F.filter(F.array(F.trim(F.regexp_replace(text, r"^\s*(['\"])(.*)\1\s*$", "$2"))), lambda x: x != ""))


def captions(text: Column) -> Column:
    """The captions of a printed list, a single one as a list of one; none for null."""
    return F.coalesce(F.when(text.isNotNull(), parts(text)), F.array().cast("array<string>"))


def numbers(text: Column) -> Column:
    """The numbers of a printed scalar or list, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def least_number(text: Column) -> Column:
    """The smallest number of a scalar or list: the first time that was noted."""
    return F.array_min(numbers(text))


def first_number(text: Column) -> Column:
    return F.get(numbers(text), F.lit(0))


def vector(text: Column) -> Column:
    """A printed vector ("[0.1 0.2 ...]") as an array."""
    return F.when(text.isNotNull(), numbers(text))


def trial_number(text: Column) -> Column:
    """n of 'TRIALID n'; null where there is none."""
    return F.regexp_extract(text, r"^\s*\S+\s+(-?\d+)", 1).try_cast("long")


def kind_of(text: Column) -> Column:
    """scene, caption, microphone or unknown, by the message's second character."""
    code = F.substring(text, 2, 1)
    out = F.lit("unknown")
    for k, v in KINDS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def drift(text: Column) -> Column:
    """check_x, check_y, offset_deg, offset_x, offset_y and offset_pix (length) of a drift message; null if it is none."""
    part = lambda k, kind: F.regexp_extract(text, DRIFT, k).try_cast(kind)
    dx, dy = part(4, "double"), part(5, "double")
    fields = F.struct(part(1, "long").alias("check_x"), part(2, "long").alias("check_y"), part(3, "double").alias("offset_deg"), dx.alias("offset_x"), dy.alias("offset_y"), F.hypot(dx, dy).alias("offset_pix"))
    return F.when(text.rlike(DRIFT), fields)


def validation(text: Column) -> Column:
    """validation_type, eye, quality, avg_error, max_error, offset_deg, offset_x, offset_y of a validation message, read by
    the words before them; null if it is none."""
    t = parts(text)
    at = lambda word: F.array_position(t, word)  # from 1; 0 without
    item = lambda i: F.get(t, (i - 1).cast("int"))
    number = lambda i: item(i).try_cast("double")
    error, offset, pix = at("ERROR"), at("OFFSET"), at("pix.")
    before = F.slice(t, F.greatest(error - 5, F.lit(1)).cast("int"), F.greatest(F.least(error - 1, F.lit(5)), F.lit(0)).cast("int"))
    quality = F.coalesce(F.get(F.filter(before, lambda x: x.isin(*QUALITIES)), F.lit(0)), F.lit("UNKNOWN"))
    eye = F.when(at("LEFT") > 0, "LEFT").when(at("RIGHT") > 0, "RIGHT").otherwise("UNKNOWN")
    after = lambda word: F.array_position(F.slice(t, F.greatest(error, F.lit(1)).cast("int"), F.size(t)), word) + error - 1
    most = F.when(at("avg.") > 0, number(after("avg.") + 1)).when(at("max") > 0, number(after("max") - 1))
    pair = F.when((offset > 0) & (pix > 1), F.split(item(pix - 1), ","))
    xy = lambda k: F.when(F.size(pair) > 1, F.get(pair, F.lit(k)).try_cast("double"))
    fields = F.struct(
        F.coalesce(item(at("VALIDATION") + 1), F.lit("UNKNOWN")).alias("validation_type"), eye.alias("eye"), F.when(error > 0, quality).otherwise("UNKNOWN").alias("quality"),
        F.when(error > 0, number(error + 1)).alias("avg_error"), F.when(error > 0, most).alias("max_error"), F.when(offset > 0, number(offset + 1)).alias("offset_deg"), xy(0).alias("offset_x"), xy(1).alias("offset_y"),
    )
    return F.when(at("VALIDATION") > 0, fields)


def point_errors(text: Column) -> Column:
    """Point number to its error: of each POINT n the number after the next OFFSET, up to 18 parts on. The last one of a
    point counts; null without any."""
    t = parts(text)
    spots = F.filter(F.transform(t, lambda x, i: F.when(x == "POINT", i)), lambda i: i.isNotNull())

    def entry(i: Column) -> Column:
        rest = F.slice(t, i + 3, F.lit(18))
        off = F.array_position(rest, "OFFSET")
        return F.struct(F.get(t, i + 1).try_cast("long").alias("k"), F.when(off > 0, F.get(rest, off.cast("int")).try_cast("double")).alias("v"))

    found = F.filter(F.transform(spots, entry), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.when(F.size(last) > 0, F.map_from_entries(last))


#: Fixed value: the form of a photo's address.
PHOTO = r"(?i)/(\d+)_[a-f0-9]+(?:_[a-z])?\.jpg$"


def photo_id(url: Column) -> Column:
    """The number of a photo in its file's address, which ends with <number>_<secret>.jpg or <number>_<secret>_<size>.jpg (the
    secret in hex digits, the size one letter, in any case); null where there is none."""
    return F.nullif(F.regexp_extract(url, PHOTO, 1), F.lit("")).try_cast("long")


def name_parts(name: Column, names: list[str]) -> list[Column]:
    """The parts of a file's name (without folder and suffix) between underscores; whole numbers as such, else null."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return [F.get(F.split(stem, "_"), F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(names)]


def padded(number: Column, width: int, head: str = "") -> Column:
    """A number with zeros before it, longer ones as they are."""
    digits = number.cast("string")
    return F.concat(F.lit(head), F.when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def signature(fields: dict[str, Column], head: Column) -> Column:
    """head and the first 16 hex digits of the SHA-256 of the fields that are not null, as JSON in the order of their names."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "true"})
    return F.concat(head, F.lit("_"), F.substring(F.sha2(body, 256), 1, 16))


def style(own: Column, other: Column) -> Column:
    """false, other or self: own marks win over those of others."""
    return F.when(F.coalesce(own, F.lit(False)), "self").when(F.coalesce(other, F.lit(False)), "other").otherwise("false")


def readable_size(n: Column) -> Column:
    """Bytes as a text with one decimal and a unit."""
    out = F.format_string("%.1f TB", n / 1e12)
    for unit, size in (("GB", 1e9), ("MB", 1e6), ("KB", 1e3)):
        out = F.when(n < size * 1000, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return F.when(n < 1000, F.format_string("%d B", n.cast("long"))).otherwise(out)
