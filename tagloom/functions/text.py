"""Text, UTF-16 and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_len(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_slice(text: Column, start: Column, stop: Column) -> Column:
    """Units [start, stop); null if empty, out of range or through a surrogate pair."""
    raw = F.encode(text, "UTF-16BE")
    cut = F.substring(raw, (start * 2 + 1).cast("int"), ((stop - start) * 2).cast("int"))
    hexed = F.hex(cut)
    broken = hexed.rlike("^D[C-F]") | hexed.rlike("D[89AB][0-9A-F]{2}$") & (F.length(hexed) % 4 == 0)
    inside = (start >= 0) & (stop > start) & (stop <= utf16_len(text))
    return F.when(inside & ~broken, F.decode(cut, "UTF-16BE"))


def norm_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# letters whose upper case is several letters: their titlecase letter, or themselves; the sharp s has a capital of its own
_LONG = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
_ONE = ["\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _LONG]


def upper_by_letter(text: Column) -> Column:
    """Upper case that is as long as the text, as SQL engines without full case mappings have it: no letter becomes two."""
    letter = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, "".join(_LONG), "".join(_ONE))).otherwise(F.upper(c))
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), letter), ""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def cpc_symbol(section: Column, cls: Column, subclass: Column, main_group: Column, subgroup: Column) -> Column:
    """``B28B1/29`` from its parts; missing parts are empty."""
    part = [F.coalesce(c, F.lit("")) for c in (section, cls, subclass, main_group, subgroup)]
    return F.concat(*part[:4], F.lit("/"), part[4])


def ops_date(text: Column) -> Column:
    """``YYYYMMDD`` to ISO text, checked by shape only."""
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_list(text: Column) -> Column:
    """A JSON array of strings; bad or missing JSON is an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


# fixed values: device names that can't be folders
RESERVED = ("CON", "PRN", "AUX", "NUL")


def safe_folder_name(name: Column) -> Column:
    """A name that is a folder name on every system, never empty."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, r'[\p{Cc}<>:"/\\|?*]', "_")), r"[. ]+$", "")
    stem = F.upper(F.rtrim(F.split_part(clean, F.lit("."), F.lit(1))))
    device = stem.isin(*RESERVED) | stem.rlike("^(COM|LPT)[1-9]$")
    return F.when(clean == "", "_").when(device, F.concat(clean, F.lit("_"))).otherwise(clean)
