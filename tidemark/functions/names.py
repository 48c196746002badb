"""File names, keys taken from paths, and human-readable sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import balance_brackets, fold_width, strip, strip_chars

# Characters and device names not allowed in file names, longest name, key patterns.
QUOTES = "\"'“”"
NUMBERING = r"^\s*\d+\s*[.、):：]\s*"
ILLEGAL = r'[\\/:*?"<>|]'
DEVICES = ["CON", "PRN", "AUX", "NUL", *[f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]]
LONGEST = 120
TRACK = r"(?i)track[_\-\s]*(\d+)"
TRACK_STRICT = r"(?i)(?:tr|track)[_\-\s]*(\d+)"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def safe_name(text: Column) -> Column:
    """A file name valid everywhere; ``unnamed`` when nothing is left."""
    s = strip_chars(strip(text), QUOTES)
    s = F.regexp_replace(s, NUMBERING, "")
    s = F.replace(balance_brackets(fold_width(s)), F.lit("　"), F.lit(" "))
    s = F.regexp_replace(F.regexp_replace(s, ILLEGAL, ""), r"(?U)\s+", " ")
    s = F.regexp_replace(strip(s), r"[. ]+$", "")
    device = F.split_part(F.upper(s), F.lit("."), F.lit(1)).isin(*DEVICES)
    s = F.left(F.when(device, F.concat(F.lit("_"), s)).otherwise(s), F.lit(LONGEST))
    return F.when(s == "", "unnamed").otherwise(s)


def work_key(path: Column, pattern: str) -> Column:
    """Group key: the first match of ``pattern`` (group 1) in the path, empty if none."""
    return F.regexp_extract(path, pattern, 1)


def track_key(name: Column) -> Column:
    """Two-digit track number: after ``track``, else the first digits, else empty."""
    tagged = F.regexp_extract(name, TRACK, 1)
    digits = F.when(tagged != "", tagged).otherwise(F.regexp_extract(name, r"(\d+)", 1))
    return F.when(F.length(digits) == 1, F.concat(F.lit("0"), digits)).otherwise(digits)


def track_number(name: Column) -> Column:
    """Track number only where ``tr`` or ``track`` announces it; null otherwise."""
    return F.nullif(F.regexp_extract(name, TRACK_STRICT, 1), F.lit("")).try_cast("int")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix (dots inside the stem stay)."""
    return F.regexp_extract(file_name(path), r"^(.+?)(?:\.[^.]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def mirror_path(path: Column, root: str, target: str, extension: str) -> Column:
    """Output path: same place below ``target`` (bare name if outside ``root``), new extension."""
    base, out = root.rstrip("/") + "/", target.rstrip("/") + "/"
    inside = path.startswith(base)
    rest = F.when(inside, F.substr(path, F.lit(len(base) + 1))).otherwise(file_name(path))
    folder = F.regexp_extract(rest, r"^(.*/)?[^/]*$", 1)
    return F.concat(F.lit(out), folder, stem(rest), F.lit(extension))


def human_size(n: Column) -> Column:
    size, out = n.cast("double"), None
    for i, unit in reversed(list(enumerate(SIZE_UNITS))):
        text = F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(1024**i)), 1))
        out = text if out is None else F.when(size < float(1024 ** (i + 1)), text).otherwise(out)
    return out


def format_ts(t: Column) -> Column:
    """``[mm:ss.xx]``, never negative, seconds never 60."""
    cs = F.bround(F.greatest(t, F.lit(0.0)) * 100, 0).cast("long")
    return F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def format_srt_ts(t: Column) -> Column:
    """``hh:mm:ss,mmm`` from rounded milliseconds."""
    ms = F.bround(t * 1000, 0).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    )


def format_mmss(t: Column) -> Column:
    whole = t.cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def format_sec(t: Column) -> Column:
    whole = F.bround(t, 0).cast("long")
    long_ = F.format_string("%d分%02d秒", F.floor(whole / 60), whole % 60)
    return F.when(whole >= 60, long_).otherwise(F.format_string("%d秒", whole))
