"""Text cleaning, comparison, cue scoring and prompt assembly as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and quotes a reply line may carry, marks ignored when two lines are compared,
# bracket pairs, the number prefix of a title, and two language-neutral noise patterns.
REPLY_LABELS = "译文|翻译|中文"
STRAIGHT_QUOTE = '"'
CURLY_QUOTES = "“”"
IGNORED_MARKS = r"[\s、。，．！？!?…‥・「」『』（）()【】\[\]〜~ー―—\-]+"
BRACKETS = [("『", "』"), ("「", "」"), ("【", "】"), ("（", "）"), ("《", "》")]
NUMBER_PREFIX = r"^\s*(第\s*[0-9０-９]+\s*(?:[-－ー][0-9０-９]+)?\s*[章話回]|[0-9０-９]+\s*(?:[-－ー][0-9０-９]+)?)"
NOISE_PUNCTUATION = r"^[、。．，！？!?…‥・ー\s]+$"
NOISE_LATIN = r"^[A-Za-z0-9\s\.\,\!\?\'\"-]+$"

WIDE_OFFSET = 0xFEE0


def _wide(chars: str) -> str:
    return "".join(chr(ord(c) + WIDE_OFFSET) for c in chars)


ALNUM = "".join(chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))


def strip(text: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_chars(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def is_noise(
    text: Column, duration: Column, no_speech: Column, patterns: Sequence[str], short: float = 2.5, silent: float = 0.35
) -> Column:
    """Blank, or matching a noise pattern while short or probably silent."""
    trimmed = strip(text)
    matched = trimmed.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    return is_blank(text) | (matched & ((duration < short) | (no_speech > silent)))


def clean_line(text: Column) -> Column:
    """Trim, drop a leading label, trim again, drop surrounding quotes."""
    unlabelled = F.regexp_replace(strip(text), rf"^\s*(?:{REPLY_LABELS})\s*[:：]\s*", "")
    return strip_chars(strip_chars(strip(unlabelled), STRAIGHT_QUOTE), CURLY_QUOTES)


def fold_width(text: Column) -> Column:
    """Full-width letters and digits to half width."""
    return F.translate(text, _wide(ALNUM), ALNUM)


def normalize_text(text: Column) -> Column:
    """Compatibility-fold the full-width block, the ideographic space and dot leaders, then drop marks.

    This is the built-in path; :func:`normalize_nfkc` covers every compatibility character.
    """
    folded = F.translate(text, _wide(PRINTABLE) + "　", PRINTABLE + " ")
    folded = F.replace(F.replace(folded, F.lit("…"), F.lit("...")), F.lit("‥"), F.lit(".."))
    return F.regexp_replace(folded, "(?U)" + IGNORED_MARKS, "")


def normalize_nfkc(text: Column) -> Column:
    """Full NFKC (an Arrow UDF: Spark has no built-in), then drop marks."""

    def fold(parts):
        import unicodedata

        return parts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    folded = F.pandas_udf(fold, "string", F.PandasUDFType.SCALAR)(text)
    return F.regexp_replace(folded, "(?U)" + IGNORED_MARKS, "")


def keep_numeric_prefix(original: Column, new: Column) -> Column:
    """Prepend the original's chapter or number prefix unless the start of ``new`` already has it."""
    prefix = fold_width(strip(F.regexp_extract(original, NUMBER_PREFIX, 1)))
    head = F.substr(fold_width(new), F.lit(1), F.length(prefix) + 4)
    present = F.instr(head, prefix) > 0
    return F.when((prefix == "") | present, new).otherwise(F.concat(prefix, F.lit(" "), new))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def balance_brackets(text: Column) -> Column:
    """Append the right brackets that are missing."""
    out = text
    for left, right in BRACKETS:
        missing = F.greatest(_count(text, left) - _count(text, right), F.lit(0))
        out = F.concat(out, F.repeat(F.lit(right), missing))
    return out


def parse_aligned_array(content: Column, n: Column) -> Column:
    """Texts of a JSON array of exactly ``n`` items found in ``content``; null otherwise.

    An object item gives its first non-empty ``zh``, ``translation`` or ``text``.
    """
    items = F.from_json(F.regexp_extract(content, r"(?s)\[.*\]", 0), "array<string>")

    def text_of(item: Column) -> Column:
        fields = [F.nullif(F.get_json_object(item, f"$.{k}"), F.lit("")) for k in ("zh", "translation", "text")]
        is_object = F.coalesce(item.startswith("{"), F.lit(False))
        return clean_line(F.when(is_object, F.coalesce(*fields, F.lit(""))).otherwise(item))

    return F.when(F.size(items) == n, F.transform(items, text_of))


def cue_score(text: Column, cues: Sequence[tuple[str, str, int]]) -> tuple[Column, Column]:
    """(weight sum, tag list) of the cue patterns ``(tag, regex, weight)`` found in the text."""
    hits = [(tag, text.rlike(regex), weight) for tag, regex, weight in cues]
    total = sum((F.when(h, weight).otherwise(0) for _, h, weight in hits), F.lit(0))
    tags = F.filter(F.array(*[F.when(h, F.lit(tag)) for tag, h, _ in hits]), lambda x: x.isNotNull())
    return total, tags


def apply_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in order, later rules seeing earlier output."""
    if not rules:
        return text
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules])
    return F.aggregate(table, text, lambda t, r: F.replace(t, r["a"], r["b"]))


def build_prompt(
    body: Column, prefix: str, glossary: Column | None = None, header: str = "", glossary_prefix: str | None = None, force: bool = False
) -> Column:
    """Prefix plus body; with a glossary (or always, if forced) the header and glossary come first."""
    plain = F.concat(F.lit(prefix), body)
    terms = F.coalesce(glossary, F.lit("")) if glossary is not None else F.lit("")
    headed = F.concat(F.lit(header + "\n"), terms, F.lit("\n"), F.lit(prefix if glossary_prefix is None else glossary_prefix), body)
    return headed if force else F.when(terms != "", headed).otherwise(plain)


def fallback_text(translation: Column, source: Column) -> Column:
    """Translation, or the source where it is blank."""
    return F.coalesce(F.nullif(strip(translation), F.lit("")), strip(source))
