"""Languages, their code point ranges and their scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The range of a word's first letter, by language name.
LANGUAGE_RANGES = {
    "Arabic": (0x0600, 0x06FF),
    "Chinese": (0x4E00, 0x9FFF),
    "Hindi": (0x0900, 0x097F),
    "French": (0x0000, 0x00FF),
    "English": (0x0000, 0x00FF),
    "Spanish": (0x0000, 0x00FF),
    "German": (0x0000, 0x00FF),
    "Japanese": (0x3040, 0x309F),
    "Vietnamese": (0x0000, 0x00FF),
    "Bengali": (0x0980, 0x09FF),
    "Thai": (0x0E00, 0x0E7F),
    "Korean": (0xAC00, 0xD7AF),
    "Russian": (0x0400, 0x04FF),
}
DEFAULT_RANGE = (0x0000, 0x00FF)

# Lower-case language names by script.
SCRIPT_LANGUAGES = {
    "arabic": ["arabic"],
    "han": ["chinese", "mandarin", "cantonese"],
    "japanese": ["japanese"],
    "hangul": ["korean"],
    "cyrillic": ["russian", "ukrainian", "bulgarian", "serbian"],
    "greek": ["greek"],
    "hebrew": ["hebrew"],
    "devanagari": ["hindi"],
    "thai": ["thai"],
    "latin": ["english", "spanish", "french", "german", "italian", "portuguese", "catalan", "turkish", "vietnamese", "indonesian", "malay"],
}

# Code point ranges by script; Latin is a Unicode property without two ordinal signs.
SCRIPT_RANGES = {
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF)],
    "japanese": [(0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)],
    "cyrillic": [(0x0400, 0x04FF), (0x0500, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "hebrew": [(0x0590, 0x05FF)],
    "devanagari": [(0x0900, 0x097F)],
    "thai": [(0x0E00, 0x0E7F)],
}


def range_of(language: Column) -> tuple[Column, Column]:
    """First and last code point of a language's letters; names are case-sensitive, unlisted ones have the Latin range.

    Ranges begin at 1 at least: 0 stands for no letter.
    """
    table = F.create_map(*(x for name, r in LANGUAGE_RANGES.items() for x in (F.lit(name), F.array(*map(F.lit, r)))))
    found = F.coalesce(F.element_at(table, language), F.array(*map(F.lit, DEFAULT_RANGE)))
    return F.greatest(found[0], F.lit(1)), found[1]


def ranges(spark: SparkSession) -> DataFrame:
    """(language, lo, hi): 13 rows."""
    return spark.createDataFrame([(k, *v) for k, v in LANGUAGE_RANGES.items()], "language string, lo int, hi int")


def script_ranges(spark: SparkSession) -> DataFrame:
    """(script, lo, hi): a few rows for each script but Latin."""
    return spark.createDataFrame([(k, *r) for k, rs in SCRIPT_RANGES.items() for r in rs], "script string, lo int, hi int")


def script_of(language: Column) -> Column:
    """Script of a language, whatever the case of its name and space around it; ``unknown`` if unlisted or null."""
    name = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    table = F.create_map(*(F.lit(x) for script, names in SCRIPT_LANGUAGES.items() for n in names for x in (n, script)))
    return F.coalesce(F.element_at(table, name), F.lit("unknown"))


def character_class(script: str) -> str:
    """The inside of a regular expression's class for a script."""
    if script == "latin":
        return r"\p{IsLatin}&&[^\x{AA}\x{BA}]"
    return "".join(rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}" for lo, hi in SCRIPT_RANGES[script])


def in_script(code: Column, script: str) -> Column:
    """Whether a code point is in a range of the script, which is any but Latin."""
    found = F.lit(False)
    for lo, hi in SCRIPT_RANGES[script]:
        found = found | code.between(lo, hi)
    return found


def characters_in(text: Column, script: Column) -> Column:
    """How many characters of a text belong to a script; null for an unknown script."""
    counted = F.lit(None).cast("int")
    for name in SCRIPT_LANGUAGES:
        counted = F.when(script == name, F.regexp_count(text, F.lit(f"[{character_class(name)}]"))).otherwise(counted)
    return counted


def characters_in_either(text: Column, first: Column, second: Column) -> Column:
    """How many characters of a text belong to one of two scripts; one in both counts once."""
    one = F.lit(None).cast("int")
    for a in SCRIPT_LANGUAGES:
        for b in SCRIPT_LANGUAGES:
            if a < b:
                both = F.regexp_count(text, F.lit(f"[[{character_class(a)}][{character_class(b)}]]"))
                one = F.when(((first == a) & (second == b)) | ((first == b) & (second == a)), both).otherwise(one)
    return one
