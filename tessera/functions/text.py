"""Splitting text into words, and the text forms of numbers and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 29 code points at which Python's str.split() splits.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_SPACE = f"[{SPACES}]+"


def words(text: Column) -> Column:
    """White-space separated words; none for an empty text, null for null."""
    return F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")


def count_words(instances: Column) -> Column:
    """Words of all sentences, those without letters included; 0 for none or null."""
    return F.size(words(whole(instances))).cast("bigint")


def whole(instances: Column) -> Column:
    """All sentences as lines of one text; empty for none or null."""
    return F.coalesce(F.array_join(instances, "\n"), F.lit(""))


def word_characters(text: Column) -> Column:
    """Runs of letters, digits, underscores and apostrophes; a combining mark ends a run."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_\x27]+)"), 1)


def first_letter(word: Column) -> Column:
    """Code point of a word's first letter; 0, which is no letter, if it has none."""
    return F.ascii(F.regexp_extract(word, r"(\p{L})", 1))


def first_letters(instances: Column) -> Column:
    """``first_letter`` of each word of all sentences; an empty list for none or null."""
    return F.transform(words(whole(instances)), first_letter)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, for columns that are dropped again."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def one_decimal(x: Column) -> Column:
    """A number with one decimal, ties to even.

    Rounded is the exact value, as C and Python do, not its shortest decimal form: 63.55 is a little less than that, and gives 63.5.
    """
    ten = x * 8 + x * 2  # both are exact, so that what their sum lacks is so too
    lacks = x * 2 - (ten - x * 8)
    tie = ten - F.floor(ten) == 0.5
    tenths = F.when(tie & (lacks < 0), F.floor(ten)).when(tie & (lacks > 0), F.ceil(ten)).otherwise(F.bround(ten, 0))
    return F.format_string("%.1f", F.when(F.abs(x) < 1e15, tenths / 10).otherwise(x))


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


def shortened(text: Column, size: int = 120) -> Column:
    """The first ``size`` characters and an ellipsis, or the whole text if it is no longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def one_line(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters of a text with line breaks as spaces, without space around it."""
    return F.substring(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), 1, size)


def kind_of(raw: Column) -> Column:
    """``list``, ``object``, ``number``, ``boolean``, ``text`` or ``null`` for a value of varying JSON type, given as raw text.

    What is no JSON is the bare text of a string; null stays null.
    """
    shape = F.schema_of_variant(F.try_parse_json(raw))
    of = F.when(shape.startswith("ARRAY"), "list").when(shape.startswith("OBJECT"), "object").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null")
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    return F.when(raw.isNotNull(), of.when(number, "number").otherwise("text"))


def listed(raw: Column, compat: bool = False) -> Column:
    """One text for a value of varying JSON type (its raw JSON, or the bare text of a string).

    Items of a list are joined by ``; ``, of an object its keys.  A string stays as it
    is; with ``compat`` its characters are joined.  Null, empty and ``[]`` give ``''``.
    """
    kind = kind_of(raw)
    items = F.array_join(F.from_json(raw, "array<string>"), "; ")
    keys = F.array_join(F.map_keys(F.from_json(raw, "map<string,string>")), "; ")
    plain = F.array_join(F.filter(F.split(raw, ""), lambda c: c != ""), "; ") if compat else raw
    return F.coalesce(F.when(kind == "list", items).when(kind == "object", keys).otherwise(plain), F.lit(""))


def sentences(raw: Column) -> Column:
    """A list of sentences from raw JSON: a list as it is, a scalar as its only item, null for null."""
    parsed = F.when(kind_of(raw) == "list", F.from_json(raw, "array<string>"))
    return F.coalesce(parsed, F.when(raw.isNotNull(), F.array(raw)))
