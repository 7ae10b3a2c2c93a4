"""Text functions as Spark columns; they stay inside code generation unless a docstring says otherwise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# What a full case fold leaves in ASCII beyond lower-casing. All other characters fold to
# something that the normalisers below treat as a gap.
CASE_FOLDS = {
    "ß": "ss", "ẞ": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ŉ": " n", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a ",
}
# Fixed value: white space as Unicode text processing in Python has it, for a regular expression's class.
SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Word endings that lose two letters.
LONG_PLURALS = ("ches", "shes", "sses", "xes", "zes")
UNCLASSIFIED = "unclassified"

HEADING = r"^(#{1,6})[" + SPACES + r"]+(.+?)[" + SPACES + r"]*$"


def page_marker(tag: str) -> str:
    """The pattern of a page marker line; ``tag`` names the tool that writes them."""
    return rf"^<!--\s*{tag}:page=(\d+)\s*-->$"


def tokenize(text: Column) -> Column:
    """Lower-case ASCII letters and digits in runs."""
    # Splitting costs an eighth of the time of extracting all matches.
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def fold(text: Column) -> Column:
    """Lower case with the case folds that matter to ASCII."""
    # German has one of them; most texts hold none of the others, which a look for their one range tells. A class of all of them takes ten times as long.
    plain = F.replace(text, F.lit("ß"), F.lit(CASE_FOLDS["ß"]))
    folded = plain
    for char, out in CASE_FOLDS.items():
        folded = F.replace(folded, F.lit(char), F.lit(out)) if char != "ß" else folded
    others = [c for c in CASE_FOLDS if c != "ß"]
    return F.lower(F.when(plain.rlike(f"[{min(others)}-{max(others)}]"), folded).otherwise(plain))


def fold_words(text: Column) -> Column:
    """The folded words; a query of several normal forms makes them in a step of their own, once."""
    return F.array_remove(F.split(fold(text), "[^a-z0-9]+"), "")


def normal_text(text: Column) -> Column:
    """Folded words joined by single spaces."""
    return F.array_join(fold_words(text), " ")


def normal_type(text: Column) -> Column:
    """Folded words joined by underscores."""
    return F.array_join(fold_words(text), "_")


def singular(word: Column) -> Column:
    """A folded word without its plural ending."""
    n = F.length(word)
    long_plural = (n > 4) & word.rlike(f"(?:{'|'.join(LONG_PLURALS)})$")
    # Most words do not end with an s, which one look tells.
    return F.when(~word.endswith("s") | (n <= 3), word).otherwise(
        F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).when(long_plural, F.left(word, n - 2)).when(~word.endswith("ss"), F.left(word, n - 1)).otherwise(word)
    )


def singular_words(words: Column) -> Column:
    """Folded words in the singular, joined by spaces."""
    return F.array_join(F.transform(words, singular), " ")


def normal_name(text: Column) -> Column:
    """Folded words in the singular, joined by spaces: what names are compared by."""
    return singular_words(fold_words(text))


def normal_names(label: Column, aliases: Column) -> Column:
    """The distinct non-blank normal names of a label and its aliases."""
    names = F.transform(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), normal_name)
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def same_type(left: Column, right: Column) -> Column:
    """Equal normal types, or either unclassified."""
    a, b = normal_type(left), normal_type(right)
    return (a == b) | (a == UNCLASSIFIED) | (b == UNCLASSIFIED)


def has_content(text: Column) -> Column:
    """Any letter or digit of any script (P05); newer scripts than Java's tables are missed, see ``has_content_exact``."""
    return text.rlike(r"[\p{L}\p{N}]")


@F.pandas_udf(BooleanType())
def has_content_exact(text: pd.Series) -> pd.Series:
    """P05 by Python's tables, in Arrow batches."""
    return text.map(lambda t: any(c.isalnum() for c in t) if t is not None else None).astype("boolean")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def normal_lines(text: Column) -> Column:
    """Line ends as line feeds, without white space around (F16)."""
    return strip(F.regexp_replace(text, "\r\n?", "\n"))


def timestamp_label(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS with unbounded hours."""
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def seconds_label(ms: Column) -> Column:
    """Milliseconds as seconds with three digits."""
    return F.format_string("%.3f", ms / F.lit(1000.0))


def source_location(source: Column, start: Column, end: Column) -> Column:
    """Page or slide range; empty without pages."""
    slides = F.lower(F.regexp_extract(source, r"[^/]\.[^./]+$", 0)).endswith(".pptx")
    one = F.concat(F.when(slides, "slide ").otherwise("p. "), start.cast("string"))
    many = F.concat(F.when(slides, "slides ").otherwise("pp. "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(start.isNull(), F.lit("")).when(start.eqNullSafe(end), one).otherwise(many)


def source_reference(source: Column, start: Column, end: Column) -> Column:
    """``source (location)``, or the source alone."""
    where = source_location(source, start, end)
    return F.when(where == "", source).otherwise(F.concat(source, F.lit(" ("), where, F.lit(")")))


def canonical_json(value: dict | None) -> str:
    """Sorted keys, ASCII, one space after separators (F09). Properties are kept in this form, so no UDF runs later."""
    return json.dumps(value or {}, sort_keys=True)


@F.pandas_udf(StringType())
def canonical_json_text(text: pd.Series) -> pd.Series:
    """F09 over JSON texts, in Arrow batches."""
    return text.map(lambda t: None if t is None else canonical_json(json.loads(t)))


def _has(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def _filled(properties: Column) -> Column:
    return _has(properties) & (properties != "{}")


def node_text(label: Column, kind: Column, aliases: Column, suggested: Column, properties: Column) -> Column:
    """``label [type] | aliases: … | suggested type: … | properties: …``."""
    return F.concat_ws(
        " | ",
        F.concat(label, F.lit(" ["), kind, F.lit("]")),
        F.when(F.size(aliases) > 0, F.concat(F.lit("aliases: "), F.array_join(aliases, ", "))),
        F.when(_has(suggested), F.concat(F.lit("suggested type: "), suggested)),
        F.when(_filled(properties), F.concat(F.lit("properties: "), properties)),
    )


def relationship_text(source: Column, edge: Column, target: Column, properties: Column) -> Column:
    """``source --edge--> target | properties: …``."""
    arrow = F.concat(source, F.lit(" --"), edge, F.lit("--> "), target)
    return F.concat_ws(" | ", arrow, F.when(_filled(properties), F.concat(F.lit("properties: "), properties)))


def edge_metadata_text(label: Column, properties: Column) -> Column:
    return F.concat_ws(" | ", label, F.when(_filled(properties), F.concat(F.lit("properties: "), properties)))


def node_search_text(label: Column, kind: Column, aliases: Column, suggested: Column, properties: Column) -> Column:
    """Label, type, aliases, suggested type and properties on lines of their own."""
    return F.concat_ws("\n", label, kind, aliases, F.when(_has(suggested), suggested), F.when(_filled(properties), properties))


def node_embedding_text(label: Column, kind: Column, suggested: Column, aliases: Column, properties: Column, relations: Column) -> Column:
    """What a node is embedded by."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("label: "), label),
        F.concat(F.lit("type: "), kind),
        F.when(_has(suggested), F.concat(F.lit("suggested_type: "), suggested)),
        F.when(F.size(aliases) > 0, F.concat(F.lit("aliases: "), F.array_join(aliases, ", "))),
        F.when(_filled(properties), F.concat(F.lit("properties: "), properties)),
        F.when(F.size(relations) > 0, F.concat(F.lit("relationships: "), F.array_join(F.array_distinct(relations), "; "))),
    )


def spaced(text: Column) -> Column:
    """Folded text with single spaces: what search texts are told apart by."""
    return strip(F.regexp_replace(fold(text), rf"[{SPACES}]+", " "))


def common_prefix(left: Column, right: Column) -> Column:
    """The heading path that two fragments share."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(F.slice(left, F.lit(1), n).alias("a"), F.slice(right, F.lit(1), n).alias("b"))
    differs = F.array_position(F.transform(pairs, lambda p: p["a"] != p["b"]), F.lit(True))
    return F.slice(left, F.lit(1), F.when(differs == 0, n).otherwise(differs - 1).cast("int"))


def escape_html(text: Column) -> Column:
    """& < > and both quotes as entities."""
    for char, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(out))
    return text


def thread_id(chat: Column, user: Column, group: Column) -> Column:
    """A conversation's key: the chat, and in groups the user as well."""
    return F.concat(F.lit("chat:"), chat.cast("string"), F.when(group, F.concat(F.lit(":user:"), user.cast("string"))).otherwise(""))


def split_message(text: str, limit: int = 4096) -> list[str]:
    """Parts of at most ``limit`` characters, cut at a line feed, else at a space, else anywhere."""
    parts = []
    rest = text.strip()
    while len(rest) > limit:
        at = max(rest.rfind("\n", 0, limit + 1), 0) or max(rest.rfind(" ", 0, limit + 1), 0) or limit
        parts.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*parts, rest] if rest else parts


@F.pandas_udf(ArrayType(StringType()))
def split_messages(text: pd.Series) -> pd.Series:
    """F17 in Arrow batches."""
    return text.map(lambda t: None if t is None else split_message(t))


#: Characters of parts that a worker holds before it gives them back.
BATCH_CHARS = 1_000_000


def message_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, part, message`` of every text (F17), a text at a time, so that a worker holds few parts however long its batch is."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            places, parts, messages, size = [], [], [], 0
            flush = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(parts, pa.int32()), pa.array(messages, pa.string())], [key, "part", "message"])  # noqa: B023, E731
            for place, value in enumerate(batch.column(1)):
                for part, message in enumerate(split_message(value.as_py() or "")):
                    places.append(place)
                    parts.append(part)
                    messages.append(message)
                    size += len(message) + 100
                if size >= BATCH_CHARS:
                    yield flush()
                    places, parts, messages, size = [], [], [], 0
            if places:
                yield flush()

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, part int, message string")
