"""Scalar functions on text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A governed stem: kebab parts, of which the first all-digit one is the code, neither first nor last.
STEM = r"^(?:(?!\d+-)[a-z0-9]+-)+\d+(?:-[a-z0-9]+)+\z"
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
KEBAB = r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*\z"
WORD = r"[\p{L}\p{N}]+"
#: Unicode white space.
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def is_stem(c: Column) -> Column:
    return c.rlike(STEM)


def stem_parts(c: Column) -> Column:
    """type, code, slug of a stem, split at its first all-digit part; nulls where it isn't one."""
    part = lambda k: F.when(is_stem(c), F.regexp_extract(c, r"^(.+?)-(\d+)-(.+)\z", k))
    return F.struct(part(1).alias("type"), F.try_to_number(part(2), F.lit("9999999999999999999")).cast("decimal(20,0)").alias("code"), part(3).alias("slug"))


def is_slug(c: Column) -> Column:
    return c.rlike(SLUG)


def slug_reason(c: Column) -> Column:
    """Why a slug is refused, null if it is fine."""
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(c.startswith("-") | c.endswith("-"), "edge hyphen")
        .when(c.contains("--"), "double hyphen")
        .when(~c.rlike(r"^[a-z0-9-]+\z"), "invalid character")
    )


def is_kebab(c: Column) -> Column:
    return c.rlike(KEBAB)


def token_count(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(c, F.lit(BLANK.replace("[", "[^", 1) + "+"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def term_count(text: Column, term: str) -> Column:
    """Occurrences of one word among the words of lower-cased text."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"))


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def anchor(c: Column) -> Column:
    """A heading's anchor: lower case, ASCII letters and digits, blanks and hyphens to single hyphens."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), rf"(?:{BLANK}|-)+", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def identifier_words(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", " ")


def search_text(stem: Column, heading_path: Column, text: Column) -> Column:
    """What lexical search looks at: stem and file name, both also as words, headings, text."""
    name = F.concat(stem, F.lit(".md"))
    return F.concat_ws("\n", stem, name, identifier_words(stem), identifier_words(name), F.array_join(heading_path, " / "), text)


def padded_code(code: Column, width: int) -> Column:
    digits = code.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def format_chunk_id(package: Column, stem: Column, ordinal: Column, chunk_hash: Column) -> Column:
    return F.concat_ws("/", F.coalesce(package, F.lit("workspace")), stem, padded_code(ordinal, 4), chunk_hash)
