"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's str.strip and str.split treat as white space.
BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends. The zero-width non-joiner is no white space and stays."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; both ends are stripped."""
    return strip(F.regexp_replace(text, f"[{BLANKS}]+", " "))


def words(text: Column) -> Column:
    """White-space separated tokens; no token for null, empty or blank text."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def content_tokens(text: Column) -> Column:
    """Distinct runs of three or more letters of the Arabic block, the zero-width non-joiner included."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[؀-ۿ‌]{3,}"), F.lit(0)))


def _unaccented() -> tuple[str, str]:
    """Latin letters with diacritics, lower case, and the letters without."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and c.islower():
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _unaccented()


def index_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, Latin ones without diacritics; marks of other scripts part them."""
    low = F.lower(text)
    bare = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"[\x{300}-\x{331}]", "")
    bare = F.when(low.rlike(r"[\x{c0}-\x{24f}\x{300}-\x{331}\x{1e00}-\x{1eff}]"), bare).otherwise(low)  # few texts need it
    return F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fold_digits(text: Column) -> Column:
    """Arabic-Indic and Persian digits become ASCII digits."""
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def persian_letters(text: Column) -> Column:
    """Arabic yeh and kaf become the Persian letters, digits ASCII."""
    letters = F.replace(F.replace(text, F.lit("ي"), F.lit("ی")), F.lit("ك"), F.lit("ک"))
    return F.when(letters.rlike("[٠-٩۰-۹]"), fold_digits(letters)).otherwise(letters)


def persian(text: Column) -> Column:
    """``persian_letters`` with white space as single spaces; half-spaces stay."""
    return squeeze(persian_letters(text))


def jaccard(a: Column, b: Column) -> Column:
    """Common tokens by all tokens of two token arrays; 0 for two empty arrays."""
    both = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), both)


def has_repeated_trigram(text: Column) -> Column:
    """Whether three consecutive tokens occur twice."""
    w = words(text)
    grams = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " ")),
    ).otherwise(F.array().cast("array<string>"))
    return F.size(F.array_distinct(grams)) < F.size(grams)


def has_cloze(text: Column) -> Column:
    """Whether a text has the mark of a gap: three dots or underscores or more in a row, or an ellipsis."""
    return text.rlike(r"\.{3,}|_{3,}|\u2026")
