"""Labels, slugs and number prefixes as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose decomposition is a base letter and marks: Latin-1 and Latin Extended-A and B, by rule.
_FOLDED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])}


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, null if nothing is left: the edge between raw and typed tables."""
    return F.nullif(F.trim(c), F.lit(""))


def or_blank(c: Column | str) -> Column:
    """Trimmed text, '' if null."""
    return F.coalesce(F.trim(c), F.lit(""))


def first_of(*cols: Column | str) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in map(_col, cols)])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(c: Column | str) -> Column:
    """Lower case, apostrophes dropped, other runs of non-alphanumerics one dash, no dash at the ends. Accented letters count as other."""
    plain = F.regexp_replace(F.trim(F.lower(c)), "['’]", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_value(c: Column | str) -> Column:
    """As `slugify` without trimming and with apostrophes as separators; one dash goes at each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_capped(c: Column | str, limit: int = 60) -> Column:
    """`slug_value` of at most `limit` characters: ids of sources."""
    return F.substring(slug_value(c), 1, limit)


def slug_term(c: Column | str) -> Column:
    """`slug_value` of trimmed text: ids of concepts."""
    return slug_value(F.trim(c))


def fold(c: Column | str) -> Column:
    """Accents removed from Latin letters, combining marks dropped."""
    folded = F.translate(c, "".join(_FOLDED), "".join(_FOLDED.values()))
    return F.regexp_replace(folded, r"[̀-ͯ]", "")


def normalize_label(c: Column | str) -> Column:
    """The key by which labels match: lower case, unaccented, other runs one blank."""
    return F.trim(F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]+", " "))


def int_prefix(c: Column | str) -> Column:
    """The whole number a text begins with, else null: '1846a' is 1846."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")


def float_prefix(c: Column | str) -> Column:
    """The decimal number a text begins with, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def safe_int(c: Column | str) -> Column:
    """Floor of the leading number as text, '' without one."""
    return F.coalesce(F.floor(float_prefix(c)).cast("string"), F.lit(""))


def nonzero_int(c: Column | str) -> Column:
    """Leading whole number, null if none or 0."""
    return F.nullif(int_prefix(c), F.lit(0).cast("long"))


def last_number(c: Column | str) -> Column:
    """The number an id ends with; the largest integer without one, so that such ids come last."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("long"), F.lit(2**53 - 1))


def padded(n: Column, width: int = 5) -> Column:
    """A number of at least so many digits, as text; longer ones stay whole, which `lpad` cuts."""
    digits = n.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def numbered(prefix: str, n: Column) -> Column:
    """An id like stm-00001."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 5, "0"))


def fixed(c: Column | str, digits: int) -> Column:
    """A number with so many decimals, as text; null stays null."""
    return F.when(_col(c).isNotNull(), F.format_string(f"%.{digits}f", _col(c)))
