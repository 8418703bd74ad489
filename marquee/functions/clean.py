"""Column -> Column cleaners.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and push no Python into the scan.  ANSI mode is on in Spark 4, so every
conversion of untrusted text goes through ``try_*`` and ``get``.

Java regexes need ``(?U)`` to give ``\\s`` and ``\\d`` the Unicode meaning the
reference's Python regexes have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# Title normalisation patterns (B1): trailing "(yyyy)", runs of characters
# outside [a-z0-9 ] (replaced by one space).
TITLE_YEAR_SUFFIX = r"\s*\(\d{4}\)$"
TITLE_DROP = "[^a-z0-9 ]+"
# Money text characters removed before the integer cast.
MONEY_CHARS = "[$,]"
# Year at the start of an ISO date (B4) and of a signed time claim.
ISO_YEAR_PREFIX = r"^(\d{4})"
CLAIM_YEAR_PREFIX = r"^.(\d{4})"
# Placeholder texts treated as missing.
PLACEHOLDERS = ("N/A", "")
# Date formats tried in order when a date is parsed from free text.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy",
                "d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM", "yyyy")
# Runtime segment edges (B12): <90 Short, <=120 Standard, else Long.
RUNTIME_SEGMENTS = ((90, "Short"), (121, "Standard"))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    c = _c(c)
    return c.isNull() | (strip(c.cast("string")) == "")


def norm_title(c, variant: str = "canonical") -> Column:
    """B1: lower, drop a trailing "(yyyy)", non ``[a-z0-9 ]`` runs -> space,
    collapse spaces, trim.  NULL -> ''.

    ``variant='keep_edges'`` skips the final trim (two notebook variants);
    ``variant='year_anywhere'`` removes "(yyyy)" wherever it occurs.
    """
    s = strip(F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))))
    year_re = "(?U)" + (TITLE_YEAR_SUFFIX[:-1] if variant == "year_anywhere" else TITLE_YEAR_SUFFIX)
    s = F.regexp_replace(s, year_re, "")
    s = F.regexp_replace(s, TITLE_DROP, " ")
    s = F.regexp_replace(s, " +", " ")
    return s if variant == "keep_edges" else F.trim(s)


def norm_text(c) -> Column:
    """B2: trim, lower, collapse whitespace.  NULL -> ''."""
    s = strip(F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))))
    return F.regexp_replace(s, r"(?U)\s+", " ")


def parse_date(c, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses wins; NULL when none does."""
    s = strip(_c(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats])


def row_year(year_c, date_c=None, formats: Sequence[str] = DATE_FORMATS,
             year_is_numeric: bool = False) -> Column:
    """``Year`` when it is an integer, else year of the parsed ``Date``.

    A numeric ``Year`` column is cast as a number (``2023.0`` -> 2023); a text
    one through ``try_cast`` so ``'2023.0'`` and junk stay NULL.
    """
    if year_c is None:
        y = F.lit(None).cast("int")
    elif year_is_numeric:
        y = _c(year_c).cast("int")
    else:
        y = strip(_c(year_c).cast("string")).try_cast("int")
    if date_c is None:
        return y
    return F.coalesce(y, F.year(parse_date(date_c, formats)))


def prefix_year(c) -> Column:
    """Year from an ISO prefix ``yyyy...``; anything else NULL."""
    return F.regexp_extract(_c(c), ISO_YEAR_PREFIX, 1).try_cast("int")


def minutes(c) -> Column:
    """``'120 min'`` -> 120; only texts containing ``min`` qualify."""
    c = _c(c)
    return F.when(c.contains("min"), F.split_part(c, F.lit(" "), F.lit(1)).try_cast("int"))


def token_count(c) -> Column:
    """Number of non-blank comma tokens; NULL or empty text -> NULL."""
    c = _c(c)
    n = F.size(F.filter(F.split(c, ","), lambda x: strip(x) != ""))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("int")).otherwise(n)


def money(c) -> Column:
    """``'$1,234'`` -> 1234 (bigint); placeholders and suffixes -> NULL."""
    return F.regexp_replace(_c(c), MONEY_CHARS, "").try_cast("bigint")


def first_part(c, sep: str = ",") -> Column:
    """Text before the first separator, trimmed; blank -> NULL."""
    v = strip(F.split_part(_c(c), F.lit(sep), F.lit(1)))
    return F.when(v != "", v)


def last_part(c, sep: str = ",") -> Column:
    """Last non-blank part after splitting on ``sep``."""
    parts = F.filter(F.transform(F.split(_c(c), sep), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.get(parts, F.size(parts) - 1))


def poster_url(path_c, base: str) -> Column:
    """Base URL || path, NULL when the path is NULL."""
    return F.concat(F.lit(base), _c(path_c))


def to_number(c, dtype: str = "double") -> Column:
    """Numeric coercion, bad text -> NULL (ANSI-safe)."""
    return _c(c).try_cast(dtype)


def bracket(c, edges: Sequence[tuple[float, str]], top: str, unknown: str = "Unknown") -> Column:
    """``edges`` = ((upper_exclusive, label), ...) ascending."""
    c = _c(c)
    expr = F.when(c.isNull(), F.lit(unknown))
    for upper, label in edges:
        expr = expr.when(c < F.lit(upper), F.lit(label))
    return expr.otherwise(F.lit(top))


def runtime_segment(c) -> Column:
    """NULL Unknown, <90 Short, <=120 Standard, else Long."""
    return bracket(c, RUNTIME_SEGMENTS, "Long")


def or_unknown(c, label: str = "Unknown") -> Column:
    """B13."""
    return F.coalesce(_c(c), F.lit(label))


def placeholder_null(c, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """Trimmed placeholder text -> NULL."""
    v = strip(_c(c).cast("string"))
    return F.when(~v.isin(list(placeholders)), v)


def split_name(c) -> Column:
    """struct(first, surname) = first token / rest; one token -> surname NULL."""
    v = F.regexp_replace(strip(_c(c)), r"(?U)\s+", " ")
    first = F.when(v != "", F.split_part(v, F.lit(" "), F.lit(1)))
    rest = F.regexp_extract(v, r"^\S+ (.+)$", 1)
    return F.struct(first.alias("first_name"), F.when(rest != "", rest).alias("surname"))


def award_counts(c) -> Column:
    """Award text -> struct(wins, nominations, oscars_won, oscar_nominations).

    Grammar [decision]: ``Won N Oscar(s)``, ``Nominated for N Oscar(s)``,
    ``N win(s)``, ``N nomination(s)``; an absent part is 0; NULL or a
    placeholder gives NULLs.
    """
    v = placeholder_null(c)

    def grab(pattern: str) -> Column:
        n = F.regexp_extract(v, pattern, 1)
        return F.when(v.isNotNull(), F.coalesce(F.when(n != "", n.cast("int")), F.lit(0)))

    return F.struct(
        grab(r"(\d+) wins?\b").alias("wins"),
        grab(r"(\d+) nominations?\b").alias("nominations"),
        grab(r"Won (\d+) Oscars?\b").alias("oscars_won"),
        grab(r"Nominated for (\d+) Oscars?\b").alias("oscar_nominations"),
    )


def genre_blend(c) -> Column:
    """``'Animation, Adventure, Comedy'`` -> ``'AnimationAdventureComedy'``."""
    parts = F.filter(F.transform(F.split(_c(c), ","), strip), lambda x: x != "")
    return F.when(_c(c).isNotNull(), F.array_join(parts, ""))


def nth_token(c, i: int) -> Column:
    """I-th (0-based) comma token, NULL when out of range."""
    return F.get(F.split(strip(_c(c)), r"\s*,\s*"), F.lit(i))


def percent(c, precision: int = 4, scale: int = 1) -> Column:
    """``'85%'`` -> 85.0 as decimal(p,s)."""
    return F.regexp_replace(strip(_c(c)), "%$", "").try_cast(f"decimal({precision},{scale})")


def date_key(d) -> Column:
    """yyyyMMdd integer key (arithmetic, no string formatting)."""
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def better_date(existing, candidate, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Keep the existing birth date unless the candidate adds detail
    for the same year."""
    e, cnd = _c(existing).cast("string"), _c(candidate).cast("string")
    e_year, c_year = F.year(parse_date(e, formats)), F.year(parse_date(cnd, formats))
    return (F.when(is_blank(cnd), e)
            .when(is_blank(e), cnd)
            .when(c_year.isNull(), e)
            .when(e_year.isNotNull() & (e_year != c_year), e)
            .when(F.length(cnd) > F.length(e), cnd)
            .otherwise(e))


def fill_missing(existing, candidate, blank_is_missing: bool = False) -> Column:
    """Keep ``existing`` unless it is missing."""
    e = _c(existing)
    if blank_is_missing:
        return F.when(is_blank(e), _c(candidate)).otherwise(e)
    return F.coalesce(e, _c(candidate))


def inception_year(c) -> Column:
    """``'+1923-04-04T00:00:00Z'`` -> 1923."""
    return F.regexp_extract(_c(c), CLAIM_YEAR_PREFIX, 1).try_cast("int")


def dq_message(text: str, n) -> Column:
    """Message ``text + STR(n)`` (right-aligned to width 10)."""
    return F.concat(F.lit(text), F.lpad(_c(n).cast("string"), 10, " "))


def fail_ok(n) -> Column:
    """B34."""
    return F.when(_c(n) > 0, F.lit("FAIL")).otherwise(F.lit("OK"))


def day_distance(a, b, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Absolute day difference, NULL if either side does not parse."""
    return F.abs(F.datediff(parse_date(a, formats), parse_date(b, formats)))


def clamp_zero(c) -> Column:
    """B36."""
    return F.greatest(_c(c).cast("double"), F.lit(0.0))


def safe_ratio(num, den) -> Column:
    """NULL on a zero or NULL denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def business_key(*parts, sep: str = "|") -> Column:
    """Business key = normalised parts joined by ``sep`` (NULL part ->
    empty string, so the key is never NULL)."""
    return F.concat_ws(sep, *[norm_text(p) for p in parts])


def claim_year(claims_json, path: str = "$.P571[0].mainsnak.datavalue.value.time") -> Column:
    """H5 + B29: year of a time claim inside a nested JSON claim document."""
    return inception_year(F.get_json_object(_c(claims_json), path))
