"""Column functions for countries, operators and organisation names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case keyword in an AS name, in order of precedence, and the operator it stands for.
OPERATOR_KEYWORDS = [("akamai", "Akamai"), ("cloudflare", "Cloudflare"), ("fastly", "Fastly")]
NAMED_OPERATORS = [name for _, name in OPERATOR_KEYWORDS]
# Labels of rows without an attribution.
UNROUTED = "(unrouted)"
LOOKUP_FAILURE = "(lookup failure)"
CONTAINMENT_FAILURE = "(invalid BGP containment)"
UNKNOWN_ORG = "(unknown org)"


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def country_key(country: Column) -> Column:
    """Rollup key of a country: empty counts as its own country ``??``."""
    return F.coalesce(blank_to_null(country), F.lit("??"))


def selected_country(code: str) -> str:
    code = code.strip().upper()
    if len(code) != 2 or not code.isalpha():
        raise ValueError(f"not a two-letter country code: {code!r}")
    return code


def _after_dash(name: Column) -> Column:
    at = F.locate(" - ", name)
    return F.when(at > 0, F.substring(name, at + 3, F.length(name))).otherwise(name)


def organisation(as_name: Column) -> Column:
    """Text after the first ``" - "`` without a trailing two-letter country; NULL for an empty name."""
    return F.when(as_name != "", F.trim(F.regexp_replace(_after_dash(as_name), r",\s*\p{L}{2}\s*$", "")))


def operator_class(as_name: Column) -> Column:
    """Named operator of an AS name, else its organisation."""
    low = F.lower(F.coalesce(as_name, F.lit("")))
    out = F.coalesce(blank_to_null(organisation(as_name)), F.lit(UNKNOWN_ORG))
    for keyword, name in reversed(OPERATOR_KEYWORDS):
        out = F.when(low.contains(keyword), F.lit(name)).otherwise(out)
    return out


def asn_label(asn: Column, as_name: Column) -> Column:
    """``Org (ASn)``; a missing name leaves ``ASn (ASn)``."""
    number = F.concat(F.lit("AS"), asn.cast("string"))
    name = F.coalesce(as_name, number)
    return F.concat(F.regexp_replace(_after_dash(name), ",[^,]*$", ""), F.lit(" ("), number, F.lit(")"))


def location_key(value: Column) -> Column:
    """Comparison form of a place name; the raw value stays in its own column."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def percent_text(part: Column, whole: Column, digits: int = 6) -> Column:
    """``part/whole`` in percent as text with fixed decimals; ``n/a`` for an empty whole."""
    value = (part.cast("double") / whole.cast("double") * 100).cast("double")
    return F.when(whole > 0, F.format_string(f"%.{digits}f", value)).otherwise(F.lit("n/a"))
