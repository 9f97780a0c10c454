"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network.

A value of a format is numbered 0..a*b-1, split into a digit of base a and one of base b, and each
half in turn is shifted by a keyed hash of the other. That is a permutation of the format's values, so
equal values get equal pseudonyms in every document, different ones stay different, and the
result passes the same validation. Text between the values is untouched. Expressions only.

Formats: payment cards (13 to 19 digits, Luhn), telephone numbers (+country and 7 to 14 digits, at most one space, hyphen, dot
or slash between two digits, area in parentheses or not), IPv4 addresses,
US social security numbers, dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, mm/dd/yyyy, years 1601 to 2400, permuted
within 1601 to 2000 or 2001 to 2400). E-mail addresses and quoted hexadecimal tokens have no such numbering; keyed digests in the same
format stand for them. Numbers that fail validation stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixledger.llm.common import packed

ROUNDS = 8
KINDS = ("email", "card", "phone", "ip", "ssn", "date", "token")

#: Between two digits of a telephone number: a closing bracket, one separator, an opening bracket.
_GAP = "(?:(?<=\\([0-9]{1,6})\\))?[ \u00a0\u2011./-]?"
_OPEN = _GAP + r"(?:\((?=[0-9]{1,6}\)))?"
#: What a telephone number of eight digits or more does not run on into.
_OTHER = (
    r"[ \u00a0](?:(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|[./-][0-9])"
    r"|(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?=[0-9])|(?![0-9]))){4}(?<![.])(?!\.[0-9])"
    r"|(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))"
)
#: +1 and ten digits in groups of 3, 3, 4; eleven digits or more without a gap; else as many as fit.
_PHONES = (rf"1{_OPEN}[0-9]{{3}}{_OPEN}[0-9]{{3}}{_GAP}[0-9]{{4}}", r"[1-9][0-9]{10,16}(?![./-][0-9])", rf"[1-9](?:{_OPEN}[0-9]){{7}}(?:(?!{_OTHER}){_GAP}[0-9]){{0,9}}")

#: One alternative a kind; look-behinds let each be tried only where a run begins.
_PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])\+(?:{'|'.join(x + '(?![0-9])' for x in _PHONES)})",
    "token": r"(?<=\")[0-9A-Fa-f]{32,64}(?=\")",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
PATTERN = "|".join(_PATTERNS.values())
_SQL_KIND = {
    "email": "m LIKE '%@%'", "phone": "m LIKE '+%'", "token": "rlike(m, '^[0-9A-Fa-f]{32,64}$')",
    "ip": r"rlike(m, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')", "date": "length(m) = 10", "ssn": "rlike(m, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')",
}
#: Country codes of one and two digits (E.164); all others have three.
COUNTRY = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = "aggregate(sequence(1, length({d})), 0L, (s, i) -> s + if(pmod(i, 2) = {odd}, CAST(substring({d}, length({d}) + 1 - i, 1) AS INT), pmod(2 * CAST(substring({d}, length({d}) + 1 - i, 1) AS INT), 10) + 2 * CAST(substring({d}, length({d}) + 1 - i, 1) AS INT) DIV 10))"


def _prepared() -> str:
    """Each match with its kind, its digits, and its value as a date where it is one."""
    kind = "CASE " + " ".join(f"WHEN {test} THEN '{k}'" for k, test in _SQL_KIND.items()) + " ELSE 'card' END"
    iso, back = "concat(substring(m, 1, 4), '-', substring(m, {a}, 2), '-', substring(m, {b}, 2))", "concat(substring(m, 7, 4), '-', substring(m, {a}, 2), '-', substring(m, {b}, 2))"
    try_date = "try_to_timestamp({}, 'yyyy-MM-dd')"
    first = try_date.format(f"if(substring(m, 5, 1) = '-', {iso.format(a=6, b=9)}, {back.format(a=4, b=1)})")
    second = try_date.format(f"if(substring(m, 3, 1) = '/', {back.format(a=1, b=4)}, NULL)")
    is_date = "length(m) = 10 AND rlike(m, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$')"
    layout = f"if(substring(m, 5, 1) = '-', 'yyyyMMdd', if({first} IS NOT NULL, 'ddMMyyyy', 'MMddyyyy'))"
    return (
        f"transform(_found, m -> struct(m AS m, {kind} AS kind, {_DIGITS} AS d, "
        f"if({is_date}, CAST(coalesce({first}, {second}) AS DATE), NULL) AS day, if({is_date}, {layout}, NULL) AS layout))"
    )


def _numbered() -> str:
    """Number ``x`` of the value within its format and the bases a and b; x is null where validation fails."""
    digits = lambda d: f"CAST({d} AS BIGINT)"
    half = lambda n: f"CAST(power(10, {n}) AS BIGINT)"
    body = "substring(v.d, 1, length(v.d) - 1)"
    # the country code follows from the digits (E.164), not from the gaps, so all ways to write a number have one pseudonym
    code = f"length(regexp_extract(v.d, '^(?:{COUNTRY}|...)', 0))"
    keep = f"greatest(length(v.d) - 14, least({code}, length(v.d) - 7))"
    rest = f"substring(v.d, {keep} + 1)"
    octet = lambda i: f"CAST(element_at(split(v.m, '[.]'), {i}) AS INT)"
    octets = [octet(i) for i in range(1, 5)]
    cycle = "(pmod(datediff(v.day, DATE'2001-01-01'), 146097))"
    area, group, serial = (f"CAST(substring(v.d, {p}, {n}) AS INT)" for p, n in ((1, 3), (4, 2), (6, 4)))
    area_number = f"({area} - 1 - if({area} > 666, 1, 0))"
    cases = {
        "card": (f"length(v.d) BETWEEN 13 AND 19 AND pmod({_LUHN.format(d='v.d', odd=1)}, 10) = 0", digits(body), half("(length(v.d) - 1) DIV 2"), half("length(v.d) - 1 - (length(v.d) - 1) DIV 2")),
        "phone": ("length(v.d) BETWEEN 8 AND 17", digits(rest), half(f"length({rest}) DIV 2"), half(f"length({rest}) - length({rest}) DIV 2")),
        "ip": (" AND ".join(f"{o} <= 255" for o in octets), f"(({octets[0]} * 256 + {octets[1]}) * 65536L + {octets[2]} * 256 + {octets[3]})", "65536L", "65536L"),
        "date": ("year(v.day) BETWEEN 1601 AND 2400", f"CAST({cycle} AS BIGINT)", "189L", "773L"),
        "ssn": (f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0", f"({area_number} * 989901L + ({group} - 1) * 9999L + {serial} - 1)", "898L", "989901L"),
    }
    pick = lambda n: "CASE " + " ".join(f"WHEN v.kind = '{k}' AND {c[0]} THEN {c[n]}" for k, c in cases.items()) + " END"
    return f"transform(_values, v -> struct(v.*, {pick(1)} AS x, {pick(2)} AS a, {pick(3)} AS b, {keep} AS cc))".replace("v.*", "v.m AS m, v.kind AS kind, v.d AS d, v.day AS day, v.layout AS layout")


def _permuted() -> str:
    """The Feistel rounds: halves l (base a) and r (base b) in turn shifted by a keyed hash of the other."""
    shift = lambda other: f"CAST(conv(substring(sha2(concat_ws('|', _key, v.kind, v.a, v.b, i, {other}), 256), 1, 15), 16, 10) AS BIGINT)"
    step = f"if(pmod(i, 2) = 1, named_struct('l', pmod(s.l + pmod({shift('s.r')}, v.a), v.a), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + pmod({shift('s.l')}, v.b), v.b)))"
    rounds = f"aggregate(sequence(1, {ROUNDS}), named_struct('l', v.x DIV v.b, 'r', pmod(v.x, v.b)), (s, i) -> {step}, s -> s.l * v.b + s.r)"
    return f"transform(_numbers, v -> struct(v.m AS m, v.kind AS kind, v.d AS d, v.day AS day, v.layout AS layout, v.cc AS cc, v.x AS x, if(v.x IS NULL, NULL, {rounds}) AS y))"


def _digits_again() -> str:
    """The digits that take the place of the value's, in order."""
    card = "lpad(CAST(v.y AS STRING), length(v.d) - 1, '0')"
    check = f"CAST(pmod(10 - pmod({_LUHN.format(d=card, odd=0)}, 10), 10) AS STRING)"
    area = "(v.y DIV 989901 + 1)"
    ssn = f"concat(lpad(CAST({area} + if({area} >= 666, 1, 0) AS STRING), 3, '0'), lpad(CAST(pmod(v.y, 989901) DIV 9999 + 1 AS STRING), 2, '0'), lpad(CAST(pmod(pmod(v.y, 989901), 9999) + 1 AS STRING), 4, '0'))"
    day = "date_format(date_add(v.day, CAST(v.y - v.x AS INT)), v.layout)"
    cases = {
        "card": f"concat({card}, {check})",
        "phone": "concat(substring(v.d, 1, v.cc), lpad(CAST(v.y AS STRING), length(v.d) - v.cc, '0'))",
        "date": day,
        "ssn": ssn,
    }
    return "CASE " + " ".join(f"WHEN v.kind = '{k}' THEN {c}" for k, c in cases.items()) + " END"


def _written() -> str:
    """The text of each pseudonym; the value itself where validation failed."""
    place = "length(regexp_replace(substring(v.m, 1, p), '[^0-9]', ''))"
    laid = f"array_join(transform(sequence(1, length(v.m)), p -> if(rlike(substring(v.m, p, 1), '[0-9]'), substring(v.n, {place}, 1), substring(v.m, p, 1))), '')"
    ip = "concat_ws('.', v.y DIV 16777216, pmod(v.y DIV 65536, 256), pmod(v.y DIV 256, 256), pmod(v.y, 256))"
    digest = "sha2(concat_ws('|', _key, v.kind, lower(v.m)), 256)"
    email = f"concat('p', substring({digest}, 1, 16), '@example.com')"
    token = f"if(v.m = upper(v.m), upper(substring({digest}, 1, length(v.m))), substring({digest}, 1, length(v.m)))"
    return f"transform(_digits, v -> CASE WHEN v.kind = 'email' THEN {email} WHEN v.kind = 'token' THEN {token} WHEN v.y IS NULL THEN v.m WHEN v.kind = 'ip' THEN {ip} ELSE {laid} END)"


def pseudonymised(df: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """``row`` (the whole row as it was), ``new_text`` and ``n_<kind>`` (values replaced) for every row of ``df``.

    Rows are independent: no shuffle, repeated rows alike. Null text stays null with counts 0, an empty text stays empty,
    a text without values stays as it is, byte for byte. An empty table gives an empty result.
    """
    rows = packed(df, _text=text).select("row", "_text", F.lit(key).alias("_key"))
    may = F.col("_text").rlike("[0-9@]|[A-Fa-f]{32}")
    rows = rows.select("*", F.when(may, F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0))).alias("_found"))
    rows = rows.select("row", "_text", "_key", F.when(F.size("_found") > 0, F.col("_found")).alias("_found"))
    rows = rows.select("*", F.expr(_prepared()).alias("_values"))
    rows = rows.select("row", "_text", "_key", F.expr(_numbered()).alias("_numbers"))
    rows = rows.select("row", "_text", "_key", F.expr(_permuted()).alias("_halves"))
    rows = rows.select("row", "_text", "_key", F.expr(f"transform(_halves, v -> struct(v.m AS m, v.kind AS kind, v.y AS y, if(v.y IS NULL, NULL, {_digits_again()}) AS n))").alias("_digits"))
    rows = rows.select("row", "_text", "_digits", F.expr(_written()).alias("_new"))
    between = F.split("_text", PATTERN, -1)
    joined = F.array_join(F.zip_with(between, "_new", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    replaced = "size(filter(_digits, v -> v.kind = '{kind}' AND (v.y IS NOT NULL OR v.kind IN ('email', 'token'))))"
    counts = [F.expr(f"CAST(if(_digits IS NULL, 0, {replaced.format(kind=kind)}) AS BIGINT) AS n_{kind}") for kind in KINDS]
    return rows.select("row", F.when(F.col("_new").isNull(), F.col("_text")).otherwise(joined).alias("new_text"), *counts)


def replace_text(df: DataFrame, key: str, *, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``df`` with column ``text`` pseudonymised, other columns unchanged (``n_chars``, if named, follows the new length)."""
    out = pseudonymised(df, key, text=text)
    values = [F.col("new_text").alias(c) if c == text else F.length("new_text").cast(df.schema[c].dataType).alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    return out.select(*values)

