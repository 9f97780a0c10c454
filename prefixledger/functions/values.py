"""Column functions for lenient scalars, timestamps and packet fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """NULL for NULL and for the empty string: both mean that the field is absent.

    Not ``nullif``, which the planner turns into a projection of its own: a list of checks would copy the row for each.
    """
    return F.when(value != "", value)


def first_present(*values: Column) -> Column:
    return F.coalesce(*[present(v) for v in values])


def utc_timestamp(text: Column) -> Column:
    """ISO timestamp whose zone is ``Z`` or a zero offset; anything else is NULL."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]00:?00)$"
    # Text of this shape ends in a zero offset that casts as it stands, but for its form without a colon.
    trimmed = F.trim(text)
    zone = F.when(trimmed.endswith("0000"), F.concat(F.substring(trimmed, F.lit(1), F.length(trimmed) - 5), F.lit("Z"))).otherwise(trimmed)
    exact = F.when(trimmed.endswith("Z"), trimmed).when(trimmed.endswith("00:00"), trimmed).otherwise(zone)
    return F.when(trimmed.rlike(shape), exact.try_cast("timestamp"))


def endpoint_timestamp(text: Column) -> Column:
    """Server time as ISO, or ``date time[.1-9 digits] +0000 UTC[ m=...]`` cut to microseconds."""
    trimmed = F.trim(text)
    shape = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))? \+0000 UTC(?: m=[+-]\d+(?:\.\d+)?)?$"
    micros = F.substring(F.rpad(F.regexp_extract(trimmed, shape, 2), 6, "0"), 1, 6)
    other = F.concat(F.regexp_extract(trimmed, shape, 1), F.lit("."), micros, F.lit("Z")).try_cast("timestamp")
    return F.coalesce(utc_timestamp(trimmed), F.when(trimmed.rlike(shape), other))


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1000000).cast("bigint"))


def utc_text(ts: Column) -> Column:
    """Timestamp as ISO text in UTC with microseconds, from its digits: a pattern costs five times as much a row."""
    day = F.lit(86_400_000_000)
    micros = F.unix_micros(ts)
    rest = F.pmod(micros, day)
    date = F.date_from_unix_date(F.floor((micros - rest) / day).cast("int")).cast("string")
    # One number with a leading 1 and a digit pair for each of hour, minute and second, then the fraction.
    whole = F.floor(rest / 1000000).cast("bigint")
    clock = (F.floor(whole / 3600) * 10000 + F.floor(whole % 3600 / 60) * 100 + whole % 60 + 1000000).cast("bigint").cast("string")
    part = lambda start: F.substring(clock, start, 2)
    fraction = F.substring((rest % 1000000 + 1000000).cast("string"), 2, 6)
    return F.concat(date, F.lit("T"), part(2), F.lit(":"), part(4), F.lit(":"), part(6), F.lit("."), fraction, F.lit("Z"))


def lenient_integer(value: Column, *, allow_decimal: bool = True) -> Column:
    """Integer text with an optional ``0x``/``0o``/``0b`` base prefix; with ``allow_decimal`` also ``1.0``."""
    text = F.lower(F.trim(value.cast("string")))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(text, r"^[+-]?(?:0[xob])?", "")
    based = lambda prefix, shape, base: F.when(
        text.rlike(rf"^[+-]?{prefix}{shape}+$"), sign * F.conv(digits, base, 10).try_cast("bigint")
    )
    plain = F.when(text.rlike(r"^[+-]?(?:0+|[1-9]\d*)$"), text.try_cast("bigint"))
    out = [plain, based("0x", "[0-9a-f]", 16), based("0o", "[0-7]", 8), based("0b", "[01]", 2)]
    if allow_decimal:
        out.append(text.try_cast("double").try_cast("bigint"))
    return F.coalesce(*out)


def lenient_number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("1", "true", "yes"), F.lit(False))


def quic_initial(explicit: Column, packet_type: Column, *, either: bool = False) -> Column:
    """QUIC Initial: the explicit boolean decides, else long-header type 0; with ``either`` any of the two suffices."""
    by_type = F.coalesce(packet_type.cast("string") == "0", F.lit(False))
    if either:
        return flag(explicit) | by_type
    text = F.lower(explicit.cast("string"))
    return F.when(text.isin("true", "false"), text == "true").otherwise(by_type)


def transport_of(protocol: Column, *, exact: bool = False) -> Column:
    """``udp`` for HTTP/3 (prefix match, or exactly ``HTTP/3.0``), else ``tcp``."""
    quic = (protocol == "HTTP/3.0") if exact else protocol.startswith("HTTP/3")
    return F.when(quic, "udp").otherwise("tcp")


def flow_key(transport: Column, src: Column, sport: Column, dst: Column) -> Column:
    return F.concat_ws("|", transport, src, sport.cast("string"), dst, F.lit("443"))


def host_without_port(host: Column) -> Column:
    return F.split_part(host, F.lit(":"), F.lit(1))


def setup_packet(*, server_side: bool = False) -> Column:
    """A connection start: SYN without ACK, or a QUIC Initial (server side: with a DCID)."""
    syn = (F.col("transport") == "tcp") & F.col("tcp_syn") & ~F.col("tcp_ack")
    initial = (F.col("transport") == "udp") & F.col("quic_initial")
    if server_side:
        initial = initial & present(F.col("quic_dcid")).isNotNull()
    return F.coalesce(syn | initial, F.lit(False))


def contact_packet() -> Column:
    """TCP with SYN or payload, or a UDP datagram longer than its header."""
    tcp = (F.col("transport") == "tcp") & (F.col("tcp_syn") | (F.col("tcp_len") > 0))
    return F.coalesce(tcp | ((F.col("transport") == "udp") & (F.col("udp_length") > 8)), F.lit(False))


def single_packet_counter(text: Column) -> Column:
    """The one ``packets`` counter of a rule listing or nested JSON; NULL when absent or contradictory."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?i)\b(?:packets?|packet_count|packets_total)"?\s*[:=]\s*"?(\d+)'), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).try_cast("bigint"))


def structured_present(value: Column) -> Column:
    """True for JSON text of a non-empty object or list."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s", "")
    return text.rlike(r"^[\[{].+[\]}]$")


def messages(*checks: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the order given; no message is empty text.

    Built without a lambda: functions with one are interpreted for every element.
    """
    lit = lambda m: F.coalesce(m, F.lit("")) if isinstance(m, Column) else F.lit(m)
    return F.array_remove(F.array(*[F.when(F.coalesce(c, F.lit(False)), lit(m)).otherwise("") for c, m in checks]), "")


def any_of(*checks: tuple[Column, str | Column]) -> Column:
    """Whether :func:`messages` of these checks would hold any, without building the array."""
    out = F.lit(False)
    for condition, _ in checks:
        out = out | F.coalesce(condition, F.lit(False))
    return out
