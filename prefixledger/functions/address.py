"""Column functions for IP prefixes.

A prefix is four plain columns: ``family`` (4 or 6), ``plen``, and ``hi``/``lo``,
the two 64-bit halves of the network address. Both families are left-aligned in
the same 128-bit space (an IPv4 address fills the top 32 bits), so masking,
containment and adjacency need one expression for both. Each half is stored
offset by -2^63: signed BIGINT comparison then is unsigned address order, and
adding past the end of the space gives NULL instead of wrapping round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = ("family", "plen", "hi", "lo")
ZERO_HALF = -(1 << 63)  # a half whose 64 bits are all 0, in the offset form
ONES_HALF = (1 << 63) - 1  # a half whose 64 bits are all 1

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
_V4_ADDRESS = rf"^{_V4}$"


def _shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _shru(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def _v4_int_sql(text: str) -> str:
    parts = [f"try_cast(split_part({text}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
    return f"CASE WHEN {text} RLIKE '{_V4_ADDRESS}' THEN {' + '.join(parts)} END"


def v4_int(text: Column) -> Column:
    """Dotted IPv4 text as a BIGINT in 0..2^32-1; NULL unless it is well formed."""
    part = lambda i: F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint")
    value = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(text.rlike(_V4_ADDRESS), value)


def v4_text(value: Column) -> Column:
    """BIGINT in 0..2^32-1 as dotted text."""
    octet = lambda s: F.shiftright(value, s).bitwiseAND(255)
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def v4_half(value: Column) -> Column:
    """The ``hi`` half of an IPv4 integer."""
    return F.shiftleft(value.cast("bigint") - (1 << 31), 32)


def v4_from_half(hi: Column) -> Column:
    """The IPv4 integer held in a ``hi`` half."""
    return F.shiftright(hi, 32) + (1 << 31)


def _half_from_groups_sql(groups: str, first: int) -> str:
    g = [f"get({groups}, {first + i})" for i in range(4)]
    return f"shiftleft({g[0]} - 32768, 48) | shiftleft({g[1]}, 32) | shiftleft({g[2]}, 16) | {g[3]}"


def _with_v6_groups(df: DataFrame, address: str) -> DataFrame:
    """Add ``_v6``: eight 16-bit groups as ARRAY<BIGINT>, NULL for malformed IPv6 text.

    One select per step, so each intermediate value is computed once.
    """
    base = [f"`{c}`" for c in df.columns]
    tail4 = f"regexp_extract({address}, ':({_V4})$', 1)"
    df = df.selectExpr(
        *base,
        f"CASE WHEN contains({address}, ':') THEN lower({address}) END AS _t",
        f"CASE WHEN contains({address}, ':') AND contains({address}, '.') THEN {tail4} END AS _tail4",
    )
    df = df.selectExpr(*base, "_t", f"{_v4_int_sql('_tail4')} AS _quad")
    # An embedded dotted quad stands for the last two groups.
    df = df.selectExpr(
        *base,
        """split(CASE WHEN _quad IS NOT NULL
             THEN concat(regexp_replace(_t, '[0-9.]+$', ''), lower(hex(shiftright(_quad, 16))), ':', lower(hex(_quad & 65535)))
             ELSE _t END, '::', -1) AS _pieces""",
    )
    side = lambda i: f"CASE WHEN coalesce(get(_pieces, {i}), '') = '' THEN cast(array() AS ARRAY<STRING>) ELSE split(get(_pieces, {i}), ':', -1) END"
    df = df.selectExpr(*base, "size(_pieces) AS _n", f"{side(0)} AS _head", f"{side(1)} AS _tail")
    df = df.selectExpr(
        *base,
        """CASE WHEN (_n = 2 AND size(_head) + size(_tail) <= 7) OR (_n = 1 AND size(_head) + size(_tail) = 8)
             THEN concat(_head, array_repeat('0', 8 - size(_head) - size(_tail)), _tail) END AS _groups""",
    )
    return df.selectExpr(
        *base,
        """CASE WHEN forall(_groups, g -> g RLIKE '^[0-9a-f]{1,4}$')
             THEN transform(_groups, g -> cast(conv(g, 16, 10) AS BIGINT)) END AS _v6""",
    )


# The functions below take column names or SQL fragments: one parsed expression each
# instead of dozens of Column calls, which is most of the time of building a plan.
_ZERO = "shiftleft(1L, 63)"


def _mask_hi_sql(hi: str, plen: str) -> str:
    return f"CASE WHEN {plen} >= 64 THEN {hi} WHEN {plen} <= 0 THEN {_ZERO} ELSE {hi} & shiftleft(-1L, 64 - {plen}) END"


def _mask_lo_sql(lo: str, plen: str) -> str:
    return f"CASE WHEN {plen} >= 128 THEN {lo} WHEN {plen} <= 64 THEN {_ZERO} ELSE {lo} & shiftleft(-1L, 128 - {plen}) END"


def mask_half_hi(hi: str, plen: str) -> Column:
    return F.expr(_mask_hi_sql(hi, plen))


def mask_half_lo(lo: str, plen: str) -> Column:
    return F.expr(_mask_lo_sql(lo, plen))


def next_start(hi: Column, lo: Column, plen: Column) -> Column:
    """STRUCT<hi, lo> right after a prefix; NULL fields at the end of the space."""
    step_hi = _shl(F.lit(1).cast("bigint"), F.lit(64) - plen)
    step_lo = _shl(F.lit(1).cast("bigint"), F.lit(128) - plen)
    # /1 and /65 steps are 2^63: outside BIGINT, but the sum is a sign flip.
    moved = lambda half, step, top: F.when(
        top, F.when(half == ZERO_HALF, F.lit(0).cast("bigint"))
    ).otherwise(F.try_add(half, step))
    lo_next = moved(lo, step_lo, plen == 65)
    carry = lo_next.isNull()
    return F.struct(
        F.when(plen <= 0, F.lit(None).cast("bigint"))
        .when(plen <= 64, moved(hi, step_hi, plen == 1))
        .when(carry, F.try_add(hi, F.lit(1)))
        .otherwise(hi)
        .alias("hi"),
        F.when(plen <= 64, F.lit(ZERO_HALF)).when(carry, F.lit(ZERO_HALF)).otherwise(lo_next).alias("lo"),
    )


def node_bit(hi: Column, lo: Column, plen: Column) -> Column:
    """The bit number ``plen`` (1 = topmost): 0 for a left child, 1 for a right child."""
    unshifted_hi = hi.bitwiseXOR(F.lit(ZERO_HALF))
    unshifted_lo = lo.bitwiseXOR(F.lit(ZERO_HALF))
    return (
        F.when(plen <= 64, _shru(unshifted_hi, F.lit(64) - plen))
        .otherwise(_shru(unshifted_lo, F.lit(128) - plen))
        .bitwiseAND(1)
        .cast("int")
    )


def flip_bit(hi: Column, lo: Column, plen: Column) -> tuple[Column, Column]:
    """Halves with bit number ``plen`` inverted: the other child of the parent node."""
    one = F.lit(1).cast("bigint")
    return (
        F.when(plen <= 64, hi.bitwiseXOR(_shl(one, F.lit(64) - plen))).otherwise(hi),
        F.when(plen > 64, lo.bitwiseXOR(_shl(one, F.lit(128) - plen))).otherwise(lo),
    )


def _v6_text_sql(hi: str, lo: str) -> str:
    groups = [f"lower(hex(shiftrightunsigned({half} ^ {_ZERO}, {shift}) & 65535))" for half in (hi, lo) for shift in (48, 32, 16, 0)]
    padded = f"concat(':', concat_ws(':', {', '.join(groups)}), ':')"
    cases = []
    for run in range(8, 1, -1):
        zeros = ":" + "0:" * run
        head = f"substring_index(p, '{zeros}', 1)"
        after_at = f"(length({head}) + {len(zeros) + 1})"
        tail = f"substring(p, {after_at}, greatest(length(p) - {after_at}, 0))"
        cases.append(f"WHEN contains(p, '{zeros}') THEN concat(substring({head}, 2, 40), '::', {tail})")
    # The lambda binds the eight groups once; spelled out at every use they outgrow a generated method.
    shortest = f"get(transform(array({padded}), p -> CASE {' '.join(cases)} ELSE substring(p, 2, length(p) - 2) END), 0)"
    mapped = f"{hi} = {_ZERO} AND shiftright({lo} ^ {_ZERO}, 32) = 65535"
    dotted = f"concat('::ffff:', {_v4_text_sql(f'(({lo} ^ {_ZERO}) & 4294967295L)')})"
    return f"CASE WHEN {mapped} THEN {dotted} ELSE {shortest} END"


def _v4_text_sql(value: str) -> str:
    return f"concat_ws('.', {', '.join(f'shiftright({value}, {s}) & 255' for s in (24, 16, 8, 0))})"


def v6_text(hi: str, lo: str) -> Column:
    """Shortest IPv6 text: lower case, the first longest run of two or more zero groups as ``::``."""
    return F.expr(_v6_text_sql(hi, lo))


def address_text(family: str = "family", hi: str = "hi", lo: str = "lo") -> Column:
    v4 = f"(shiftright({hi}, 32) + 2147483648L)"
    return F.expr(f"CASE WHEN {family} = 4 THEN {_v4_text_sql(v4)} ELSE {_v6_text_sql(hi, lo)} END")


def cidr_text(family: str = "family", plen: str = "plen", hi: str = "hi", lo: str = "lo") -> Column:
    """Canonical CIDR text of a prefix."""
    return F.concat(address_text(family, hi, lo), F.lit("/"), F.expr(f"cast({plen} AS STRING)"))


def with_prefix(df: DataFrame, cidr: str, *, strict: bool = False) -> DataFrame:
    """Add ``family, plen, hi, lo`` parsed from the text column ``cidr``.

    All four are NULL for malformed text. Host bits are masked, or with
    ``strict`` make the text malformed. A bare address is a full-length prefix;
    an IPv4 length may also be a net mask or a host mask.
    """
    keep = [f"`{c}`" for c in df.columns if c not in PREFIX]
    text = f"trim(`{cidr}`)"
    staged = df.selectExpr(
        *keep,
        f"split_part({text}, '/', 1) AS _addr",
        f"CASE WHEN contains({text}, '/') THEN substring_index({text}, '/', -1) END AS _len",
        f"size(split({text}, '/', -1)) <= 2 AS _shape",
    )
    staged = _with_v6_groups(staged, "_addr").selectExpr(
        "*", f"{_v4_int_sql('_addr')} AS _v4", f"CASE WHEN contains(_len, '.') THEN {_v4_int_sql('_len')} END AS _mask"
    )
    netmask = lambda m: f"{m} = 4294967295L & shiftleft(4294967295L, 32 - cast(bit_count({m}) AS INT))"
    digits = "WHEN _len RLIKE '^[0-9]+$' THEN try_cast(_len AS INT)"
    v4_len = f"""CASE WHEN _len IS NULL THEN 32 {digits} WHEN {netmask('_mask')} THEN cast(bit_count(_mask) AS INT)
        WHEN {netmask('(4294967295L - _mask)')} THEN cast(bit_count(4294967295L - _mask) AS INT) END"""
    v6_len = f"CASE WHEN _len IS NULL THEN 128 {digits} END"
    staged = staged.selectExpr(
        *keep,
        "_shape",
        "CASE WHEN _v4 IS NOT NULL THEN 4 WHEN _v6 IS NOT NULL THEN 6 END AS _family",
        f"CASE WHEN _v4 IS NOT NULL THEN {v4_len} WHEN _v6 IS NOT NULL THEN {v6_len} END AS _plen",
        f"CASE WHEN _v4 IS NOT NULL THEN shiftleft(_v4 - 2147483648L, 32) ELSE {_half_from_groups_sql('_v6', 0)} END AS _hi",
        f"CASE WHEN _v4 IS NOT NULL THEN {_ZERO} ELSE {_half_from_groups_sql('_v6', 4)} END AS _lo",
    )
    good = "_shape AND _family IS NOT NULL AND _plen <= CASE _family WHEN 4 THEN 32 ELSE 128 END"
    if strict:
        good += f" AND {_mask_hi_sql('_hi', '_plen')} = _hi AND {_mask_lo_sql('_lo', '_plen')} = _lo"
    values = {"family": "_family", "plen": "_plen", "hi": _mask_hi_sql("_hi", "_plen"), "lo": _mask_lo_sql("_lo", "_plen")}
    fields = ", ".join(f"'{name}', CASE WHEN {good} THEN {value} END" for name, value in values.items())
    # A one-row generator: a filter or join key on the parsed columns stays above it
    # instead of being pushed down as a copy of the whole parsing expression.
    return staged.selectExpr(*keep, f"inline(array(named_struct({fields})))")


def with_address(df: DataFrame, text: str, *, family: int | None = None) -> DataFrame:
    """Like :func:`with_prefix` for a bare address: text with a length is malformed."""
    parsed = with_prefix(df.withColumn("_address_text", F.trim(F.col(text))), "_address_text")
    good = ~F.col("_address_text").contains("/")
    if family is not None:
        good = good & (F.col("family") == family)
    keep = [c for c in df.columns if c not in PREFIX]
    return parsed.select(*keep, *[F.when(good, F.col(c)).alias(c) for c in PREFIX])


def canonical_v4(text: Column) -> Column:
    """The dotted text when it is a well-formed IPv4 address, else NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_V4_ADDRESS), trimmed)


def is_canonical(original: Column, canonical: Column) -> Column:
    return F.trim(original) == canonical


def _power_of_two(exponent: Column) -> Column:
    """2^exponent as DECIMAL(38,0). Above 2^126, the last that fits, it raises: a NULL would drop out of sums in silence."""
    # Two 62-bit factors and one of at most 2 bits: exact in DECIMAL, no lookup table.
    part = lambda low, width: _shl(F.lit(1).cast("bigint"), F.least(F.greatest(exponent - low, F.lit(0)), F.lit(width))).cast("decimal(19,0)")
    value = (part(0, 62) * part(62, 62)).cast("decimal(38,0)") * part(124, 2).cast("decimal(1,0)")
    too_large = F.raise_error(F.lit("an IPv6 prefix shorter than /2 has more addresses than a decimal holds")).cast("decimal(38,0)")
    return F.when(exponent.between(0, 126), value.cast("decimal(38,0)")).when(exponent > 126, too_large)


def v4_count(plen: Column) -> Column:
    """Addresses of an IPv4 prefix."""
    return _shl(F.lit(1).cast("bigint"), F.lit(32) - plen)


def address_count(family: Column, plen: Column) -> Column:
    """Addresses of a prefix of either family as DECIMAL(38,0)."""
    return F.when(family == 4, v4_count(plen).cast("decimal(38,0)")).otherwise(
        _power_of_two(F.lit(128) - plen)
    )


def v6_blocks(plen: Column) -> Column:
    """/64 blocks of an IPv6 prefix as DECIMAL(38,0); NULL for a prefix longer than /64."""
    return F.when(plen <= 64, _power_of_two(F.lit(64) - plen))


def v6_blocks_lenient(plen: Column) -> Column:
    """/64 blocks, at least one for a prefix longer than /64."""
    return F.when(plen <= 64, _power_of_two(F.lit(64) - plen)).otherwise(F.lit(1).cast("decimal(38,0)"))


def bit_length(value: Column) -> Column:
    """Number of bits of a non-negative BIGINT (0 for 0)."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def range_block_count(start: Column, stop: Column) -> Column:
    """CIDR blocks that cover the half-open BIGINT range [start, stop) minimally.

    Split at the multiple of 2^p where p is the highest bit in which the two
    ends differ: every set bit of either part is one block.
    """
    high = bit_length(start.bitwiseXOR(stop)) - 1
    middle = _shl(_shru(stop, high), high)
    tail = stop.bitwiseAND(_shl(F.lit(1).cast("bigint"), high) - 1)
    count = F.bit_count(middle - start) + F.bit_count(tail)
    return F.when(stop > start, count).otherwise(0).cast("bigint")


def last_address(hi: Column, lo: Column, plen: Column) -> tuple[Column, Column]:
    """Halves of the last address of a prefix of the common 128-bit space."""
    ones = F.lit(-1).cast("bigint")
    tail_hi = F.when(plen >= 64, 0).when(plen > 0, _shru(ones, plen)).otherwise(ones)
    tail_lo = F.when(plen >= 128, 0).when(plen > 64, _shru(ones, plen - 64)).otherwise(ones)
    sign = F.lit(ZERO_HALF)
    fill = lambda half, tail: half.bitwiseXOR(sign).bitwiseOR(tail.cast("bigint")).bitwiseXOR(sign)
    return fill(hi, tail_hi), fill(lo, tail_lo)


def next_address(hi: Column, lo: Column) -> tuple[Column, Column, Column]:
    """``(past_end, hi, lo)`` of the address after the given one; past the last address the halves stay as they are."""
    top = F.lit(-(ZERO_HALF + 1))
    carry, end = lo == top, (lo == top) & (hi == top)
    next_hi = F.when(carry & ~end, hi + 1).otherwise(hi)
    next_lo = F.when(end, lo).when(carry, F.lit(ZERO_HALF)).otherwise(lo + 1)
    return end, next_hi, next_lo


def _low_ones(bits: Column) -> Column:
    """A BIGINT whose lowest 0 to 64 bits are set."""
    return F.when(bits >= 64, F.lit(-1).cast("bigint")).otherwise(F.bitwise_not(_shl(F.lit(-1).cast("bigint"), bits)))


def _trailing_zeros(hi: Column, lo: Column, width: Column) -> Column:
    """Zero bits below the lowest set bit of a 128-bit value; ``width`` when no bit is set."""
    lowest = lambda v: F.when(v == ZERO_HALF, 63).otherwise(F.bit_count(F.bitwise_not(v).bitwiseAND(v - 1)))
    return F.when(lo != 0, lowest(lo)).when(hi != 0, lowest(hi) + 64).otherwise(width)


def with_cover_blocks(df: DataFrame, start: str, last: str, name: str) -> DataFrame:
    """``df`` with the number of CIDR blocks that cover the 128-bit addresses from ``start`` to ``last`` minimally.

    Both columns are ``STRUCT<hi, lo>``; the count is NULL when either is. The range is split below its highest
    differing bit p: the left part ends there and the right part begins there, so each is a sum of distinct powers
    of two; two full parts are one block. Each step is a projection of its own, so no step is computed twice.
    """
    raw = lambda field: F.col(field).bitwiseXOR(F.lit(ZERO_HALF))
    c = F.col
    differ_hi, differ_lo = c(f"{start}.hi").bitwiseXOR(c(f"{last}.hi")), c(f"{start}.lo").bitwiseXOR(c(f"{last}.lo"))
    bits = df.select("*", differ_hi.alias("_dh"), differ_lo.alias("_dl")).select(
        *df.columns, F.when(c("_dh") != 0, bit_length(c("_dh")) + 63).otherwise(bit_length(c("_dl")) - 1).alias("_p"))
    masks = bits.select("*", _low_ones(F.greatest(c("_p") - 64, F.lit(0))).alias("_mh"), _low_ones(F.greatest(c("_p"), F.lit(0))).alias("_ml"))
    parts = masks.select(
        *df.columns, "_p",
        raw(f"{start}.hi").bitwiseAND(c("_mh")).alias("_lh"), raw(f"{start}.lo").bitwiseAND(c("_ml")).alias("_ll"),
        F.bitwise_not(raw(f"{last}.hi")).bitwiseAND(c("_mh")).alias("_gh"), F.bitwise_not(raw(f"{last}.lo")).bitwiseAND(c("_ml")).alias("_gl"),
    )
    whole = (c("_lh") == 0) & (c("_ll") == 0) & (c("_gh") == 0) & (c("_gl") == 0)
    # The bits of the right part are p less those it lacks.
    part = lambda hi, lo: c("_p") + 1 - F.bit_count(hi) - F.bit_count(lo) - _trailing_zeros(hi, lo, c("_p"))
    count = F.when((c("_p") < 0) | whole, 1).otherwise(part(c("_lh"), c("_ll")) + part(c("_gh"), c("_gl"))).cast("bigint")
    return parts.select(*df.columns, F.when(c("_p").isNotNull(), count).alias(name))


# Special-purpose ranges that are not globally reachable, and the
# narrower ranges inside them that are (IANA special-purpose address registry).
NOT_GLOBAL_V4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
]
GLOBAL_INSIDE_V4 = ["192.0.0.9/32", "192.0.0.10/32"]


def is_global_v4(start: Column, plen: Column) -> Column:
    """True when an IPv4 prefix lies outside every range in ``NOT_GLOBAL_V4``.

    A dozen fixed ranges are a filter, not a join: two comparisons each.
    """
    last = start + v4_count(plen) - 1

    def inside(cidr: str) -> Column:
        address, length = cidr.split("/")
        o = [int(x) for x in address.split(".")]
        base = (o[0] << 24) | (o[1] << 16) | (o[2] << 8) | o[3]
        return (start >= base) & (last < base + (1 << (32 - int(length))))

    blocked = F.lit(False)
    for cidr in NOT_GLOBAL_V4:
        blocked = blocked | inside(cidr)
    allowed = F.lit(False)
    for cidr in GLOBAL_INSIDE_V4:
        allowed = allowed | inside(cidr)
    return ~blocked | allowed
