"""DuckDB statements that compute the registered queries another way.

The overlay is written with segment edges and range joins, block counts with a sum
over bit positions, route lookup with plain range comparisons: nothing is shared
with the Spark operators but the projections of the test tables.
"""

from __future__ import annotations

from prefixledger.plans import derived as D

_VARIANTS = ", ".join(f"({d}, {c}, {o}, {n}, '{s}')" for d, c, o, n, s in D.variants())
_DAYS = ", ".join(f"({i}, DATE '{d}')" for i, d in enumerate(D.DAYS))
_SIZE = "CASE family WHEN 4 THEN 1::HUGEINT ELSE 18446744073709551616::HUGEINT END"


def _blocks(s: str, e: str) -> str:
    """Blocks of a minimal CIDR cover of [s, e): units minus aligned pairs at every level."""
    return (
        f"(({e}) - ({s}) - list_sum(list_transform(range(1, 34), lambda k: greatest(0, (({e}) >> k) - ((({s}) + (1::BIGINT << k) - 1) >> k))))::BIGINT)"
    )


def _cidr(family: str, s: str, plen: str) -> str:
    return f"""CASE {family} WHEN 4 THEN
  (({s}) >> 24)::VARCHAR || '.' || ((({s}) >> 16) & 255)::VARCHAR || '.' || ((({s}) >> 8) & 255)::VARCHAR || '.' || (({s}) & 255)::VARCHAR || '/' || ({plen})::VARCHAR
 ELSE '2001:db8' || CASE WHEN ({s}) & 4294967295 = 0 THEN '' WHEN ({s}) & 65535 = 0 THEN ':' || lower(to_hex((({s}) >> 16) & 65535))
  ELSE ':' || lower(to_hex((({s}) >> 16) & 65535)) || ':' || lower(to_hex(({s}) & 65535)) END || '::/' || ({plen})::VARCHAR END"""


def _v4(b: str, offset: str) -> str:
    return f"CASE WHEN {b} < {D.WIDE_SLOTS} THEN {D.V4_BASE} + {b} * 2048 + {offset} ELSE {D.NARROW_BASE} + ({b} - {D.WIDE_SLOTS}) * 8 + {offset} // 256 END"


def _v4_len(b: str, length: str) -> str:
    return f"({length} + CASE WHEN {b} < {D.WIDE_SLOTS} THEN 0 ELSE 8 END)"


# IPv4 positions are addresses, IPv6 positions are /64 blocks.
CATALOGUE = f"""
people AS (
  SELECT c_custkey AS b, CASE WHEN c_custkey % 97 = 0 THEN '' ELSE substr(r_name, 1, 2) END AS country,
         n_name AS region, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
families(family) AS (VALUES (4), (6)),
shape(day, kase, off, len, suffix) AS (VALUES {_VARIANTS}),
days(day, snapshot_date) AS (VALUES {_DAYS}),
cat AS (
  SELECT snapshot_date, day, family, b, country, region, segment || suffix AS city,
         CASE family WHEN 4 THEN {_v4_len('b', 'len')} ELSE len + 40 END AS plen,
         CASE family WHEN 4 THEN {_v4('b', 'off')} ELSE {D.V6_BASE} + b * 8 + off // 256 END AS s,
         CASE family WHEN 4 THEN 1::BIGINT << (32 - {_v4_len('b', 'len')}) ELSE 1::BIGINT << (24 - len) END AS n
  FROM people JOIN shape ON b % 10 = kase JOIN days USING (day) CROSS JOIN families
  WHERE family = 6 OR b < {D.V4_SLOTS})"""

LENIENT = f"""{CATALOGUE},
raw AS (
  SELECT b, family, country, region, segment AS city, x.off AS off, x.len AS len
  FROM people CROSS JOIN families,
       (SELECT 0 AS off, 22 AS len, 1 AS m, 0 AS r UNION ALL SELECT 0, 22, 40, 39 UNION ALL SELECT 256, 24, 30, 29) x
  WHERE b % x.m = x.r AND (family = 6 OR b < {D.V4_SLOTS})),
len AS (
  SELECT b, family, country, region, city, b % 50 = 49 AS bad,
         CASE family WHEN 4 THEN {_v4_len('b', 'len')} ELSE len + 40 END AS plen,
         CASE family WHEN 4 THEN {_v4('b', 'off')} ELSE {D.V6_BASE} + b * 8 + off // 256 END AS s,
         CASE family WHEN 4 THEN 1::BIGINT << (32 - {_v4_len('b', 'len')}) ELSE 1::BIGINT << (24 - len) END AS n
  FROM raw)"""

OVERLAY = f"""{CATALOGUE},
pairs AS (SELECT day AS d, lag(snapshot_date) OVER (ORDER BY day) AS date_from, snapshot_date AS date_to FROM days),
sides AS (
  SELECT date_from, date_to, family, s, n, plen, country, region, city, 0 AS new FROM cat JOIN pairs ON snapshot_date = date_from
  UNION ALL
  SELECT date_from, date_to, family, s, n, plen, country, region, city, 1 FROM cat JOIN pairs ON snapshot_date = date_to WHERE date_from IS NOT NULL),
edges AS (
  SELECT date_from, date_to, family, s AS p FROM sides UNION SELECT date_from, date_to, family, s + n FROM sides),
segs AS (
  SELECT *, lead(p) OVER (PARTITION BY date_from, family ORDER BY p) AS q FROM edges),
held AS (
  SELECT g.date_from, g.date_to, g.family, g.p, g.q,
         max(CASE WHEN new = 0 THEN [country, region, city] END) AS old, max(CASE WHEN new = 1 THEN [country, region, city] END) AS fresh
  FROM segs g JOIN sides t ON t.date_from = g.date_from AND t.family = g.family AND t.s <= g.p AND g.p < t.s + t.n
  WHERE g.q IS NOT NULL GROUP BY ALL),
pieces AS (
  SELECT *, q - p AS n, {_blocks('p', 'q')} AS blocks,
         CASE WHEN old IS NULL THEN 'added' WHEN fresh IS NULL THEN 'removed' ELSE 'reassigned' END AS change
  FROM held WHERE old IS DISTINCT FROM fresh),
moved AS (
  SELECT *, CASE WHEN lag(q) OVER w = p AND lag(old) OVER w = old AND lag(fresh) OVER w = fresh THEN 0 ELSE 1 END AS starts
  FROM pieces WHERE change = 'reassigned' WINDOW w AS (PARTITION BY date_from, family ORDER BY p)),
lone AS (
  SELECT date_from, date_to, family, s, n, min(new) AS new FROM sides GROUP BY ALL HAVING count(*) = 1),
cosmetic AS (
  SELECT date_from, family, sum(1 + k) AS fake FROM (
    SELECT o.date_from, o.family, o.s, count(*) AS k, sum(i.n) AS covered, any_value(o.n) AS n
    FROM lone o JOIN lone i ON i.date_from = o.date_from AND i.family = o.family AND i.new <> o.new
      AND i.s >= o.s AND i.s + i.n <= o.s + o.n
    GROUP BY o.date_from, o.family, o.s, o.new) WHERE covered = n GROUP BY ALL),
series AS (
  SELECT p.date_from, p.date_to, p.date_to - p.date_from AS interval_days, f.family,
    (SELECT coalesce(sum(blocks), 0) FROM pieces x WHERE x.date_from = p.date_from AND x.family = f.family AND change = 'added')::BIGINT AS added_pfx,
    (SELECT coalesce(sum(blocks), 0) FROM pieces x WHERE x.date_from = p.date_from AND x.family = f.family AND change = 'removed')::BIGINT AS removed_pfx,
    (SELECT coalesce(sum(n), 0) FROM pieces x WHERE x.date_from = p.date_from AND x.family = f.family AND change = 'added') * {_SIZE.replace('family', 'f.family')} AS added_addrs,
    (SELECT coalesce(sum(n), 0) FROM pieces x WHERE x.date_from = p.date_from AND x.family = f.family AND change = 'removed') * {_SIZE.replace('family', 'f.family')} AS removed_addrs,
    (SELECT coalesce(sum(n), 0) FROM moved x WHERE x.date_from = p.date_from AND x.family = f.family) * {_SIZE.replace('family', 'f.family')} AS reassigned_addrs,
    (SELECT coalesce(sum(starts), 0) FROM moved x WHERE x.date_from = p.date_from AND x.family = f.family)::BIGINT AS reassign_count,
    coalesce((SELECT fake FROM cosmetic x WHERE x.date_from = p.date_from AND x.family = f.family), 0)::BIGINT AS fake_churn_pfx,
    (SELECT count(*) FROM lone x WHERE x.date_from = p.date_from AND x.family = f.family) AS naive_raw_churn
  FROM pairs p CROSS JOIN families f WHERE p.date_from IS NOT NULL)"""

ROUTES = f"""
routed AS (
  SELECT DISTINCT family, {D.FIRST_ASN} + (b // 32) % (SELECT count(*) FROM supplier) AS asn,
    CASE family WHEN 4 THEN {_v4_len('b', '16')} ELSE 56 END AS plen,
    CASE family WHEN 4 THEN {_v4('(b // 32 * 32)', '0')} ELSE {D.V6_BASE} + (b // 32) * 256 END AS s,
    CASE family WHEN 4 THEN 1::BIGINT << (32 - {_v4_len('b', '16')}) ELSE 256 END AS n
  FROM people CROSS JOIN families WHERE (b // 32) % 11 <> 10 AND (family = 6 OR b < {D.V4_SLOTS})
  UNION ALL
  SELECT family, {D.FIRST_ASN} + b % (SELECT count(*) FROM supplier), CASE family WHEN 4 THEN {_v4_len('b', '23')} ELSE 63 END,
    CASE family WHEN 4 THEN {_v4('b', '0')} ELSE {D.V6_BASE} + b * 8 END, CASE family WHEN 4 THEN 1::BIGINT << (32 - {_v4_len('b', '23')}) ELSE 2 END
  FROM people CROSS JOIN families WHERE b % 64 = 7 AND (family = 6 OR b < {D.V4_SLOTS})),
names AS (
  SELECT {D.FIRST_ASN} + s_suppkey AS asn,
    CASE s_suppkey % 4 WHEN 0 THEN 'Akamai International' WHEN 1 THEN 'Cloudflare, Inc.' WHEN 2 THEN 'Fastly' ELSE s_name END AS org,
    CASE s_suppkey % 4 WHEN 0 THEN 'Akamai' WHEN 1 THEN 'Cloudflare' WHEN 2 THEN 'Fastly' ELSE s_name END AS operator,
    'NET' || s_suppkey || ' - ' || CASE s_suppkey % 4 WHEN 0 THEN 'Akamai International' WHEN 1 THEN 'Cloudflare, Inc.' WHEN 2 THEN 'Fastly' ELSE s_name END || ', US' AS as_name
  FROM supplier WHERE s_suppkey % 9 <> 8)"""


def _attributed(source: str, rows: str, bad: str) -> str:
    return f"""{source}, {ROUTES},
best AS (
  SELECT p.family, p.s, p.plen, max(struct_pack(l := r.plen, a := r.asn, rs := r.s)) AS r
  FROM (SELECT DISTINCT family, s, plen FROM {rows} WHERE NOT {bad}) p
  JOIN routed r ON r.family = p.family AND r.s <= p.s AND p.s < r.s + r.n GROUP BY ALL),
att AS (
  SELECT t.*, CASE WHEN {bad} THEN NULL WHEN best.r IS NULL THEN 'unrouted' WHEN best.r.l > t.plen THEN 'containment_failure' ELSE 'matched' END AS outcome,
    CASE WHEN NOT {bad} AND best.r.l <= t.plen THEN best.r.a END AS asn,
    CASE WHEN NOT {bad} AND best.r.l <= t.plen THEN {_cidr('t.family', 'best.r.rs', 'best.r.l')} END AS route
  FROM {rows} t LEFT JOIN best ON best.family = t.family AND best.s = t.s AND best.plen = t.plen),
ops AS (
  SELECT att.*, as_name, CASE outcome WHEN 'matched' THEN coalesce(names.operator, '(unknown org)')
    WHEN 'unrouted' THEN '(unrouted)' WHEN 'containment_failure' THEN '(invalid BGP containment)' END AS operator
  FROM att LEFT JOIN names USING (asn))"""


ATT_SERIES = _attributed(CATALOGUE, "cat", "false")
ATT_LENIENT = _attributed(LENIENT, "len", "bad")

_COLLAPSE = """
isl AS (
  SELECT {keys}, family, s, s + n AS e, max(s + n) OVER (PARTITION BY {keys}, family ORDER BY s, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {rows}),
isl2 AS (SELECT *, sum(CASE WHEN seen >= s THEN 0 ELSE 1 END) OVER (PARTITION BY {keys}, family ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS g FROM isl),
runs AS (SELECT {keys}, family, g, min(s) AS s, max(e) AS e FROM isl2 GROUP BY ALL),
blocks AS (SELECT {keys}, family, sum(""" + _blocks("s", "e") + """)::BIGINT AS blocks, sum(e - s) AS units FROM runs GROUP BY ALL)"""


def _collapse(rows: str, keys: str) -> str:
    return _COLLAPSE.format(rows=rows, keys=keys)


def _fam(expr: str, family: int) -> str:
    return f"coalesce(sum(CASE WHEN family = {family} THEN {expr} END), 0)"


CATALOGUE_SQL = {
    "country_series": f"""WITH {CATALOGUE}
SELECT snapshot_date::VARCHAR AS snapshot_date, CASE country WHEN '' THEN '??' ELSE country END AS country,
  count(*) FILTER (family = 4) AS ipv4_prefixes, {_fam('n', 4)}::BIGINT AS ipv4_addresses,
  count(*) FILTER (family = 6) AS ipv6_prefixes, {_fam('n', 6)}::VARCHAR AS ipv6_64_blocks, count(*) AS total_prefixes
FROM cat GROUP BY 1, 2""",
    "snapshot_series": f"""WITH {CATALOGUE}, {_collapse('cat', 'snapshot_date')}
SELECT snapshot_date::VARCHAR AS snapshot_date, count(*) AS rows, count(*) FILTER (family = 4) AS ipv4_prefixes,
  count(*) FILTER (family = 6) AS ipv6_prefixes, {_fam('n', 4)}::BIGINT AS ipv4_addresses, {_fam('n', 6)}::VARCHAR AS ipv6_64_blocks,
  count(DISTINCT country) AS countries, count(DISTINCT [country, region, city]) AS locations,
  (SELECT any_value(blocks) FROM blocks x WHERE x.snapshot_date = cat.snapshot_date AND x.family = 4) AS collapsed_ipv4_blocks,
  (SELECT any_value(blocks) FROM blocks x WHERE x.snapshot_date = cat.snapshot_date AND x.family = 6) AS collapsed_ipv6_blocks,
  count(*) FILTER (family = 6) AS noncanonical_cidrs
FROM cat GROUP BY snapshot_date""",
    "churn_series": f"""WITH {OVERLAY}
SELECT date_from::VARCHAR AS date_from, date_to::VARCHAR AS date_to, interval_days::BIGINT AS interval_days, 'v' || family AS family, added_pfx, removed_pfx, added_addrs::VARCHAR AS added_addrs,
  removed_addrs::VARCHAR AS removed_addrs, reassigned_addrs::VARCHAR AS reassigned_addrs, reassign_count, fake_churn_pfx, naive_raw_churn FROM series""",
    "pair_summary": f"""WITH {OVERLAY}
SELECT date_from::VARCHAR AS date_from, date_to::VARCHAR AS date_to, interval_days::BIGINT AS interval_days, sum(added_pfx)::BIGINT AS added_pfx, sum(removed_pfx)::BIGINT AS removed_pfx,
  sum(reassign_count)::BIGINT AS label_change_runs, sum(fake_churn_pfx)::BIGINT AS resliced_rows, sum(reassign_count) > 0 AS review_labels
FROM series GROUP BY ALL""",
    "plot_series": f"""WITH {OVERLAY}
SELECT date_from::VARCHAR AS date_from, date_to::VARCHAR AS date_to, interval_days::BIGINT AS interval_days, 'v' || family AS family, added_pfx, -removed_pfx AS removed_pfx,
  reassign_count, interval_days > 1 AS gap FROM series""",
    "churn_transitions": f"""WITH {OVERLAY}
SELECT date_from::VARCHAR AS date_from, date_to::VARCHAR AS date_to, 'v' || family AS family, old[1] AS from_country, old[2] AS from_region, old[3] AS from_city,
  fresh[1] AS to_country, fresh[2] AS to_region, fresh[3] AS to_city, sum(starts)::BIGINT AS contiguous_runs,
  (sum(n) * any_value({_SIZE}))::VARCHAR AS addresses
FROM moved GROUP BY date_from, date_to, family, old, fresh""",
    "top_transitions": f"""WITH {OVERLAY},
t AS (SELECT date_from, family, old, fresh, sum(n) AS n FROM moved GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY date_from, family ORDER BY n DESC, old, fresh) AS rank FROM t)
SELECT date_from::VARCHAR AS date_from, 'v' || family AS family, old[3] AS from_city, fresh[3] AS to_city,
  (n * {_SIZE})::VARCHAR AS addresses, rank FROM r WHERE rank <= 10""",
    "catalogue_changes": f"""WITH {OVERLAY},
full_rows AS (
  SELECT date_from, date_to, family, s, plen, max(CASE WHEN new = 0 THEN [country, region, city] END) AS old,
         max(CASE WHEN new = 1 THEN [country, region, city] END) AS fresh FROM sides GROUP BY ALL),
ev AS (
  SELECT *, 'added' AS change_kind, fresh AS l FROM full_rows WHERE old IS NULL
  UNION ALL SELECT *, 'removed', old FROM full_rows WHERE fresh IS NULL
  UNION ALL SELECT *, 'label_before', old FROM full_rows WHERE old <> fresh
  UNION ALL SELECT *, 'label_after', fresh FROM full_rows WHERE old <> fresh)
SELECT date_from::VARCHAR AS date_from, date_to::VARCHAR AS date_to, 'v' || family AS family, change_kind, {_cidr('family', 's', 'plen')} AS cidr,
  l[1] AS country, l[2] AS region, l[3] AS city FROM ev""",
    "country_allocation": f"""WITH {LENIENT}
SELECT CASE country WHEN '' THEN '??' ELSE country END AS country, count(*) FILTER (NOT bad AND family = 4) AS ipv4_prefixes,
  coalesce(sum(n) FILTER (NOT bad AND family = 4), 0)::BIGINT AS ipv4_addresses, count(*) FILTER (NOT bad AND family = 6) AS ipv6_prefixes,
  coalesce(sum(n) FILTER (NOT bad AND family = 6), 0)::VARCHAR AS ipv6_64_blocks, count(*) FILTER (bad) AS malformed, count(*) FILTER (NOT bad) AS total_prefixes
FROM len GROUP BY 1""",
    "country_share": f"""WITH {LENIENT}, m AS (
  SELECT country, 'all' AS measure, 1 AS v FROM len WHERE NOT bad UNION ALL SELECT country, 'ipv4', 1 FROM len WHERE NOT bad AND family = 4
  UNION ALL SELECT country, 'ipv4_addresses', n FROM len WHERE NOT bad AND family = 4 UNION ALL SELECT country, 'ipv6', 1 FROM len WHERE NOT bad AND family = 6)
SELECT measure, coalesce(sum(v) FILTER (country = 'EU'), 0)::BIGINT AS selected, sum(v)::BIGINT AS whole,
  printf('%.2f', coalesce(sum(v) FILTER (country = 'EU'), 0)::DOUBLE / sum(v)::DOUBLE * 100) AS percent FROM m GROUP BY measure""",
    "top_countries": f"""WITH {LENIENT}
SELECT CASE country WHEN '' THEN '??' ELSE country END AS country, count(*) AS total_prefixes FROM len WHERE NOT bad
GROUP BY 1 ORDER BY count(*) DESC, min(b) LIMIT 3""",
    "duplicate_cidrs": f"""WITH {LENIENT}, c AS (SELECT family, s, plen, bad, count(*) AS n FROM len GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS duplicate_cidrs, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM c""",
    "malformed_rows": f"""WITH {LENIENT} SELECT count(*) FILTER (bad) AS malformed FROM len""",
    "overlap_report": f"""WITH {LENIENT}, ok AS (SELECT 1 AS k, * FROM len WHERE NOT bad), {_collapse('ok', 'k')},
naive AS (SELECT family, count(*) AS prefixes, sum(n) AS units FROM ok GROUP BY family)
SELECT family, prefixes, blocks AS collapsed, (naive.units * {_SIZE})::VARCHAR AS naive_addresses, (blocks.units * {_SIZE})::VARCHAR AS addresses,
  ((naive.units - blocks.units) * {_SIZE})::VARCHAR AS over_count, printf('%.4f', (naive.units - blocks.units)::DOUBLE / naive.units::DOUBLE * 100) AS over_percent
FROM naive JOIN blocks USING (family)""",
    "route_lookup": f"""WITH {ATT_LENIENT}
SELECT family, s - CASE family WHEN 4 THEN {D.V4_BASE} ELSE {D.V6_BASE} END AS slot_offset, plen, outcome, asn, route FROM att WHERE outcome IS NOT NULL""",
    "attribution_quality": f"""WITH {ATT_LENIENT}
SELECT count(*) AS rows, count(*) FILTER (bad) AS malformed, count(*) FILTER (outcome = 'matched') AS matched,
  count(*) FILTER (outcome = 'unrouted') AS unrouted, 0::BIGINT AS lookup_failures,
  count(*) FILTER (outcome = 'containment_failure') AS containment_failures,
  round(count(*) FILTER (outcome = 'matched') / count(outcome) * 100, 6) AS coverage_percent FROM att""",
    "operator_mix": f"""WITH {ATT_LENIENT}
SELECT operator, count(*) FILTER (family = 4) AS ipv4, count(*) FILTER (family = 6) AS ipv6, count(*) AS total,
  printf('%.6f', count(*)::DOUBLE / (SELECT count(*) FROM ops WHERE operator IS NOT NULL)::DOUBLE * 100) AS share_percent
FROM ops WHERE operator IS NOT NULL GROUP BY operator""",
    "operator_mix_collapsed": f"""WITH {ATT_LENIENT}, ok AS (SELECT operator, family, s, n FROM ops WHERE operator IS NOT NULL), {_collapse('ok', 'operator')}
SELECT operator, {_fam('blocks', 4)}::BIGINT AS ipv4, {_fam('blocks', 6)}::BIGINT AS ipv6, sum(blocks)::BIGINT AS total,
  printf('%.6f', sum(blocks)::DOUBLE / (SELECT sum(blocks) FROM blocks)::DOUBLE * 100) AS share_percent FROM blocks GROUP BY operator""",
    "operator_report": f"""WITH {ATT_LENIENT},
m AS (SELECT operator, count(*) FILTER (family = 4) AS ipv4, count(*) FILTER (family = 6) AS ipv6, count(*) AS total FROM ops WHERE operator IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY total DESC, operator) AS rn FROM m WHERE operator NOT IN ('Akamai', 'Cloudflare', 'Fastly'))
SELECT 1 AS section, k.position, k.operator, coalesce(ipv4, 0) AS ipv4, coalesce(ipv6, 0) AS ipv6, coalesce(total, 0) AS total
FROM (VALUES (0, 'Akamai'), (1, 'Cloudflare'), (2, 'Fastly')) k(position, operator) LEFT JOIN m USING (operator)
UNION ALL SELECT 2, rn - 1, operator, ipv4, ipv6, total FROM o WHERE rn <= 5
UNION ALL SELECT 3, 0, '... (' || count(*) || ' more)', sum(ipv4), sum(ipv6), sum(total) FROM o WHERE rn > 5 HAVING count(*) > 0""",
    "operator_series": f"""WITH {ATT_SERIES}, {_collapse('ops', 'snapshot_date, operator')},
tot AS (SELECT snapshot_date, count(*) AS whole FROM ops GROUP BY 1),
bl AS (SELECT snapshot_date, operator, {_fam('blocks', 4)}::BIGINT AS b4, {_fam('blocks', 6)}::BIGINT AS b6 FROM blocks GROUP BY ALL)
SELECT ops.snapshot_date::VARCHAR AS snapshot_date, ops.operator, count(*) FILTER (family = 4) AS ipv4_prefixes, count(*) FILTER (family = 6) AS ipv6_prefixes,
  count(*) AS total_prefixes, printf('%.6f', count(*)::DOUBLE / any_value(whole)::DOUBLE * 100) AS share_percent,
  any_value(b4) AS collapsed_ipv4_blocks, any_value(b6) AS collapsed_ipv6_blocks, any_value(b4 + b6) AS collapsed_total_blocks
FROM ops JOIN tot USING (snapshot_date) JOIN bl ON bl.snapshot_date = ops.snapshot_date AND bl.operator = ops.operator GROUP BY ops.snapshot_date, ops.operator""",
    "route_series": f"""WITH {ATT_SERIES}
SELECT snapshot_date::VARCHAR AS snapshot_date, operator, count(DISTINCT route) FILTER (family = 4) AS ipv4_bgp_prefixes, count(DISTINCT route) FILTER (family = 6) AS ipv6_bgp_prefixes,
  count(DISTINCT route) AS total_bgp_prefixes FROM ops GROUP BY ALL""",
    "route_comparison": f"""WITH {ATT_LENIENT},
fp AS (SELECT operator, count(*) AS footprint FROM (SELECT DISTINCT operator, asn FROM ops WHERE asn IS NOT NULL) JOIN routed USING (asn) GROUP BY 1),
u AS (SELECT operator, count(DISTINCT route) FILTER (family = 4) AS ipv4_routes, count(DISTINCT route) FILTER (family = 6) AS ipv6_routes,
  count(DISTINCT route) AS total_routes, count(*) AS egress_rows FROM ops WHERE operator IS NOT NULL GROUP BY 1)
SELECT u.*, coalesce(footprint, 0) AS footprint, CASE WHEN footprint > 0 THEN printf('%.1f', total_routes::DOUBLE / footprint::DOUBLE * 100) ELSE 'n/a' END AS used_percent
FROM u LEFT JOIN fp USING (operator)""",
    "asn_breakdown": f"""WITH {ATT_LENIENT}
SELECT asn, operator, as_name, count(DISTINCT route) FILTER (family = 4) AS ipv4_routes, count(DISTINCT route) FILTER (family = 6) AS ipv6_routes,
  count(*) AS egress_rows, count(DISTINCT route) AS total_routes FROM ops WHERE asn IS NOT NULL GROUP BY ALL""",
    "per_asn_share": f"""WITH {ATT_LENIENT},
l AS (SELECT CASE outcome WHEN 'matched' THEN
    CASE WHEN as_name IS NULL THEN 'AS' || asn ELSE split_part(as_name, ' - ', 2)[1:-5] END || ' (AS' || asn || ')' ELSE operator END AS label
  FROM ops WHERE outcome IS NOT NULL)
SELECT label, count(*) AS subnets, printf('%.6f', count(*)::DOUBLE / (SELECT count(*) FROM l)::DOUBLE * 100) AS share_percent FROM l GROUP BY label""",
    "snapshot_report": f"""WITH {ATT_LENIENT}
SELECT count(*) FILTER (country = 'EU') AS selected_subnets, count(*) AS total_subnets, count(*) FILTER (family = 4) AS ipv4_subnets,
  count(DISTINCT route) FILTER (family = 4) AS ipv4_routes, printf('%.2f', count(*) FILTER (country = 'EU')::DOUBLE / count(*)::DOUBLE * 100) AS selected_percent,
  round(count(*) FILTER (family = 4) / nullif(count(DISTINCT route) FILTER (family = 4), 0), 6) AS ipv4_ratio
FROM ops WHERE outcome IS NOT NULL""",
}


# Evidence: the broken piece of each attempt is known from its case number, so the decision follows from the case
# and from plain joins to the catalogue and the origins.
_SLOT = f"(user_id % least((SELECT count(*) FROM customer), {D.V4_SLOTS}))"
ATTEMPTS = f"""{CATALOGUE},
att AS (
  SELECT event_id AS e, 'r' || event_id AS run_id, 'day/' || event_id AS attempt_path, event_id % 12 AS kase, ts, user_id,
    (event_id // 12) % 2 = 0 AS udp, (event_id // 24) % 2 <> 0 AS pinned,
    {_v4(_SLOT, '(CASE WHEN event_id % 12 = 7 THEN 1500 ELSE event_id % 1024 END)')} AS ip,
    1024 + event_id % 60000 AS port, (ts + INTERVAL 5 SECOND)::DATE AS day
  FROM events),
ip AS (SELECT *, (ip >> 24)::VARCHAR || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) AS remote_ip FROM att),
feed AS (SELECT * FROM cat WHERE day = 0 AND family = 4),
origin AS (SELECT day, ip, min({D.FIRST_ASN} + user_id % 4) AS lo, max({D.FIRST_ASN} + user_id % 4) AS hi FROM att WHERE kase <> 11 GROUP BY ALL),
origin_days AS (SELECT DISTINCT day FROM att WHERE kase <> 11),
found AS (
  SELECT a.*, kase NOT IN (2, 10) AS sel, f.s AS fs, f.country, f.region, f.city,
    CASE WHEN kase NOT IN (2, 10) AND o.lo = o.hi THEN o.lo END AS egress_asn,
    CASE WHEN kase NOT IN (2, 10, 5) AND d.day IS NOT NULL THEN {D.FIRST_ASN} END AS ingress_asn
  FROM ip a LEFT JOIN feed f ON a.kase NOT IN (2, 10) AND f.s <= a.ip AND a.ip < f.s + f.n
  LEFT JOIN origin o ON o.day = a.day AND o.ip = a.ip LEFT JOIN origin_days d ON d.day = a.day),
judged AS (
  SELECT *, CASE kase WHEN 2 THEN 'E01_NO_SERVER_OBSERVATION' WHEN 3 THEN 'E02_MULTIPLE_SERVER_CONNECTIONS' WHEN 4 THEN 'E03_NO_FRESH_FLOW'
      WHEN 5 THEN 'E04_WRONG_OR_UNKNOWN_INGRESS' WHEN 6 THEN 'E05_REAL_IP_AT_DESTINATION' WHEN 7 THEN 'E06_EGRESS_NOT_IN_FEED'
      WHEN 8 THEN 'E07_CLOCK_OR_LOG_CORRUPTION' WHEN 9 THEN 'E08_CONDITION_CHANGED' WHEN 10 THEN 'E07_CLOCK_OR_LOG_CORRUPTION' END AS exclusion_reason,
    CASE WHEN fs IS NULL THEN NULL WHEN e % 3 <> 0 THEN CASE WHEN country IN ('EU', 'AS') THEN 'within_declared_country_time_zone' ELSE 'outside_declared_country_time_zone' END
      WHEN country = '' THEN 'unclassifiable' WHEN country <> 'EU' THEN 'inconsistent' WHEN city IN ('BUILDING', 'MACHINERY') THEN 'city_level_consistent'
      ELSE 'primary_boundary_non_match' END AS disclosure_class,
    CASE WHEN sel AND kase <> 5 AND (egress_asn IS NULL OR ingress_asn IS NULL) THEN 'dated_asn_mapping_missing' END AS pending_reason
  FROM found),
rec AS (
  SELECT *, CASE WHEN exclusion_reason IS NOT NULL THEN 'excluded' WHEN pending_reason IS NOT NULL THEN 'pending' ELSE 'accepted' END AS disposition,
    CASE WHEN kase = 6 THEN 'real_ip_bypass' WHEN kase = 2 THEN 'dropped_or_timeout' WHEN kase IN (3, 4, 5, 8, 9, 10) THEN 'ambiguous'
      WHEN kase <> 7 AND pending_reason IS NOT NULL THEN 'pending' WHEN udp THEN 'http3_preserved' ELSE 'tcp_downgrade' END AS protocol_classification,
    CASE WHEN egress_asn IS NOT NULL AND ingress_asn IS NOT NULL THEN (egress_asn - {D.FIRST_ASN}) % 2 = 0 END AS same_operator,
    CASE kase WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 10 THEN 2 ELSE 1 END AS server_delivery_count,
    strftime(ts, '%Y-%m-%d') AS client_day
  FROM judged),
elig AS (
  SELECT *, kase NOT IN (2, 3, 4, 8, 9, 10) AS dest, kase NOT IN (2, 3, 4, 5, 8, 9, 10) AS outer_ok,
    kase NOT IN (2, 3, 4, 5, 6, 7, 8, 9, 10) AND egress_asn IS NOT NULL AND ingress_asn IS NOT NULL AS pair_ok,
    kase NOT IN (2, 3, 4, 6, 7, 8, 9, 10) AND country <> '' AS loc_ok,
    CASE WHEN sel THEN strftime(ts + INTERVAL 5 SECOND, '%Y-%m-%d') ELSE client_day END AS obs_day,
    CASE WHEN kase IN (2, 3, 4, 8, 9, 10) THEN 'ineligible' WHEN kase = 6 THEN 'real_ip_bypass_' || CASE WHEN udp THEN 'http3' ELSE 'http2' END
      WHEN kase = 7 THEN 'non_feed_' || CASE WHEN udp THEN 'http3' ELSE 'http2' END WHEN udp THEN 'http3_preserved' ELSE 'http2_delivered' END AS dest_result
  FROM rec)"""

_MISSING = ";".join([
    "server_delivery_count_not_one", "response_status_not_200", "missing_server_time_utc", "missing_server_remote_ip", "missing_server_remote_port",
    "missing_server_transport", "missing_server_http_protocol", "missing_server_flow_key", "missing_request_uuid", "missing_freshness_evidence",
])
_DIMS = {
    "pin_mode": "CASE WHEN pinned THEN 'pinned' ELSE 'unpinned' END", "intended_ingress_group": "CASE WHEN pinned THEN 'pinned_group' ELSE 'unpinned' END",
    "location_setting": "CASE WHEN e % 3 = 0 THEN 'maintain_general_location' ELSE 'country_and_time_zone' END", "private_relay_state": "'on'",
    "block_id": "'b' || user_id % 5", "session": "'s' || user_id % 3", "quic_block_state": "'none'", "protocol_classification": "protocol_classification",
}
_LONG = " UNION ALL ".join(f"SELECT client_day AS day, disposition, '{d}' AS dimension, {x} AS value FROM rec" for d, x in _DIMS.items())
_FLAGS = {"objective_1_destination_eligible": "dest", "objective_1_outer_leg_eligible": "outer_ok", "objective_2_exact_pair_eligible": "pair_ok",
          "objective_3_location_eligible": "loc_ok", "objective_3_primary_eligible": "loc_ok AND NOT pinned"}
_FLAG_ROWS = " UNION ALL ".join(
    f"SELECT obs_day AS day, '{m}' AS measure, CASE WHEN {x} THEN 'eligible' ELSE 'ineligible' END AS value FROM elig" for m, x in _FLAGS.items()
) + " UNION ALL SELECT obs_day, 'objective_1_destination_result', dest_result FROM elig"

PAIR_SQL = {
    "pair_records": f"""WITH {ATTEMPTS}
SELECT run_id, disposition, exclusion_reason, pending_reason,
  CASE WHEN kase = 10 THEN 'E07_CLOCK_OR_LOG_CORRUPTION,E01_NO_SERVER_OBSERVATION,E02_MULTIPLE_SERVER_CONNECTIONS' ELSE coalesce(exclusion_reason, '') END AS triggered,
  protocol_classification, CASE WHEN fs IS NOT NULL THEN {_cidr('4', 'fs', '22')} END AS matched_prefix, country AS advertised_country, city AS advertised_city,
  disclosure_class, ingress_asn, CASE WHEN kase <> 5 OR egress_asn IS NOT NULL THEN egress_asn END AS egress_asn, same_operator, server_delivery_count,
  CASE WHEN NOT pinned THEN 'not_applicable' WHEN kase = 5 THEN 'other_ingress_observed' ELSE 'intended_ingress_observed' END AS pin_contact_status,
  CASE WHEN kase <> 5 THEN '{D.PIN}' END AS observed_ingress_ip, CASE WHEN kase <> 5 THEN CASE WHEN udp THEN 'udp' ELSE 'tcp' END END AS ingress_transport
FROM rec""",
    "log_selection": f"""WITH {ATTEMPTS}
SELECT run_id, server_delivery_count, 0 AS bad_rows, CASE WHEN sel THEN 'u-' || e || '-0' END AS selected_uuid, kase = 10 AS rows_without_uuid, kase = 3 AS several_flows FROM rec""",
    "server_freshness": f"""WITH {ATTEMPTS}
SELECT attempt_path, true AS fresh, false AS ambiguous_connection, CASE WHEN udp THEN 'quic_initial' ELSE 'tcp_syn' END AS kind FROM rec WHERE sel AND kase <> 4""",
    "objective_eligibility": f"""WITH {ATTEMPTS}
SELECT run_id, dest AS objective_1_destination_eligible,
  CASE kase WHEN 2 THEN '{_MISSING};blocked_by_E01_NO_SERVER_OBSERVATION'
    WHEN 10 THEN '{_MISSING};blocked_by_E01_NO_SERVER_OBSERVATION;blocked_by_E02_MULTIPLE_SERVER_CONNECTIONS;blocked_by_E07_CLOCK_OR_LOG_CORRUPTION'
    WHEN 3 THEN 'server_delivery_count_not_one;blocked_by_E02_MULTIPLE_SERVER_CONNECTIONS' WHEN 4 THEN 'missing_freshness_evidence;blocked_by_E03_NO_FRESH_FLOW'
    WHEN 8 THEN 'blocked_by_E07_CLOCK_OR_LOG_CORRUPTION' WHEN 9 THEN 'condition_changed;blocked_by_E08_CONDITION_CHANGED' ELSE 'eligible' END AS objective_1_destination_reason,
  dest_result AS objective_1_destination_result, outer_ok AS objective_1_outer_leg_eligible, pair_ok AS objective_2_exact_pair_eligible,
  coalesce(loc_ok, false) AS objective_3_location_eligible, coalesce(loc_ok, false) AND NOT pinned AS objective_3_primary_eligible, obs_day AS observation_date_utc FROM elig""",
    "eligibility_summary": f"""WITH {ATTEMPTS}, long AS ({_FLAG_ROWS})
SELECT coalesce(day, 'all') AS day, measure, value, count(*) AS n FROM long GROUP BY GROUPING SETS ((day, measure, value), (measure, value))""",
    "strata": f"""WITH {ATTEMPTS}, long AS ({_LONG})
SELECT coalesce(day, 'all') AS day, dimension, value, count(*) AS attempts, count(*) FILTER (disposition = 'accepted') AS accepted,
  count(*) FILTER (disposition = 'excluded') AS excluded, count(*) FILTER (disposition = 'pending') AS pending
FROM long GROUP BY GROUPING SETS ((day, dimension, value), (dimension, value))""",
    "disposition_counts": f"""WITH {ATTEMPTS}
SELECT 'disposition' AS kind, disposition AS value, count(*) AS n FROM rec GROUP BY 2
UNION ALL SELECT 'exclusion', exclusion_reason, count(*) FROM rec WHERE exclusion_reason IS NOT NULL GROUP BY 2""",
    "temporal_intersection": f"""WITH {ATTEMPTS}, seq AS (SELECT country, region FROM rec WHERE NOT pinned AND disposition = 'accepted'),
v AS (SELECT 'country' AS field, coalesce(country, '') AS raw FROM seq UNION ALL SELECT 'region', coalesce(region, '') FROM seq),
g AS (SELECT field, count(*) AS n, count(DISTINCT raw) AS d, min(lower(trim(raw))) AS lo, max(lower(trim(raw))) AS hi FROM v GROUP BY field)
SELECT CASE WHEN n IS NULL THEN 'insufficient_accepted_unpinned_observations' WHEN (SELECT bool_or(lo = '') FROM g) THEN 'incomplete_location_fields' ELSE 'evaluated' END AS status, k.field, coalesce(n, 0) AS observations,
  CASE WHEN lo = hi AND NOT (SELECT bool_or(lo = '') FROM g) THEN lo END AS common, coalesce(d, 0) AS distinct_raw FROM (VALUES ('country'), ('region')) k(field) LEFT JOIN g USING (field)""",
    "origin_gaps": f"""WITH {ATTEMPTS}, gap AS (SELECT * FROM rec WHERE pending_reason IS NOT NULL)
SELECT DISTINCT day::VARCHAR AS date, 'run_id' AS kind, run_id AS value, NULL::BIGINT AS sort_key FROM gap
UNION SELECT DISTINCT day::VARCHAR, 'ingress', '{D.PIN}', 3325256711 FROM gap UNION SELECT DISTINCT day::VARCHAR, 'egress', remote_ip, ip FROM gap""",
    "freshness_pilot": f"""WITH {ATTEMPTS}, m AS (SELECT *, CASE WHEN e % 5 = 0 THEN 'quit_browser' ELSE 'new_window' END AS freshness_method FROM rec)
SELECT freshness_method, count(*) AS attempts, count(*) FILTER (disposition = 'accepted') AS accepted, 0 AS reused_connections,
  count(*) FILTER (kase = 4) AS no_fresh_flow, count(*) FILTER (kase = 3) AS ambiguous, 0 AS invalid, 0 AS unpaired,
  count(*) FILTER (kase NOT IN (5, 8, 10)) AS reliable, count(*) FILTER (kase IN (5, 8, 10)) = 0 AS clean,
  CASE freshness_method WHEN 'new_window' THEN 1 ELSE 2 END AS ladder_rank, 12.0 AS mean_seconds, NULL AS selected_method FROM m GROUP BY freshness_method""",
    "validation_report": f"""WITH {ATTEMPTS}
SELECT run_id, disposition, protocol_classification, coalesce(exclusion_reason, pending_reason, '') AS reason FROM rec""",
    "pending_addresses": f"""WITH {ATTEMPTS}, gap AS (SELECT * FROM rec WHERE pending_reason IS NOT NULL)
SELECT DISTINCT day::VARCHAR AS date, '{D.PIN}' AS address FROM gap UNION SELECT DISTINCT day::VARCHAR, remote_ip FROM gap""",
    "required_runs": f"""WITH {ATTEMPTS}
SELECT 'log_prefix' AS rule, run_id AS key, server_delivery_count::VARCHAR AS detail FROM rec WHERE server_delivery_count <> 1""",
    "log_dedupe": f"""WITH {ATTEMPTS}, k AS (SELECT rec.*, c FROM rec, (VALUES (0), (1)) t(c) WHERE kase <> 2 AND (c = 0 OR kase IN (3, 10)))
SELECT run_id, 'u-' || e || '-' || c AS request_uuid, CASE WHEN e % 3 = 0 THEN 'log/a.jsonl' ELSE 'log/b.jsonl' END AS artifact, e AS line_number,
  remote_ip, CASE WHEN udp THEN 'HTTP/3.0' ELSE 'HTTP/2.0' END AS proto, 200 AS status, false AS malformed FROM k""",
    "packet_normalisation": f"""WITH {ATTEMPTS}
SELECT attempt_path, e AS frame_number, e * 0.5::DOUBLE AS time_epoch, CASE WHEN e % 2 = 0 THEN remote_ip ELSE '2001:db8::1' END AS src_ip, '{D.PRIVATE}' AS dst_ip,
  CASE WHEN udp THEN 'udp' ELSE 'tcp' END AS transport, port AS src_port, 443 AS dst_port, NOT udp AS tcp_syn, false AS tcp_ack,
  CASE WHEN udp THEN 0 ELSE e END AS tcp_len, udp AND e % 3 = 0 AS quic_initial FROM rec""",
    "timestamp_parsing": f"""WITH {ATTEMPTS}
SELECT run_id, epoch_us(date_trunc('second', ts)) + e % 1000000 AS endpoint_micros, epoch_us(ts) + 5000000 AS iso_micros, true AS offset_rejected FROM rec""",
}

_RESERVED = [(0, 8), (10 << 24, 8), ((100 << 24) + (64 << 16), 10), (127 << 24, 8), ((169 << 24) + (254 << 16), 16), ((172 << 24) + (16 << 16), 12), (192 << 24, 24),
             ((192 << 24) + (2 << 8), 24), ((192 << 24) + (168 << 16), 16), ((198 << 24) + (18 << 16), 15), ((198 << 24) + (51 << 16) + (100 << 8), 24),
             ((203 << 24) + (113 << 8), 24), (240 << 24, 4)]
BLOCKS = f"""
ann AS (
  SELECT ((o_orderkey * 2654435761) % 4294967296) AS net, CASE WHEN o_orderkey % 400 = 0 THEN 16 ELSE 20 + o_orderkey % 5 END AS plen FROM orders),
reserved(s, plen) AS (VALUES {", ".join(f"({s}::BIGINT, {p})" for s, p in _RESERVED)}),
every AS (
  SELECT DISTINCT unnest(range((net >> (32 - plen)) << (24 - plen), ((net >> (32 - plen)) + 1) << (24 - plen))) AS block FROM ann),
blocks AS (
  SELECT block FROM every b WHERE NOT EXISTS (SELECT 1 FROM reserved r WHERE (b.block << 8) >= r.s AND (b.block << 8) < r.s + (1::BIGINT << (32 - r.plen)))),
outcomes AS (
  SELECT block, block % 13 <> 0 AS ok, CASE WHEN block % 17 = 0 THEN 20 WHEN block % 3 = 0 THEN 24 END AS scope FROM blocks WHERE block % 31 <> 0),
cover AS (
  SELECT b.block, o.ok, max(CASE WHEN o.ok AND o.scope = 20 THEN b.block - b.block % 16 + 15 END) OVER (ORDER BY b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS skip_until
  FROM blocks b LEFT JOIN outcomes o USING (block)),
states AS (
  SELECT block, skip_until, CASE WHEN block <= skip_until THEN 'skipped' WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'answered' ELSE 'failed' END AS state FROM cover),
answers AS (SELECT DISTINCT block % 250 AS a FROM blocks WHERE block % 31 <> 0 AND block % 13 <> 0 AND block % 5 <> 0)"""

OTHER_SQL = {
    "source_blocks": f"""WITH {BLOCKS}
SELECT block, (block >> 16)::VARCHAR || '.' || ((block >> 8) & 255) || '.' || (block & 255) || '.0/24' AS prefix FROM blocks""",
    "scope_coverage": f"""WITH {BLOCKS} SELECT block, state, skip_until FROM states""",
    "enumeration_summary": f"""WITH {BLOCKS}
SELECT count(*) AS inputs, count(*) FILTER (state <> 'pending') AS inputs_processed, count(*) FILTER (state = 'skipped') AS skipped_by_returned_scope,
  count(*) FILTER (state = 'failed') AS pending_error_prefixes, (SELECT sum(CASE WHEN ok THEN 1 ELSE 3 END) FROM outcomes)::BIGINT AS dns_queries_sent,
  (SELECT sum(CASE WHEN ok THEN 0 ELSE 3 END) FROM outcomes)::BIGINT AS errors_or_timeouts, (SELECT count(*) FROM answers) AS unique_ingress_ipv4_addresses FROM states""",
    "unique_addresses": f"""WITH {BLOCKS} SELECT '192.0.2.' || a AS answer_ip FROM answers""",
    "resolver_transcripts": """
WITH t AS (SELECT o_orderkey AS k, unnest(CASE k % 3 WHEN 0 THEN [-1] WHEN 1 THEN [0] ELSE [0, 1] END) AS n FROM orders)
SELECT k AS id, CASE WHEN k % 11 = 0 THEN 'SERVFAIL' ELSE 'NOERROR' END AS status, CASE WHEN k % 5 <> 0 AND k % 26 <= 24 THEN k % 26 END AS scope,
  CASE WHEN n >= 0 THEN n END AS position, CASE WHEN n >= 0 THEN '192.0.2.' || (k + n) % 250 END AS answer_ip FROM t""",
    "resolver_answer_lines": """
WITH t AS (SELECT 'A' AS type, (o_orderkey % 250)::VARCHAR AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'A', ((o_orderkey + 1) % 250)::VARCHAR FROM orders WHERE o_orderkey % 3 = 2
  UNION ALL SELECT 'AAAA', 'x' FROM orders)
SELECT type, 'mask.example.net' AS name, 60 AS ttl, count(*) AS n, count(DISTINCT v) AS vals FROM t GROUP BY type""",
    "manifest_check": """
WITH d AS (SELECT *, 'archive/' || source || '/' || doc_id AS path FROM documents)
SELECT path, CASE WHEN doc_id % 17 = 3 THEN 'missing' WHEN doc_id % 23 = 5 THEN 'unlisted' WHEN doc_id % 19 = 4 THEN 'size mismatch'
  WHEN doc_id % 29 = 6 AND strlen(reverse(lower(text))) <> strlen(text) THEN 'size mismatch' ELSE 'hash mismatch' END AS problem
FROM d WHERE (doc_id % 17 = 3) <> (doc_id % 23 = 5) OR (doc_id % 17 <> 3 AND doc_id % 23 <> 5 AND (doc_id % 19 = 4 OR (doc_id % 29 = 6 AND reverse(lower(text)) <> text)))""",
    "daily_artifacts": """
WITH d AS (SELECT 'archive/' || source || '/' || doc_id AS path FROM documents WHERE doc_id % 17 <> 3)
SELECT '2026-01-' || lpad((length(path) % 28 + 1)::VARCHAR, 2, '0') AS day, count(*) AS artifacts FROM d GROUP BY 1""",
    "catalogue_violations": f"""WITH {LENIENT}, r AS (SELECT *, b % 70 = 69 AS shape FROM len), ok AS (SELECT * FROM r WHERE NOT bad AND NOT shape),
c AS (SELECT DISTINCT family, s, n FROM ok),
v AS (SELECT 'row_shape' AS rule FROM r WHERE shape UNION ALL SELECT 'malformed_cidr' FROM r WHERE bad AND NOT shape
  UNION ALL SELECT 'duplicate_cidr' FROM (SELECT family, s, n FROM ok GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'overlap' FROM c x JOIN c y ON x.family = y.family AND y.s <= x.s AND x.s + x.n <= y.s + y.n AND x.n < y.n)
SELECT rule, count(*) AS n FROM v GROUP BY rule""",
    "origin_violations": """
WITH r AS (SELECT s_suppkey AS k, k % 7 = 0 AS bd, k % 11 = 0 AS bp, k % 13 = 0 AS ba, k % 17 = 0 AS bs, k % 19 = 0 AS bh FROM supplier),
d AS (SELECT bd, k // 2 AS p, CASE WHEN ba THEN NULL ELSE 1 END AS a FROM r WHERE NOT bp GROUP BY ALL HAVING count(*) > 1),
v AS (SELECT 'invalid_date' AS rule FROM r WHERE bd UNION ALL SELECT 'invalid_prefix' FROM r WHERE bp UNION ALL SELECT 'invalid_asn' FROM r WHERE ba
  UNION ALL SELECT 'missing_source' FROM r WHERE bs UNION ALL SELECT 'invalid_source_hash' FROM r WHERE bh UNION ALL SELECT 'duplicate_row' FROM d)
SELECT rule, count(*) AS n FROM v GROUP BY rule""",
    "plan_violations": """
WITH a AS (
  SELECT s_suppkey AS k, unnest(CASE k % 10 WHEN 3 THEN [1, 2] WHEN 5 THEN [1, 1] WHEN 7 THEN [2] ELSE [1] END) AS retry,
    CASE WHEN k % 25 = 24 THEN 'ghost' ELSE 'slot' || k END AS slot_id, k % 33 <> 32 AS mine,
    CASE WHEN k % 20 = 3 AND retry = 1 THEN 'timeout' ELSE 'success' END AS outcome, (CASE WHEN k % 40 = 11 THEN k + 10 ELSE k END) * 10 + retry AS begun FROM supplier),
m AS (SELECT * FROM a WHERE mine),
slot AS (SELECT 'slot' || s_suppkey AS slot_id, s_suppkey AS pos FROM supplier),
st AS (SELECT slot_id, pos, (SELECT min(begun) FROM m WHERE m.slot_id = slot.slot_id AND (outcome = 'success' OR retry = 2)) AS complete_at,
  (SELECT min(begun) FROM m WHERE m.slot_id = slot.slot_id) AS first_at FROM slot),
v AS (
  SELECT 'foreign_plan' AS rule FROM a WHERE NOT mine
  UNION ALL SELECT 'unknown_slot' FROM m WHERE slot_id NOT IN (SELECT slot_id FROM slot)
  UNION ALL SELECT 'repeated_retry' FROM (SELECT slot_id, retry FROM m GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'retry_not_allowed' FROM m WHERE retry > 1 AND NOT coalesce((SELECT count(*) = 1 AND max(outcome) = 'timeout' FROM m p WHERE p.slot_id = m.slot_id AND p.retry = m.retry - 1), false)
  UNION ALL SELECT 'earlier_slot_open' FROM m JOIN st USING (slot_id) WHERE EXISTS (SELECT 1 FROM st x WHERE x.pos < st.pos AND coalesce(x.complete_at >= m.begun, true))
  UNION ALL SELECT 'back_fill' FROM m JOIN st USING (slot_id) WHERE m.begun > (SELECT min(first_at) FROM st x WHERE x.pos > st.pos))
SELECT rule, count(*) AS n FROM v GROUP BY rule""",
    "reconstructed_origins": f"""
WITH s AS (SELECT s_suppkey AS k, ({D.V4_BASE} + s_suppkey * 65536) % 4294967296 AS net FROM supplier), times AS (SELECT unnest([0, 1]) AS t),
r AS (SELECT t, 8 AS len, {D.V4_BASE} AS p, 64000 AS asn FROM times UNION ALL SELECT t, 16, net, {D.FIRST_ASN} + k FROM s, times WHERE k % 7 <> 3
  UNION ALL SELECT t, 16, net, {D.FIRST_ASN} + k + 2 FROM s, times WHERE k % 9 = 2 UNION ALL SELECT t, 24, net, {D.FIRST_ASN} + k + 1 FROM s, times WHERE k % 5 = 1
  UNION ALL SELECT t, 20, net, {D.FIRST_ASN} + k FROM s, times WHERE k % 11 = 4 AND t = 1),
g AS (SELECT t, len, p, min(asn) AS lo, max(asn) AS hi FROM r GROUP BY ALL),
a AS (SELECT net, t, l AS len, net - net % (1::BIGINT << (32 - l)) AS p FROM (SELECT DISTINCT net FROM s), times, (SELECT unnest([8, 16, 20, 24]) AS l)),
h AS (SELECT net, t, arg_max({{'len': len, 'p': p, 'lo': lo, 'hi': hi}}, len) AS b FROM a JOIN g USING (t, len, p) GROUP BY ALL),
o AS (SELECT net, count(*) AS usable, min(b) AS x, max(b) AS y FROM h WHERE b.lo = b.hi GROUP BY net),
f AS (SELECT DISTINCT s.net, o.x, CASE WHEN coalesce(usable, 0) <> 2 THEN 'no single scalar origin at some time' WHEN x <> y THEN 'prefix or origin changed' END AS bad FROM s LEFT JOIN o USING (net))
SELECT (net >> 24)::VARCHAR || '.' || ((net >> 16) & 255) || '.' || ((net >> 8) & 255) || '.9' AS address,
  CASE WHEN bad IS NULL THEN {_cidr('4', 'x.p', 'x.len')} END AS prefix, CASE WHEN bad IS NULL THEN x.lo END AS asn, bad AS problem FROM f""",
    "diagnostic_trials": f"""WITH {ATTEMPTS},
t AS (SELECT *, e % 10 AS w, (e // 10) % 2 = 1 AS blocked, (e // 20) % 2 = 0 AS outer_tcp, e % 12 NOT IN (2, 3, 10) AS paired, e % 12 <> 4 AS fresh,
    (e // 10) % 2 = 1 AND e % 30 = 13 AS pf_bad, (e // 10) % 2 = 1 AND e % 30 <> 13 AND e % 3 > 0 AS enforced, e % 12 <> 7 AS in_feed FROM rec),
v AS (SELECT *, CASE WHEN w = 5 OR pf_bad THEN ['integrity_failure', 'excluded_ambiguous'] WHEN NOT paired THEN ['ambiguous_destination_pairing', 'excluded_ambiguous']
    WHEN w = 1 THEN ['real_ip_bypass', 'safety_stop'] WHEN w = 2 THEN ['direct_origin_contact', 'excluded_bypass']
    WHEN NOT in_feed THEN ['egress_not_in_same_day_catalogue', 'excluded_ambiguous'] WHEN NOT udp THEN ['destination_http2_or_tcp', 'observed_non_supporting']
    WHEN NOT fresh THEN ['http3_without_fresh_server_quic', 'excluded_ambiguous'] WHEN NOT blocked THEN ['destination_http3_relayed', 'supports_primary']
    WHEN enforced AND outer_tcp THEN ['outer_tcp_fallback_destination_http3', 'supports_strong_fallback']
    ELSE ['blocked_destination_http3_without_strong_fallback_proof', 'supports_primary_only'] END AS c FROM t),
g AS (SELECT *, CASE WHEN c[2] IN ('excluded_ambiguous', 'excluded_bypass', 'safety_stop') THEN c WHEN w = 6 THEN ['integrity_failure', 'excluded_ambiguous']
    WHEN w = 7 THEN ['condition_changed', 'excluded_ambiguous'] WHEN w = 8 THEN ['timeout', 'observed_non_supporting'] WHEN w = 9 THEN ['mechanical_failure', 'excluded_mechanical'] ELSE c END AS r FROM v)
SELECT run_id, CASE WHEN blocked THEN 'udp_blocked' ELSE 'udp_permitted' END AS condition, CASE WHEN outer_tcp THEN 'tcp' ELSE 'udp' END AS outer_transport,
  CASE WHEN NOT paired THEN NULL WHEN NOT fresh THEN 'none' WHEN udp THEN 'udp_quic_initial' ELSE 'tcp_syn' END AS server_transport,
  paired AND in_feed AS catalogue_match, w = 2 AS direct_origin_contact, r[1] AS classification, r[2] AS acceptance FROM g""",
    "handshake_contacts": f"""WITH {ATTEMPTS}
SELECT attempt_path, CASE WHEN (e // 20) % 2 = 0 THEN 'tcp' ELSE 'udp' END AS transport, 50000 AS client_port, '{D.PIN}' AS ingress_ip, true AS intended, true AS bidirectional,
  (e // 20) % 2 = 0 AS established FROM rec""",
}
OTHER_SQL["condition_summary"] = OTHER_SQL["diagnostic_trials"].replace("SELECT run_id, CASE WHEN blocked", ", z AS (SELECT e, CASE WHEN blocked", 1).rsplit(" FROM g", 1)[0] + """ FROM g),
latest AS (SELECT *, row_number() OVER (PARTITION BY e // 2 ORDER BY e % 2 DESC, e DESC) AS rn FROM z),
per AS (SELECT condition, count(*) AS attempts FROM z GROUP BY 1)
SELECT condition, acceptance, classification, count(*) AS slots, any_value(attempts) AS attempts FROM latest JOIN per USING (condition) WHERE rn = 1 GROUP BY ALL"""

ORACLES = {**CATALOGUE_SQL, **PAIR_SQL, **OTHER_SQL}

_SLOTS = """
WITH r AS (SELECT o_custkey AS c, o_orderkey AS k, (o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 2 AS seen FROM orders),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY k % 5 DESC, k DESC) = 1)"""

ORACLES |= {
    "source_list_check": f"""
WITH l AS (SELECT c_custkey AS p, c_custkey % 23 = 0 AS bad, c_custkey % 37 = 0 AS half, c_custkey % 29 = 0 AS inner_net,
    CASE WHEN c_custkey % 29 = 0 THEN {D.V4_BASE} + c_custkey % 65536 * 256
      ELSE {D.V4_BASE + 2**24} + (c_custkey - CASE WHEN c_custkey % 31 = 0 THEN 2 ELSE 0 END) % 65536 * 256 END AS s FROM customer),
t AS (SELECT *, p || ':' || CASE WHEN bad THEN 'x' || p ELSE (s >> 24) || '.' || ((s >> 16) & 255) || '.' || ((s >> 8) & 255) || '.' || (s & 255)
    || CASE WHEN half THEN '/25' ELSE '/24' END END AS key FROM l)
SELECT 'malformed_prefix' AS rule, key FROM t WHERE bad
UNION ALL SELECT 'not_ipv4_24', key FROM t WHERE NOT bad AND half
UNION ALL SELECT 'not_global', key FROM t WHERE NOT bad AND NOT half AND inner_net
UNION ALL SELECT 'not_increasing', b.key FROM t a JOIN t b ON b.p = a.p + 1 WHERE NOT a.bad AND NOT b.bad AND b.s <= a.s""",
    "stored_series_check": """
WITH r AS (SELECT o_orderkey AS k, DATE '2026-01-01' + ((o_orderkey // 2) * 4 % 2900000)::INTEGER AS start,
    CASE WHEN o_orderkey % 47 = 0 THEN 'v5' WHEN o_orderkey % 2 = 0 OR o_orderkey % 53 = 0 THEN 'v4' ELSE 'v6' END AS family,
    CASE WHEN o_orderkey % 41 = 0 THEN -1 WHEN o_orderkey % 43 = 0 THEN 3 ELSE 2 END AS days FROM orders),
t AS (SELECT *, start + 2 AS stop, family || ' ' || (start + 2)::DATE AS key FROM r)
SELECT 'invalid_value' AS rule, key FROM t WHERE k % 59 = 0
UNION ALL SELECT 'invalid_family', key FROM t WHERE family = 'v5'
UNION ALL SELECT 'invalid_interval', key FROM t WHERE days <> 2
UNION ALL SELECT 'negative_count', key FROM t WHERE k % 61 = 0 AND k > 0
UNION ALL SELECT 'inconsistent_interval', stop::DATE::VARCHAR FROM t GROUP BY stop HAVING count(DISTINCT days) > 1
UNION ALL SELECT 'duplicate_row', any_value(key) FROM t GROUP BY family, stop HAVING count(*) > 1""",
    "slot_retries": f"""{_SLOTS}
SELECT 's' || c AS slot_id, k % 5 AS retry_number, CASE seen WHEN 0 THEN 'udp_permitted' ELSE 'udp_blocked' END AS condition,
  CASE WHEN k % 3 = 0 THEN 'accepted' ELSE 'excluded' END AS acceptance, 'class' || k % 4 AS classification FROM best""",
    "slot_completeness": f"""{_SLOTS}
SELECT count(*) AS planned_total, count(b.c) AS finalized_slot_count, count(*) FILTER (b.c IS NULL) AS missing,
  bool_and(coalesce(seen = c_custkey % 2, false)) AS exact_condition_order,
  count(*) FILTER (b.c IS NULL) = 0 AND bool_and(coalesce(seen = c_custkey % 2, false)) AS final_complete
FROM customer LEFT JOIN best b ON b.c = c_custkey""",
    "host_names": """
WITH a AS (SELECT event_id AS e, user_id AS u FROM events WHERE event_id % 9 <> 0 AND user_id % 300 < 256)
SELECT DISTINCT '192.0.' || e % 199 || '.' || u % 300 AS address, h AS hostname, h IN ('q3', 'n5') AS is_fallback
FROM (SELECT e, u, unnest(['q' || e % 17, 'n' || u % 13]) AS h FROM a)""",
    "packet_counters": """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN event_id % 1000 END AS counter, event_id % 4 IN (0, 2) AS present FROM events""",
}
