"""SQL counterparts of the registered queries, written for DuckDB over the same tables.

Doubles become decimals through their text, milliseconds come from whole microseconds, and every
count is BIGINT, so that both engines give the same bits and types.
"""

from __future__ import annotations

from ridetide.plans import inputs
from ridetide.sources.fares import BANDS, RATE_TYPES
from ridetide.sources.seeds import SEED_ROWS

W = inputs.WINDOW_MS
NOW = inputs.AS_OF_MS
FROM, TO = inputs.FROM_MS, inputs.TO_MS


def _values(rows) -> str:
    def literal(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, int) or value.replace(".", "").isdigit():
            return str(value)
        return f"'{value}'"

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def _dbl(number) -> str:
    return f"CAST({number} AS DOUBLE)"


_SURGE = f"""CASE WHEN ratio <= {_dbl(0.5)} THEN {_dbl(1.0)}
  WHEN ratio <= {_dbl(0.8)} THEN {_dbl(1.0)} + (ratio - {_dbl(0.5)}) * {_dbl(1.0)}
  WHEN ratio <= {_dbl(1.2)} THEN {_dbl(1.3)} + (ratio - {_dbl(0.8)}) * {_dbl(1.75)}
  WHEN ratio <= {_dbl(2.0)} THEN {_dbl(2.0)} + (ratio - {_dbl(1.2)}) * {_dbl(2.5)}
  WHEN ratio <= {_dbl(3.0)} THEN {_dbl(4.0)} + (ratio - {_dbl(2.0)}) * {_dbl(1.5)}
  ELSE least({_dbl(7.0)}, {_dbl(5.5)} + (ratio - {_dbl(3.0)}) * {_dbl(0.75)}) END"""


def _ratios(counts: str, window_ms: int, carry: str = "") -> str:
    return f"""SELECT {carry} zone_id, window_start, window_start + {window_ms} AS window_end, demand, supply,
  CASE WHEN supply > 0 THEN CAST(demand AS DOUBLE) / CAST(supply AS DOUBLE)
       WHEN demand > 0 THEN {_dbl(999.0)} ELSE {_dbl(0.0)} END AS ratio
FROM {counts}"""


def _metrics(events: str, window_ms: int) -> str:
    counts = f"""(SELECT zone_id, ts_event - ts_event % {window_ms} AS window_start,
        CAST(count(*) FILTER (WHERE kind = 'RIDE') AS BIGINT) AS demand,
        CAST(count(*) FILTER (WHERE kind = 'HEARTBEAT' AND status = 'AVAILABLE') AS BIGINT) AS supply
      FROM {events} GROUP BY 1, 2)"""
    return _ratios(counts, window_ms)


_UPDATE_COLUMNS = (
    "zone_id, window_start, window_end, demand, supply, ratio, surge_multiplier, ts_compute"
)


def _surged(metrics: str, carry: str = "") -> str:
    return f"""SELECT {carry} zone_id, window_start, window_end, demand, supply, ratio,
  {_SURGE} AS surge_multiplier, window_end AS ts_compute FROM ({metrics})"""


def _updates(events: str, window_ms: int) -> str:
    return _surged(_metrics(events, window_ms))


def _priced(counts: str, window_ms: int) -> str:
    return _surged(_ratios(counts, window_ms))


_KIND = "CASE WHEN event_type IN ('purchase', 'click') THEN 'RIDE' ELSE 'HEARTBEAT' END"
_STATUS = "CASE WHEN event_type IN ('view', 'signup') THEN 'AVAILABLE' ELSE 'BUSY' END"

# Named subqueries, in an order in which each uses earlier ones only.
_CTES = {
    "ev": f"""SELECT event_id, user_id, {_KIND} AS kind, CAST(user_id % 16 + 1 AS INTEGER) AS zone_id,
  epoch_us(ts) // 1000 AS ts_event,
  CASE WHEN {_KIND} = 'HEARTBEAT' THEN {_STATUS} END AS status FROM events""",
    "damaged_ev": """SELECT event_id, kind, CASE WHEN event_id % 7 = 4 THEN 0 ELSE zone_id END AS zone_id,
  ts_event, status FROM ev WHERE event_id % 7 IN (0, 4, 5)""",
    "upd": _updates("ev", W),
    "hist": """SELECT zone_id, window_start, window_end, demand, supply,
  CAST(CAST(ratio AS VARCHAR) AS DECIMAL(24,4)) AS ratio,
  CAST(CAST(surge_multiplier AS VARCHAR) AS DECIMAL(4,2)) AS surge_multiplier, ts_compute FROM upd""",
    "snap": f"""SELECT zone_id, surge_multiplier, demand, supply, ratio, window_start, window_end,
  CAST({NOW} AS BIGINT) AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY window_start DESC) AS n FROM hist)
WHERE n = 1""",
    "in_range": f"SELECT * FROM hist WHERE window_start >= {FROM} AND window_end <= {TO}",
    "recent": """SELECT * EXCLUDE (n)
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY window_start DESC) AS n FROM hist)
WHERE n <= 100""",
    "fares": f"""SELECT CAST(zone_id AS INTEGER) AS zone_id, CAST(base_fare AS DECIMAL(8,2)) AS base_fare,
  CAST(distance_rate AS DECIMAL(6,2)) AS distance_rate, CAST(time_rate AS DECIMAL(6,2)) AS time_rate,
  CAST(minimum_fare AS DECIMAL(8,2)) AS minimum_fare, zone_type, active
FROM (VALUES {_values(inputs.SAMPLE_FARES)})
  AS f(zone_id, base_fare, distance_rate, time_rate, minimum_fare, zone_type, active)""",
    "req": """SELECT o_orderkey AS request_id,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_custkey % 64 + 1 END AS INTEGER) AS origin_zone_id,
  CAST(o_orderkey % 64 + 1 AS INTEGER) AS destination_zone_id,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST(-1 AS DOUBLE)
       WHEN o_orderkey % 103 = 0 THEN o_totalprice * CAST(1e4 AS DOUBLE)
       WHEN o_orderkey % 107 = 0 THEN o_totalprice * CAST(1e10 AS DOUBLE)
       WHEN o_orderkey % 109 = 0 THEN o_totalprice * CAST(1e20 AS DOUBLE)
       WHEN o_orderkey % 5 <> 0 THEN o_totalprice / CAST(20000 AS DOUBLE) END AS estimated_distance_km,
  CASE WHEN o_orderkey % 113 = 0 THEN o_totalprice * CAST(1e5 AS DOUBLE)
       WHEN o_orderkey % 7 <> 0 THEN o_totalprice / CAST(9000 AS DOUBLE) END AS estimated_duration_min,
  epoch_us(o_orderdate) // 1000 AS ts FROM orders""",
    "judged": """SELECT *, CASE
  WHEN NOT coalesce(origin_zone_id BETWEEN 1 AND 64, false) THEN 'origin_zone_id'
  WHEN NOT coalesce(destination_zone_id BETWEEN 1 AND 64, false) THEN 'destination_zone_id'
  WHEN estimated_distance_km < 0 THEN 'estimated_distance_km'
  WHEN estimated_distance_km >= 1e22 THEN 'estimated_distance_km too large'
  WHEN estimated_duration_min < 0 THEN 'estimated_duration_min'
  WHEN estimated_duration_min >= 1e22 THEN 'estimated_duration_min too large'
  END AS reject_reason FROM req""",
    "asked": """SELECT o_orderkey AS request_id, CAST(o_custkey % 64 + 1 AS INTEGER) AS zone_id FROM orders""",
    "subs": "SELECT s_suppkey AS subscriber_id, CAST(s_nationkey + 1 AS INTEGER) AS zone_id FROM supplier",
    "closing": """SELECT max(ts_event) FILTER (WHERE kind = 'RIDE') AS rides,
  max(ts_event) FILTER (WHERE kind = 'HEARTBEAT') AS beats FROM ev""",
}


def _with(names: str, body: str) -> str:
    """Prepend the named subqueries; dependencies must be listed too."""
    wanted = names.split()
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in _CTES.items() if name in wanted)
    return f"WITH {ctes}\n{body}"


_HIST = "ev upd hist"
_SNAP = "ev upd hist snap"


def _reference(zone: str, km: str, minutes: str) -> str:
    """Reference fare of the joined fare row ``f``, or the fallback of the zone."""

    def default(values) -> str:
        names = ("DOWNTOWN", "URBAN", "SUBURBAN", "AIRPORT")
        cases = " ".join(f"WHEN '{n}' THEN {_dbl(v)}" for n, v in zip(names, values, strict=False))
        return f"CASE f.zone_type {cases} ELSE {_dbl(values[-1])} END"

    def exact(estimate: str, values) -> str:
        return f"CAST(CAST(coalesce({estimate}, {default(values)}) AS VARCHAR) AS DECIMAL(38,16))"

    def whole(number: str) -> str:
        return f"CAST(floor({number}) AS DECIMAL(22,0))"

    def part(number: str) -> str:
        return f"CAST({number} - floor({number}) AS DECIMAL(17,16))"

    km, minutes = exact(km, (4.2, 6.8, 8.5, 12.0, 6.0)), exact(minutes, (12.0, 15.0, 18.0, 25.0, 15.0))
    return f"""CASE WHEN f.zone_id IS NULL THEN CAST(CASE WHEN {zone} <= 16 THEN 22.50 WHEN {zone} <= 32 THEN 16.80
    WHEN {zone} <= 48 THEN 12.30 ELSE 35.00 END AS DECIMAL(33,2))
  ELSE greatest(CAST(f.base_fare + f.distance_rate * {whole(km)} + f.time_rate * {whole(minutes)}
    + round(f.distance_rate * {part(km)} + f.time_rate * {part(minutes)}, 2) AS DECIMAL(33,2)),
    CAST(f.minimum_fare AS DECIMAL(33,2))) END"""


_RESPONSE = """coalesce(s.surge_multiplier, CAST(1 AS DECIMAL(4,2))) AS surge_multiplier,
  coalesce(s.demand, CAST(0 AS BIGINT)) AS demand, coalesce(s.supply, CAST(0 AS BIGINT)) AS supply,
  coalesce(s.ratio, CAST(0 AS DECIMAL(24,4))) AS ratio"""


def _prices(last_zone: int) -> str:
    reference = _reference("a.zone_id", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    body = f"""SELECT a.request_id, a.zone_id, {_RESPONSE},
  CAST(CASE WHEN s.zone_id IS NOT NULL THEN round({reference} * s.surge_multiplier, 2) END AS DECIMAL(33,2)) AS quoted_fare,
  coalesce(s.updated_at, CAST({NOW} AS BIGINT)) AS updated_at
FROM asked a LEFT JOIN snap s ON s.zone_id = a.zone_id LEFT JOIN fares f ON f.zone_id = a.zone_id
WHERE a.zone_id BETWEEN 1 AND {last_zone}"""
    return _with(f"{_SNAP} fares asked", body)


_QUOTE_REFERENCE = _reference("q.origin_zone_id", "q.estimated_distance_km", "q.estimated_duration_min")
_QUOTES = _with(
    f"{_SNAP} fares req judged",
    f"""SELECT q.request_id, q.origin_zone_id AS zone_id, {_RESPONSE},
  CAST(round({_QUOTE_REFERENCE} * coalesce(s.surge_multiplier, CAST(1 AS DECIMAL(4,2))), 2) AS DECIMAL(33,2)) AS quoted_fare,
  CAST({NOW} AS BIGINT) AS updated_at
FROM judged q LEFT JOIN snap s ON s.zone_id = q.origin_zone_id
LEFT JOIN fares f ON f.zone_id = q.origin_zone_id WHERE q.reject_reason IS NULL""",
)

_BUCKET = """CASE WHEN CAST(surge_multiplier AS DOUBLE) = 1.0 THEN 'normal'
  WHEN surge_multiplier < 1.5 THEN 'low' WHEN surge_multiplier < 2.0 THEN 'medium'
  WHEN surge_multiplier < 2.5 THEN 'high' ELSE 'extreme' END"""
_BUCKETS = "(VALUES ('normal'), ('low'), ('medium'), ('high'), ('extreme')) AS b(bucket)"


def _histogram(names: str, rows: str) -> str:
    return _with(
        names,
        f"""SELECT b.bucket, CAST(count(s.zone_id) AS BIGINT) AS zones FROM {_BUCKETS}
LEFT JOIN (SELECT zone_id, {_BUCKET} AS bucket FROM {rows}) s ON s.bucket = b.bucket GROUP BY 1""",
    )


_ENTRIES = """string_agg(concat_ws(':', window_start, ts_compute, demand, supply, ratio, surge_multiplier), ','
  ORDER BY window_start DESC)"""


def _rollup(rows: str, page: str, low: str, high: str, total: str, name: str = "total_windows") -> str:
    return f"""SELECT zone_id, {page} {low} AS from_ms, {high} AS to_ms, {total} AS {name},
  {_ENTRIES} AS metrics FROM {rows}"""


def _zone_history(rows: str, low, high) -> str:
    """The response of one zone; a response without windows has an empty list."""
    count = "CAST(count(*) AS BIGINT)"
    return _with(
        f"{_HIST} recent",
        f"""SELECT CAST({inputs.HISTORY_ZONE} AS INTEGER) AS zone_id, CAST(0 AS BIGINT) AS page,
  CAST({low} AS BIGINT) AS from_ms, CAST({high} AS BIGINT) AS to_ms, {count} AS total_windows,
  {count} AS page_windows, coalesce({_ENTRIES}, '') AS metrics
FROM (SELECT * FROM {rows} WHERE zone_id = {inputs.HISTORY_ZONE})""",
    )


def _iso(ms: str) -> str:
    """All audit times are whole minutes: written without seconds."""
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%MZ')"


def _feed(join: str, extra: str) -> str:
    return f"""SELECT u.zone_id, u.surge_multiplier, {extra} '2024-02-01T00:00:00Z' AS updated_at,
  u.demand, u.supply, u.ratio FROM upd u {join}"""


_ZONE_FEED = _with(
    "ev upd subs",
    _feed(
        "WHERE u.zone_id IN (SELECT zone_id FROM subs WHERE zone_id BETWEEN 1 AND 16)",
        "CAST(NULL AS DOUBLE) AS quoted_fare,",
    ),
)


def _closed(watermark: str) -> str:
    """Updates of the windows that the final watermark has passed."""
    return _with(
        "ev upd closing",
        f"SELECT {_UPDATE_COLUMNS} FROM upd, closing WHERE window_end <= {watermark}",
    )


def _sequence(fires: str, kept: str, delay_ms: int, rides_lag: int = 0, strict: bool = False, late: bool = False) -> str:
    """Updates by micro-batch. ``kept``: when a row still counts; ``fires``: when a window is emitted.

    The watermark of a micro-batch comes from the slices before it; after the last slice the stream
    runs one more without data. A built-in aggregate drops rows by the watermark of the micro-batch
    before (``before``), the exact mode by its own (``w``). ``late``: only the number of dropped events. ``fresh``: rows of this micro-batch; ``first``: the first micro-batch
    whose watermark has reached the window's end.
    """
    slices, day = inputs.SLICES, inputs.DAY_MS
    newest = "greatest(max(ride) OVER past, max(beat) OVER past)"
    if strict:
        newest = "least(coalesce(max(ride) OVER past, 0), coalesce(max(beat) OVER past, 0))"
    counts = f"""(SELECT batch, zone_id, window_start, demand, supply FROM (
    SELECT b.batch, k.zone_id, k.window_start, b.w, b.before, any_value(k.window_start) + {W} AS window_end,
      CAST(sum(k.demand) AS BIGINT) AS demand, CAST(sum(k.supply) AS BIGINT) AS supply,
      count(*) FILTER (WHERE k.slice = b.batch) AS fresh
    FROM kept k JOIN marks b ON k.slice <= b.batch GROUP BY ALL) WHERE {fires})"""
    return f"""WITH ev AS ({_CTES["ev"]}),
sl AS (SELECT *, least((ts_event - {inputs.FIRST_MS}) // {inputs.SLICE_MS} + CASE WHEN event_id % 13 = 0 THEN 3
    WHEN event_id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN kind = 'RIDE' THEN {rides_lag} ELSE 0 END, {slices - 1}) AS slice,
  ts_event - ts_event % {W} AS window_start FROM ev),
seen AS (SELECT t.b AS batch, max(ts_event) FILTER (WHERE kind = 'RIDE') AS ride,
  max(ts_event) FILTER (WHERE kind = 'HEARTBEAT') AS beat FROM range(0, {slices + 1}) AS t(b) LEFT JOIN sl ON sl.slice = t.b GROUP BY 1),
watermarks AS (SELECT batch, greatest(coalesce({newest}, 0) - {delay_ms}, 0) AS w FROM seen
  WINDOW past AS (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marks AS (SELECT batch, w, coalesce(lag(w) OVER (ORDER BY batch), -1) AS before FROM watermarks),
kept AS (SELECT sl.slice, zone_id, window_start, CASE WHEN kind = 'RIDE' THEN 1 ELSE 0 END AS demand,
  CASE WHEN kind = 'HEARTBEAT' AND status = 'AVAILABLE' THEN 1 ELSE 0 END AS supply
  FROM sl JOIN marks ON marks.batch = sl.slice WHERE {kept.format(end=f"window_start + {W}", lateness=day)})
""" + ("SELECT (SELECT count(*) FROM sl) - (SELECT count(*) FROM kept) AS late" if late else f"""SELECT CAST(batch AS BIGINT) AS batch, * EXCLUDE (batch) FROM ({_surged(_ratios(counts, W, "batch,"), "batch,")})""")


def _fares(seed: int) -> str:
    """Columns of the fare row of ``zone_id`` as drawn with this seed."""

    def band(pick) -> str:
        cases = " ".join(f"WHEN zone_id BETWEEN {b[0]} AND {b[1]} THEN {pick(b)}" for b in BANDS)
        return f"CASE {cases} END"

    def rate(name: str) -> str:
        key = f"'{seed}:{name}:' || zone_id"
        share = f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"

        def drawn(b) -> str:
            low, width = b[3][name]
            extra = f"round(CAST(CAST({share} * {_dbl(width)} AS VARCHAR) AS DECIMAL(20,10)), 2)"
            return f"CAST({low} + {extra} AS {RATE_TYPES[name].upper()})"

        return f"{band(drawn)} AS {name}"

    rates = ",\n  ".join(rate(name) for name in RATE_TYPES)
    kind = band(lambda b: f"'{b[2]}'")
    return f"{rates}, {kind} AS zone_type"


def _fare_table() -> str:
    return _with(
        "ev",
        f"""SELECT zone_id, {_fares(1)}, true AS active,
  CAST((SELECT count(*) FROM ev WHERE ev.zone_id = band.zone_id) AS BIGINT) AS events
FROM (SELECT CAST(z AS INTEGER) AS zone_id FROM range(1, 17) AS t(z)) AS band""",
    )


def _contract() -> str:
    ride = """CASE event_id % 6 WHEN 1 THEN 'zone_id:maximum' WHEN 2 THEN 'ts_event:minimum'
  WHEN 3 THEN 'payment_type:enum' WHEN 4 THEN 'event_id:format,zone_id:type'
  WHEN 5 THEN 'extra:additional,payment_type:required' ELSE '' END"""
    beat = """CASE event_id % 6 WHEN 1 THEN 'zone_id:maximum' WHEN 2 THEN 'ts_event:minimum'
  WHEN 3 THEN 'status:enum' WHEN 4 THEN 'driver_id:format,zone_id:type'
  WHEN 5 THEN 'extra:additional,status:required' ELSE '' END"""
    return _with("ev", f"SELECT event_id, CASE WHEN kind = 'RIDE' THEN {ride} ELSE {beat} END AS violations FROM ev")


_SEEDED = f"""WITH ev AS ({_CTES["ev"]}), upd AS ({_updates("ev", 5_000)}), hist AS ({_CTES["hist"]}),
versions AS (SELECT zone_id, surge_multiplier, demand, supply, ratio, window_start, window_end, ts_compute AS updated_at FROM hist
  UNION ALL SELECT CAST(zone_id AS INTEGER), CAST(surge AS DECIMAL(4,2)), CAST(demand AS BIGINT), CAST(supply AS BIGINT),
  CAST(ratio AS DECIMAL(24,4)), CAST({inputs.FIRST_MS - 60_000} AS BIGINT), CAST({inputs.FIRST_MS - 46_000} AS BIGINT), CAST({inputs.FIRST_MS} AS BIGINT)
  FROM (VALUES {_values(SEED_ROWS)}) AS seed(zone_id, surge, demand, supply, ratio)),
asked AS (SELECT CAST(z AS INTEGER) AS zone_id, CAST({inputs.FIRST_MS} + {inputs.INSTANT_MS} * (1 << k) AS BIGINT) AS as_of
  FROM range(1, 17) AS zones(z), range(0, {inputs.INSTANTS}) AS instants(k))
SELECT a.zone_id, a.as_of, v.* EXCLUDE (zone_id) FROM asked a ASOF JOIN versions v ON v.zone_id = a.zone_id AND v.updated_at <= a.as_of"""

_FLEET = _with(
    _SNAP,
    f"""SELECT CASE WHEN count(*) = 0 THEN 'No data available yet' END AS message,
  CAST(count(DISTINCT zone_id) AS BIGINT) AS active_zones, CAST(count(*) AS BIGINT) AS total_snapshots,
  CAST(sum(surge_multiplier) AS DOUBLE) / nullif(count(*), 0) AS average_surge,
  CAST(min(surge_multiplier) AS DOUBLE) AS min_surge, CAST(max(surge_multiplier) AS DOUBLE) AS max_surge,
  CAST(coalesce(sum(demand), 0) AS BIGINT) AS total_demand, CAST(coalesce(sum(supply), 0) AS BIGINT) AS total_supply,
  CASE WHEN sum(supply) > 0 THEN CAST(sum(demand) AS DOUBLE) / CAST(sum(supply) AS DOUBLE) ELSE 0.0 END AS average_ratio,
  concat_ws(',', {", ".join(f"'{b}=' || count(*) FILTER (WHERE {_BUCKET} = '{b}')" for b in ("extreme", "high", "low", "medium", "normal"))}) AS surge_distribution
FROM snap""",
)

_VERSIONS = " UNION ALL ".join(
    f"SELECT CAST(z AS INTEGER) AS zone_id, {_fares(n)}, CAST({at} AS BIGINT) AS known FROM (SELECT z, z AS zone_id FROM range(1, 17) AS t(z))"
    for n, at in enumerate(inputs.FARE_CHANGES, start=1)
)
_PACED = f"""paced AS (SELECT * REPLACE ({inputs.FIRST_MS} + (ts - {inputs.ORDERS_MS}) // {inputs.PACE} + request_id % 900000 AS ts)
  FROM judged WHERE reject_reason IS NULL),
versions AS ({_VERSIONS})"""
_QUOTES_AS_OF = _with(
    "ev upd hist req judged",
    f""", {_PACED}
SELECT q.request_id, q.origin_zone_id AS zone_id, {_RESPONSE},
  CAST(round({_QUOTE_REFERENCE} * coalesce(s.surge_multiplier, CAST(1 AS DECIMAL(4,2))), 2) AS DECIMAL(33,2)) AS quoted_fare,
  CAST(q.ts AS BIGINT) AS updated_at
FROM paced q ASOF LEFT JOIN hist s ON s.zone_id = q.origin_zone_id AND s.ts_compute <= q.ts
ASOF LEFT JOIN versions f ON f.zone_id = q.origin_zone_id AND f.known <= q.ts""",
)

_SLICE = f"greatest(0, least(({{at}} - {inputs.FIRST_MS}) // {inputs.LIVE_SLICE_MS} + CASE WHEN {{late}} THEN 1 ELSE 0 END, {inputs.LIVE_SLICES - 1}))"
_QUOTES_LIVE = _with(
    "ev upd hist fares req judged",
    f""", {_PACED},
asked AS (SELECT *, {_SLICE.format(at="ts", late="request_id % 11 = 0")} AS slice FROM paced),
known AS (SELECT *, {_SLICE.format(at="ts_compute", late=f"(window_start // {W} + zone_id) % 7 = 0")} AS slice FROM hist),
seen AS (SELECT q.request_id, max(k.ts_compute) AS ts_compute FROM asked q JOIN known k ON k.zone_id = q.origin_zone_id
  AND (k.slice < q.slice OR (k.slice = q.slice AND k.ts_compute <= q.ts)) GROUP BY 1)
SELECT q.request_id, q.origin_zone_id AS zone_id, {_RESPONSE},
  CAST(round({_QUOTE_REFERENCE} * coalesce(s.surge_multiplier, CAST(1 AS DECIMAL(4,2))), 2) AS DECIMAL(33,2)) AS quoted_fare,
  CAST(q.ts AS BIGINT) AS updated_at
FROM asked q LEFT JOIN seen USING (request_id) LEFT JOIN hist s ON s.zone_id = q.origin_zone_id AND s.ts_compute = seen.ts_compute
LEFT JOIN fares f ON f.zone_id = q.origin_zone_id""",
)

_SEEDED_SLICES = f"""SELECT CAST(log2((as_of - {inputs.FIRST_MS}) // {inputs.INSTANT_MS}) / 2 AS INTEGER) AS slice, * EXCLUDE (as_of)
FROM ({_SEEDED}) WHERE CAST(log2((as_of - {inputs.FIRST_MS}) // {inputs.INSTANT_MS}) AS INTEGER) % 2 = 0"""

_HISTORY = _with(_HIST, "SELECT * FROM hist")

ORACLE: dict[str, str] = {
    "normalize_events": _with("ev", "SELECT kind, zone_id, ts_event, status FROM ev"),
    "normalize_json": _with("ev", "SELECT event_id, kind, zone_id, ts_event, status FROM ev"),
    "normalize_damaged_json": _with("ev damaged_ev", "SELECT event_id, kind, zone_id, ts_event, status FROM damaged_ev"),
    "quarantine_events": _with(
        "ev",
        """SELECT event_id, CASE event_id % 7 WHEN 3 THEN 'missing zone_id' WHEN 6 THEN 'missing ts_event'
  ELSE 'unparsable' END AS reason FROM ev WHERE event_id % 7 IN (1, 2, 3, 6)""",
    ),
    "stream_quarantine": _with(
        "ev",
        """SELECT kind, CASE event_id % 7 WHEN 3 THEN 'missing zone_id' WHEN 6 THEN 'missing ts_event'
  ELSE 'unparsable' END AS reason, CAST(count(*) AS BIGINT) AS payloads
FROM ev WHERE event_id % 7 IN (1, 2, 3, 6) GROUP BY 1, 2""",
    ),
    "contract_violations": _contract(),
    "price_update_contract": _with(
        "ev upd",
        f"""SELECT zone_id, window_start, array_to_string(list_sort(list_filter([
  CASE WHEN surge_multiplier > 3 THEN 'surge_multiplier:maximum' END,
  CASE (window_start // {W} + zone_id) % 10 WHEN 1 THEN 'zone_id:maximum' WHEN 2 THEN 'window_start:minimum'
    WHEN 3 THEN 'window_end:type' WHEN 4 THEN 'demand:required' WHEN 5 THEN 'supply:type' WHEN 6 THEN 'ratio:minimum'
    WHEN 7 THEN 'ts_compute:required' WHEN 8 THEN 'reference_fare:minimum' WHEN 9 THEN 'extra:additional' END],
  lambda v: v IS NOT NULL)), ',') AS violations FROM upd""",
    ),
    "enum_parse": _with("ev", "SELECT kind, status, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY 1, 2"),
    "zone_demand_supply": _with("ev upd", "SELECT zone_id, window_start, window_end, demand, supply FROM upd"),
    "price_updates": _with("ev upd", f"SELECT {_UPDATE_COLUMNS} FROM upd"),
    "price_updates_hourly": _with("ev", _updates("ev", 3_600_000)),
    "price_updates_default_window": _with("ev", _updates("ev", 5_000)),
    "price_updates_from_json": _with("ev damaged_ev", _updates("damaged_ev", W)),
    "price_update_json": _with(
        "ev upd",
        """SELECT printf('%08X', zone_id) AS key_hex,
  '{"zone_id":' || zone_id || ',"window_start":' || window_start || ',"window_end":' || window_end ||
  ',"demand":' || demand || ',"supply":' || supply || ',"ratio":' || CAST(ratio AS VARCHAR) ||
  ',"surge_multiplier":' || CAST(surge_multiplier AS VARCHAR) || ',"ts_compute":' || ts_compute || '}' AS value
FROM upd""",
    ),
    "price_update_decode": _HISTORY,
    "zone_window_metrics": _HISTORY,
    "zone_window_metrics_extreme": _with(
        _HIST,
        f"""SELECT * EXCLUDE (ratio, surge_multiplier), CAST(CAST(ratio AS VARCHAR) AS DECIMAL(24,4)) AS ratio,
  CAST(CAST(surge_multiplier AS VARCHAR) AS DECIMAL(4,2)) AS surge_multiplier
FROM ({_priced("(SELECT zone_id, window_start, demand * " + str(inputs.CROWD) + " AS demand, supply FROM upd)", W)})""",
    ),
    "zone_prices_from_tables": _prices(16),
    "zones_listing_from_tables": _with(
        _SNAP, "SELECT zone_id, surge_multiplier, demand, supply, ratio, updated_at FROM snap"
    ),
    "zone_price_snapshot": _with(_SNAP, "SELECT * FROM snap"),
    "snapshot_over_seed": _SEEDED,
    "fare_table": _fare_table(),
    "history_range": _with(f"{_HIST} in_range", "SELECT * FROM in_range"),
    "history_recent": _with(f"{_HIST} recent", "SELECT * FROM recent"),
    "history_full": _HISTORY,
    "history_rollup": _with(
        f"{_HIST} recent",
        _rollup("recent", "", "min(window_start)", "max(window_end)", "CAST(count(*) AS BIGINT)") + " GROUP BY zone_id",
    ),
    "history_rollup_range": _with(
        f"{_HIST} in_range",
        _rollup(
            "in_range",
            f"({TO} - window_end) // {W * 12} AS page,",
            f"CAST({FROM} AS BIGINT)",
            f"CAST({TO} AS BIGINT)",
            """any_value((SELECT CAST(count(*) AS BIGINT) FROM in_range w WHERE w.zone_id = in_range.zone_id)) AS total_windows,
  CAST(count(*) AS BIGINT)""",
            "page_windows",
        )
        + " GROUP BY 1, 2",
    ),
    "zone_history_recent": _zone_history("recent", "min(window_start)", "max(window_end)"),
    "zone_history_since": _zone_history(f"(SELECT * FROM hist WHERE window_start >= {FROM} AND window_end <= {NOW})", FROM, NOW),
    "zone_history_until": _zone_history(
        f"(SELECT * FROM hist WHERE window_start >= {TO - inputs.DAY_MS} AND window_end <= {TO})", TO - inputs.DAY_MS, TO
    ),
    "zone_history_empty": _zone_history("(SELECT * FROM hist WHERE false)", 0, inputs.DAY_MS),
    "audit_topk": _with(
        _HIST,
        f"""SELECT zone_id, {_iso('window_start')} AS window_start, {_iso('window_end')} AS window_end, demand, supply,
  CAST(ratio AS DOUBLE) AS ratio, CAST(surge_multiplier AS DOUBLE) AS surge_multiplier, {_iso('ts_compute')} AS ts_compute
FROM (SELECT * FROM hist ORDER BY ts_compute DESC, zone_id, window_start DESC LIMIT 50)""",
    ),
    "audit_count": _with(_HIST, 'SELECT least(CAST(count(*) AS BIGINT), 50) AS "count" FROM hist'),
    "zones_listing": _with(
        _SNAP, "SELECT zone_id, surge_multiplier, demand, supply, ratio, updated_at FROM snap"
    ),
    "zones_count": _with(_SNAP, 'SELECT CAST(count(*) AS BIGINT) AS "count" FROM snap'),
    "surge_only_zones": _with(
        _SNAP, "SELECT zone_id, surge_multiplier, demand, supply, ratio, updated_at FROM snap WHERE surge_multiplier > 1"
    ),
    "fleet_metrics": _FLEET,
    "surge_histogram": _histogram(_SNAP, "snap"),
    "surge_histogram_windows": _histogram(_HIST, "hist"),
    "zone_prices": _prices(16),
    "zone_prices_wide": _prices(64),
    "zone_requests_rejected": _with(
        "asked", "SELECT request_id, zone_id, 'zone_id not in 1..16' AS reject_reason FROM asked WHERE zone_id > 16"
    ),
    "quotes": _QUOTES,
    "quotes_as_of": _QUOTES_AS_OF,
    "quotes_rejected": _with("req judged", "SELECT * FROM judged WHERE reject_reason IS NOT NULL"),
    "reference_fares": _with(
        "fares req judged",
        f"""SELECT q.request_id, {_QUOTE_REFERENCE} AS reference_fare
FROM judged q LEFT JOIN fares f ON f.zone_id = q.origin_zone_id WHERE q.reject_reason IS NULL""",
    ),
    "all_zones_feed": _with("ev upd", _feed("", "")),
    "zone_feed": _ZONE_FEED,
    "stream_price_updates": _with("ev upd", f"SELECT {_UPDATE_COLUMNS} FROM upd"),
    "stream_final": _closed("least(rides, beats) - 20000"),
    "stream_final_union": _closed("greatest(rides, beats) - 20000"),
    "stream_exact": _closed("least(rides, beats) - 10000"),
    "stream_history": _HISTORY,
    "stream_snapshot": _with(_SNAP, "SELECT * FROM snap"),
    "stream_exact_sequence": _sequence(
        "window_end <= w AND (fresh > 0 OR window_end > before)", "{end} + {lateness} > w", inputs.DAY_MS
    ),
    "stream_late_events": _sequence("true", "{end} + {lateness} > w", inputs.DAY_MS, late=True),
    "stream_ingested_updates": _with("ev damaged_ev", _updates("damaged_ev", W)),
    "stream_live_sequence": _sequence("fresh > 0", "{end} > before", 2 * inputs.DAY_MS, 2, strict=True),
    "stream_live_sequence_union": _sequence("fresh > 0", "{end} > before", 2 * inputs.DAY_MS, 2),
    "stream_quotes_live": _QUOTES_LIVE,
    "stream_snapshot_seeded": _SEEDED_SLICES,
    "stream_fleet_metrics": _FLEET,
    "stream_history_recent": f"""SELECT zone_id, window_start, window_end, demand, supply,
  CAST(CAST(ratio AS VARCHAR) AS DECIMAL(24,4)) AS ratio, CAST(CAST(surge_multiplier AS VARCHAR) AS DECIMAL(4,2)) AS surge_multiplier, ts_compute
FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY window_start DESC) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, window_start ORDER BY batch DESC) AS age
    FROM ({_sequence("fresh > 0", "{end} > before", 2 * inputs.DAY_MS, 2, strict=True)})) WHERE age = 1) WHERE n <= 100""",
    "stream_open_windows": _with(
        "ev upd closing",
        "SELECT zone_id, window_start, window_end, demand, supply FROM upd, closing WHERE window_end > least(rides, beats) - 20000",
    ),
    "stream_refused_counts": _with(
        "ev",
        """SELECT CASE kind WHEN 'RIDE' THEN 'rides' ELSE 'heartbeats' END AS stream, CAST(count(*) AS BIGINT) AS received,
  CAST(count(*) FILTER (WHERE event_id % 7 IN (1, 2, 3, 6)) AS BIGINT) AS refused FROM ev GROUP BY 1""",
    ),
    "stream_history_new_checkpoint": _HISTORY,
    "stream_snapshot_new_checkpoint": _with(_SNAP, "SELECT * FROM snap"),
    "stream_snapshot_late": _with(
        _SNAP,
        f"""SELECT * EXCLUDE (n) FROM (SELECT zone_id, surge_multiplier, demand, supply, ratio, window_start, window_end,
  CAST({NOW} AS BIGINT) AS updated_at,
  row_number() OVER (PARTITION BY zone_id ORDER BY window_start < {FROM} DESC, window_start DESC) AS n FROM hist)
WHERE n = 1""",
    ),
    "stream_snapshot_late_by_time": _with(_SNAP, "SELECT * FROM snap"),
    "stream_json_history": _HISTORY,
    "stream_json_history_compacted": _HISTORY,
    "stream_zone_feed": _ZONE_FEED,
    "stream_quotes": _QUOTES,
}
