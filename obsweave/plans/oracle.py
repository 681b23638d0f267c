"""SQL text of the fixture map and of the derived tables, shared by the oracle queries.

Each name is a list of CTEs; `with_(names, select)` puts together what a query needs.
"""

from __future__ import annotations

from obsweave import dims
from obsweave.functions import cells as C

D = "::DOUBLE"


def case(col: str, table: dict, default: str) -> str:
    parts = " ".join(f"WHEN {col} = '{k}' THEN {v!r}" for k, v in table.items())
    return f"(CASE {parts} ELSE {default} END)"


def series(coef, outer, inner, xi, eta) -> str:
    return " + ".join(f"({c!r}{D}) * {outer}({2 * j} * {xi}) * {inner}({2 * j} * {eta})" for j, c in enumerate(coef, 1))


LON = f"round(36.0{D} + 3.5{D} * (s * 0.61803398875{D} - floor(s * 0.61803398875{D})) + 0.012{D} * (user_id % 3), 6)"
LAT = f"round(46.8{D} + 2.7{D} * (s * 0.75487766625{D} - floor(s * 0.75487766625{D})), 6)"


def codec_ctes(src: str, key: str, prefix: str) -> list[str]:
    """CTEs from (key, lon, lat) rows to ``{prefix}_cells(key, lon, lat, cell_id)``; northern hemisphere."""
    p = prefix
    a = C.A, C.K0, C.RECT, C.E2C
    return [
        f"{p}_z AS (SELECT {key}, lon, lat, floor((lon + 180) / 6)::INT + 1 AS zone FROM {src})",
        f"{p}_t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {a[3]!r}{D} * atanh({a[3]!r}{D} * sin(radians(lat)))) AS t FROM {p}_z)",
        f"{p}_x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM {p}_t)",
        f"{p}_e AS (SELECT *, floor((500000 + {a[1] * a[2]!r}{D} * (eta + {series(C.ALPHA, 'cos', 'sinh', 'xi', 'eta')})) / 1000)::BIGINT AS ek,"
        f" floor(({a[1] * a[2]!r}{D} * (xi + {series(C.ALPHA, 'sin', 'cosh', 'xi', 'eta')})) / 1000)::BIGINT AS nk FROM {p}_x)",
        f"{p}_cells AS (SELECT {key}, lon, lat, zone::VARCHAR || substr('{C.BAND_LETTERS}', floor((lat + 80) / 8)::INT + 1, 1)"
        f" || substr(CASE zone % 3 WHEN 1 THEN '{C.COLUMN_LETTERS[1]}' WHEN 2 THEN '{C.COLUMN_LETTERS[2]}' ELSE '{C.COLUMN_LETTERS[0]}' END, (ek // 100)::INT, 1)"
        f" || substr('{C.ROW_LETTERS}', ((nk // 100 + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20)::INT + 1, 1)"
        f" || lpad((ek % 100)::VARCHAR, 2, '0') || lpad((nk % 100)::VARCHAR, 2, '0') AS cell_id FROM {p}_e)",
    ]


def centroid_ctes(src: str, prefix: str) -> list[str]:
    """CTEs from (cell_id) rows to ``{prefix}(cell_id, lon, lat, sw_lon, sw_lat, step_lon, step_lat)``.

    Northern hemisphere up to 4000 km cycles: the cycle is picked from the band's lower edge.
    """
    p = prefix
    n = C._N
    cols = " ".join(f"WHEN {k} THEN instr('{v}', substr(cell_id, length(cell_id) - 5, 1))" for k, v in C.COLUMN_LETTERS.items())
    delta = " + ".join(f"({c!r}{D}) * sin({2 * j} * chi)" for j, c in enumerate(C.DELTA, 1))
    return [
        f"{p}_a AS (SELECT cell_id, substr(cell_id, 1, length(cell_id) - 7)::INT AS zone, instr('{C.BAND_LETTERS}', substr(cell_id, length(cell_id) - 6, 1)) - 1 AS band FROM {src})",
        f"{p}_b AS (SELECT *, (CASE zone % 3 {cols} END) * 100000 + substr(cell_id, length(cell_id) - 3, 2)::INT * 1000 AS e,"
        f" ((instr('{C.ROW_LETTERS}', substr(cell_id, length(cell_id) - 4, 1)) - 1 + CASE WHEN zone % 2 = 0 THEN 15 ELSE 0 END) % 20) * 100000 + substr(cell_id, length(cell_id) - 1, 2)::INT * 1000 AS n0,"
        f" radians(band * 8 - 80.0{D}) AS phi0 FROM {p}_a)",
        f"{p}_c AS (SELECT *, n0 + 2000000 * ceil(({C.K0 * C.RECT!r}{D} * (phi0 - {1.5 * n!r}{D} * sin(2 * phi0) + {15 / 16 * n * n!r}{D} * sin(4 * phi0)) - 100000 - n0) / 2000000) AS nn FROM {p}_b)",
        f"{p}_d AS (SELECT *, nn / {C.K0 * C.RECT!r}{D} AS xi, (e - 500000) / {C.K0 * C.RECT!r}{D} AS eta FROM {p}_c)",
        f"{p}_e AS (SELECT *, xi - ({series(C.BETA, 'sin', 'cosh', 'xi', 'eta')}) AS xp, eta - ({series(C.BETA, 'cos', 'sinh', 'xi', 'eta')}) AS ep FROM {p}_d)",
        f"{p}_f AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM {p}_e)",
        f"{p}_g AS (SELECT cell_id, degrees(chi + {delta}) AS sw_lat, degrees(atan2(sinh(ep), cos(xp))) + (zone * 6 - 183) AS sw_lon, 1000 / 111320.0{D} AS step_lat FROM {p}_f)",
        f"{p} AS (SELECT *, 1000 / (111320.0{D} * cos(radians(sw_lat))) AS step_lon,"
        f" sw_lon + 1000 / (111320.0{D} * cos(radians(sw_lat))) / 2 AS lon, sw_lat + step_lat / 2 AS lat FROM {p}_g)",
    ]


def uuid_sql(h: str) -> str:
    return f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)"


FAMILY = {s[0]: s[1] for s in dims.SOURCES}
RELIABILITY = {s[0]: min(s[4], dims.RELIABILITY_CAP) for s in dims.SOURCES}
WINDOW_H = {k: v[1] for k, v in dims.BLOCK_PARAMS.items()}
RADIUS_M = {k: v[0] for k, v in dims.BLOCK_PARAMS.items()}

TEXT_TAIL = "CASE WHEN k % 3 = 0 THEN 'witness ' || lang || ' ' || source ELSE 'heavy damage near market' END"
BAND = (f"CASE WHEN n_independent_families < 2 THEN 'Rumored' WHEN confidence >= {dims.BAND_HIGH_MIN} THEN 'High' "
        f"WHEN confidence >= {dims.BAND_MEDIUM_MIN} THEN 'Medium' WHEN confidence >= {dims.BAND_LOW_MIN} THEN 'Low' ELSE 'Rumored' END")

CTES: dict[str, list[str]] = {}
CTES["points"] = [
    f"pts0 AS (SELECT DISTINCT user_id, floor(user_id / 3){D} AS s FROM events)",
    f"pts AS (SELECT user_id, {LON} AS lon, {LAT} AS lat FROM pts0)",
    *codec_ctes("pts", "user_id", "u"),
    "grid AS (SELECT DISTINCT cell_id FROM u_cells WHERE lon BETWEEN 36.0 AND 39.5 AND lat BETWEEN 46.8 AND 49.5)",
]
CTES["raw"] = CTES["points"] + [
    "ev AS (SELECT e.*, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events e)",
    "raw AS (SELECT event_id, user_id, k, floor(user_id / 3)::BIGINT AS site,"
    " CASE event_type WHEN 'view' THEN 'ucdp_ged_bulk' WHEN 'click' THEN 'gdelt_v2' WHEN 'purchase' THEN CASE WHEN k % 5 = 1 THEN 'sentinel2_optical_index' ELSE 'firms_viirs_snpp' END"
    " WHEN 'signup' THEN 'sentinel1_sar_logratio' ELSE CASE WHEN k % 5 = 2 THEN 'unosat' ELSE 'acled_api' END END AS source_id,"
    " CASE WHEN k = 13 THEN 'sonar' ELSE CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'text' WHEN 'purchase' THEN CASE WHEN k % 5 = 1 THEN 'imagery' ELSE 'thermal' END"
    " WHEN 'signup' THEN 'imagery' ELSE CASE WHEN k % 5 = 2 THEN 'imagery' ELSE 'text' END END END AS modality,"
    " CASE WHEN k = 27 THEN 'unknown' ELSE CASE event_type WHEN 'view' THEN 'strike' WHEN 'click' THEN 'artillery_fire' WHEN 'purchase' THEN CASE WHEN k % 5 = 1 THEN 'burn_scar' ELSE 'fire' END"
    " WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'building_damaged' ELSE 'strike' END ELSE CASE WHEN k % 5 = 2 THEN 'building_damaged' ELSE 'explosion' END END END AS obs_type,"
    f" (300 + 10 * k){D} AS geom_precision_m, CASE WHEN k % 10 = 0 THEN floor(user_id / 3)::BIGINT END AS place_id,"
    " to_timestamp((floor(epoch(ts) / 21600) * 21600)::BIGINT) AT TIME ZONE 'UTC' AS occurred_start,"
    f" event_type || ' incident reported at site ' || user_id || ' ' || {TEXT_TAIL} AS text"
    " FROM ev LEFT JOIN documents d ON d.doc_id = ev.doc_id)",
]
CTES["norm"] = CTES["raw"] + [
    "placed AS (SELECT raw.*, occurred_start + INTERVAL 1 HOUR AS occurred_end, u.lon, u.lat, g.cell_id,"
    f" CASE WHEN modality = 'sonar' THEN 'invalid_modality' WHEN obs_type = 'unknown' THEN 'invalid_type' WHEN g.cell_id IS NULL THEN 'no_cell_resolve' END AS reason0,"
    f" {case('source_id', FAMILY, 'source_id')} AS source_family_id"
    " FROM raw JOIN u_cells u USING (user_id) LEFT JOIN grid g ON g.cell_id = u.cell_id)",
    "hashed AS (SELECT *, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || '|' || cell_id || '|' || strftime(occurred_start, '%Y-%m-%dT%H')) AS content_hash FROM placed)",
    "ranked AS (SELECT *, coalesce(reason0, CASE WHEN row_number() OVER (PARTITION BY reason0 IS NULL, content_hash ORDER BY event_id) > 1 THEN 'exact_dup' END) AS reason FROM hashed)",
    f"obs AS (SELECT *, {uuid_sql('sha256(' + chr(39) + 'obs:' + chr(39) + ' || content_hash)')} AS obs_id FROM ranked WHERE reason IS NULL)",
]


def events_from(members: str, out: str = "evt", component: str = "component") -> list[str]:
    """CTEs that assemble events from member rows with ``component`` and ``needs_check``."""
    return [
        f"m_ AS (SELECT m.*, {case('source_id', FAMILY, 'source_id')} AS fam, {case('source_id', RELIABILITY, '0.7')}{D} AS rel FROM {members} m)",
        f"fam_ AS (SELECT {component}, fam, max(rel) AS c FROM m_ GROUP BY ALL)",
        f"conf_ AS (SELECT {component}, round(1 - product(1 - c), 12) AS confidence, count(*) AS n_independent_families FROM fam_ GROUP BY ALL)",
        f"mode_ AS (SELECT {component}, arg_min(obs_type, (-n, obs_type)) AS event_type FROM (SELECT {component}, obs_type, count(*) AS n FROM m_ GROUP BY ALL) GROUP BY ALL)",
        f"core_ AS (SELECT {component}, min(occurred_start) AS occurred_start, max(occurred_end) AS occurred_end, count(*) AS n_sources, min((geom_precision_m, cell_id)) AS rep,"
        f" bool_or(needs_check) AS needs_check, count(*) || ':' || sum(('0x' || substr(sha256(obs_id), 1, 15))::BIGINT) || ':' || sum(('0x' || substr(sha256(obs_id), 17, 15))::BIGINT) AS obs FROM m_ GROUP BY ALL)",
        f"full_ AS (SELECT core_.*, confidence, n_independent_families, event_type, rep[2] AS cell_id, rep[1] AS resolved_precision_m, {BAND} AS confidence_band,"
        f" CASE WHEN n_independent_families >= 2 THEN 'confirmed' ELSE 'candidate' END AS status"
        f" FROM core_ JOIN conf_ USING ({component}) JOIN mode_ USING ({component}))",
        f"{out} AS (SELECT * EXCLUDE (confidence, rep), round(confidence, 6) AS confidence,"
        f" array_to_string(list_sort(list_filter([CASE WHEN n_independent_families = 1 AND n_sources > 1 THEN 'echo-only' END, CASE WHEN needs_check THEN 'verification-needed' END,"
        f" CASE WHEN confidence_band = 'Rumored' THEN CASE WHEN n_independent_families = 1 THEN 'single-source' ELSE 'low-confidence' END END], lambda x: x IS NOT NULL)), ',') AS flags,"
        f" {uuid_sql('sha256(event_type || chr(124) || cell_id || chr(124) || obs)')} AS event_id FROM full_)",
    ]


CTES["events"] = CTES["norm"] + [
    "mem AS (SELECT *, k % 7 = 0 AS needs_check, cell_id || '|' || obs_type || '|' || strftime(occurred_start, '%Y-%m-%d') AS component FROM obs)",
    *events_from("mem"),
]
CTES["centroids"] = CTES["norm"] + ["ocells AS (SELECT DISTINCT cell_id FROM grid)", *centroid_ctes("ocells", "cen")]


def with_(base: str | list[str], *parts: str, recursive: bool = False) -> str:
    """WITH clause of the named base CTEs and extra CTEs, then the final select (the last part)."""
    names = [base] if isinstance(base, str) else base
    ctes: list[str] = []
    for n in names:
        ctes += [c for c in CTES[n] if c not in ctes]
    ctes += list(parts[:-1])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + parts[-1]
