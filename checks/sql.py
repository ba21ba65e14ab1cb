"""SQL fragments shared by the oracles."""

from __future__ import annotations

import math

from corridor_spark.fixtures import cte
from corridor_spark.functions import geo
from corridor_spark.lexicons import ROAD_CLASS_OTHER, ROAD_CLASSES, ROAD_WORDS, ROUTE_PREFIXES, TRAFFIC_RULES, TRAFFIC_SMALL_WORDS

P = "|".join(ROUTE_PREFIXES)


def cols(spec: str) -> list[tuple[str, int | None]]:
    """``"a b:4"`` → names and the digits to round to."""
    return [(p.split(":")[0], max(4, int(p.split(":")[1])) if ":" in p else None) for p in spec.split()]


def guard_rounds(sql: str) -> str:
    """Add the package's rounding guard to every ``ROUND(x, digits)``."""
    out, at = [], 0
    while (hit := sql.find("ROUND(", at)) >= 0:
        depth, comma, i = 0, -1, hit + 6
        while depth or sql[i] != ")":
            depth += (sql[i] in "([{") - (sql[i] in ")]}")
            if sql[i] == "," and not depth:
                comma = i
            i += 1
        inner = guard_rounds(sql[hit + 6:comma])
        out += [sql[at:hit], "ROUND(", inner, " + 1e-9", sql[comma:i + 1]]
        at = i + 1
    return "".join(out) + sql[at:]


def select(spec: str, source: str) -> str:
    parts = [f"ROUND(CAST({c} AS DOUBLE), {d}) AS {c}" if d is not None else c for c, d in cols(spec)]
    return f"SELECT {', '.join(parts)} FROM {source}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def has(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def fold(x: str) -> str:
    return f"strip_accents(lower(COALESCE(CAST({x} AS VARCHAR), '')))"


def compact(x: str) -> str:
    return f"trim({sub(sub(fold(x), '<[^>]+>', ' '), '[^a-z0-9]+', ' ')})"


def plain(x: str) -> str:
    return f"trim({sub(x, '[^a-z0-9]+', ' ')})"


def tcompact(x: str) -> str:
    return plain(fold(x))


def ttext(x: str) -> str:
    return f"trim({sub(sub(fold(x), '[^a-z0-9/ ._-]+', ' '), ' +', ' ')})"


def words(x: str) -> str:
    for short, full in ROAD_WORDS:
        x = sub(x, rf"\b(?:{'|'.join(short)})\b", full)
    return x


def road(x: str) -> str:
    return words(tcompact(x))


def title(x: str) -> str:
    """Road title of compact text."""
    small = ", ".join(q(w) for w in TRAFFIC_SMALL_WORDS)
    prefixes = ", ".join(q(w) for w in ROUTE_PREFIXES)
    cap = "upper(w[1:1]) || w[2:]"
    l = f"string_split({x}, ' ')"
    return (
        f"array_to_string(list_transform({l}, lambda w, i: CASE WHEN i > 1 AND w IN ({small}) THEN w "
        f"WHEN w IN ({prefixes}) THEN upper(w) "
        f"WHEN i > 1 AND ({l})[i-1] IN ({prefixes}) AND regexp_matches(w, '^[0-9]{{1,3}}[a-z]?$') THEN upper(w) "
        f"ELSE {cap} END), ' ')"
    )


REF = rf"\b({P})\s*-?\s*0*([0-9]{{1,3}}[a-z]?)\b"
REF_WHOLE = rf"^({P})\s*0*([0-9]{{1,3}}[a-z]?)$"


def refs(text: str) -> str:
    """Sorted distinct references of traffic text."""
    return (
        f"list_sort(list_distinct(list_transform(regexp_extract_all({text}, {q(REF)}), "
        f"lambda r: regexp_replace(r, {q(REF)}, '\\1 \\2'))))"
    )


def is_ref(compact_text: str) -> str:
    return f"regexp_matches({compact_text}, {q(REF_WHOLE)})"


def ref_of(compact_text: str) -> str:
    return f"regexp_replace({compact_text}, {q(REF_WHOLE)}, '\\1 \\2')"


def norm(x: str, quantile: float = 0.95, over: str = "") -> str:
    """Robust norm as window expressions over the whole relation."""
    lo, top = f"(min({x}) OVER ({over}))", f"(quantile_cont({x}, {quantile}) OVER ({over}))"
    hi = f"(CASE WHEN {top} > {lo} THEN {top} ELSE max({x}) OVER ({over}) END)"
    return f"(CASE WHEN {hi} > {lo} THEN (LEAST(GREATEST({x}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) ELSE 0e0 END)"


def scale(x: str, quantile: float = 0.95) -> str:
    v = f"GREATEST({x}, 0)"
    top = f"(quantile_cont({v}, {quantile}) OVER ())"
    hi = f"(CASE WHEN {top} > 0 THEN {top} ELSE max({v}) OVER () END)"
    return f"(CASE WHEN {hi} > 0 THEN LEAST({v} / {hi}, 1) ELSE 0e0 END)"


def wsum(*parts: tuple[float, str]) -> str:
    return "(" + " + ".join(f"{w:.10g}e0 * {x}" for w, x in parts) + ")"


def local(ts: str) -> str:
    return f"({ts} - INTERVAL 6 HOURS)"


def haversine(ax: str, ay: str, bx: str, by: str) -> str:
    return (
        f"(2 * 6371000e0 * asin(sqrt(pow(sin(radians({by}-{ay})/2), 2) + cos(radians({ay}))*cos(radians({by}))"
        f"*pow(sin(radians({bx}-{ax})/2), 2))))"
    )


def distance(px: str, py: str, kx: str | None = None, ky: str = "111320e0") -> str:
    """Metres from a point to a piece (ax, ay, bx, by_) after scaling."""
    kx = kx or f"(111320e0*cos(radians({py})))"
    dx, dy = f"((bx-ax)*{kx})", f"((by_-ay)*{ky})"
    qx, qy = f"(({px}-ax)*{kx})", f"(({py}-ay)*{ky})"
    t = (f"(CASE WHEN {dx}*{dx}+{dy}*{dy} > 0 THEN GREATEST(0e0, LEAST(1e0, ({qx}*{dx}+{qy}*{dy})/({dx}*{dx}+{dy}*{dy}))) "
         f"ELSE 0e0 END)")
    return f"sqrt(pow({qx}-{t}*{dx}, 2) + pow({qy}-{t}*{dy}, 2))"


def road_class(tag: str) -> str:
    cases = " ".join(f"WHEN {one_of(tag, tags)} THEN {q(name)}" for name, tags in ROAD_CLASSES)
    return f"CASE {cases} ELSE {q(ROAD_CLASS_OTHER)} END"


def ladder(x: str, steps, beyond: str, missing: str) -> str:
    cases = " ".join(f"WHEN {x} <= {u} THEN {q(n)}" for u, n in steps)
    return f"CASE WHEN {x} IS NULL THEN {q(missing)} {cases} ELSE {q(beyond)} END"


def mode_by(rel: str, keys: str, col: str) -> str:
    """Most frequent non-blank value per key, smallest on ties."""
    return (
        f"(SELECT {keys}, {col} FROM (SELECT {keys}, {col}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {col}) rn "
        f"FROM {rel} WHERE trim({col}) <> '' GROUP BY {keys}, {col}) WHERE rn = 1)"
    )


# --- roads -------------------------------------------------------------------

ROADS = f"""{cte('road_piece')},
seg AS (
  SELECT *, CAST(department AS VARCHAR) AS source_department, ROUND({haversine('ax','ay','bx','by_')}, 2) AS length_m,
         CASE WHEN {tcompact('name')} <> '' THEN {tcompact('name')} WHEN {tcompact('ref')} <> '' THEN {tcompact('ref')}
              ELSE 'osm_way_' || way_id END AS road_key_norm,
         {road_class('highway')} AS road_type_category
  FROM road_piece),
cat0 AS (SELECT source_department, road_key_norm, count(*) AS segment_count, ROUND(SUM(length_m)/1000, 3) AS length_km,
                list_sort(list_distinct(list(ref) FILTER (ref <> ''))) AS ref_list
         FROM seg GROUP BY ALL),
cat AS (SELECT c.*, COALESCE(n.name, '') AS representative_name, COALESCE(h.highway, '') AS predominant_highway,
               COALESCE(t.road_type_category, '') AS predominant_road_type
        FROM cat0 c
        LEFT JOIN {mode_by('seg', 'source_department, road_key_norm', 'name')} n USING (source_department, road_key_norm)
        LEFT JOIN {mode_by('seg', 'source_department, road_key_norm', 'highway')} h USING (source_department, road_key_norm)
        LEFT JOIN {mode_by('seg', 'source_department, road_key_norm', 'road_type_category')} t USING (source_department, road_key_norm)),
name_lookup AS (
  SELECT key, trim(CASE WHEN trim(representative_name) <> '' THEN representative_name ELSE road_key_norm END) AS name,
         predominant_road_type AS road_type, length_km, source_department AS departments FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY length_km DESC, road_key_norm, source_department) AS rn
    FROM (SELECT *, {road('road_key_norm')} AS key FROM cat) WHERE key <> '' AND NOT starts_with(key, 'osm way')) WHERE rn = 1),
ref_lookup AS (
  SELECT key, CASE WHEN {tcompact('name')} = key THEN upper(key) ELSE name END AS name, road_type, length_km, departments FROM (
    SELECT key, trim(CASE WHEN trim(representative_name) <> '' THEN representative_name ELSE road_key_norm END) AS name,
           predominant_road_type AS road_type, length_km, source_department AS departments,
           row_number() OVER (PARTITION BY key ORDER BY length_km DESC, road_key_norm, source_department) AS rn
    FROM (SELECT *, {ref_of(tcompact('raw_ref'))} AS key FROM (SELECT *, unnest(ref_list) AS raw_ref FROM cat)) WHERE key <> '') WHERE rn = 1)"""

ALIASES = f"""{cte('alias')},
alias_lookup AS (
  SELECT key, priority, corridor_norm FROM (
    SELECT {road('raw_value_norm')} AS key, priority, corridor_norm,
           row_number() OVER (PARTITION BY {road('raw_value_norm')} ORDER BY priority DESC, raw_value_norm) AS rn
    FROM alias) WHERE key <> '' AND rn = 1)"""


def _rules() -> str:
    cases = []
    for name, rule_refs, aliases in TRAFFIC_RULES:
        if rule_refs:
            extra = " AND (NOT list_contains(refs, 'ca 4') OR contains(txt, 'troncal del norte'))" if name.endswith("Norte") else ""
            cases.append(f"WHEN list_has_any(refs, [{', '.join(q(r) for r in rule_refs)}]){extra} THEN [{q(name)}, 'OSM_REF']")
        cases.append(f"WHEN {has('txt', aliases)} THEN [{q(name)}, 'TEXT_ALIAS']")
    return f"CASE {' '.join(cases)} END"


def resolve(texts: str, prefix: str = "") -> str:
    """CTEs resolving ``texts(street, has_city)``; the result is ``{prefix}resolved``."""
    p = prefix
    parts = (f"list_filter(list_transform(string_split({ttext('street')}, '/'), "
             f"lambda x: {words(plain('x'))}), lambda x: x <> '')")
    return f"""
{p}t0 AS (SELECT DISTINCT COALESCE(street, '') AS street, has_city FROM ({texts})),
{p}t1 AS (SELECT *, {road('street')} AS txt, {refs(ttext('street'))} AS refs, {parts} AS parts FROM {p}t0),
{p}t2 AS (SELECT *, CASE WHEN len(parts) >= 2 THEN COALESCE(list_filter(parts, lambda x: NOT regexp_matches(x, {q(REF)}))[1], parts[-1]) ELSE '' END AS aft,
           {_rules()} AS rule FROM {p}t1),
{p}ah AS (SELECT txt, arg_max({{'key': key, 'norm': corridor_norm}}, (priority, length(key), key)) AS al
       FROM (SELECT DISTINCT txt FROM {p}t2) JOIN alias_lookup ON contains(txt, key) GROUP BY txt),
{p}rh AS (SELECT street, has_city, arg_min({{'key': l.key, 'name': l.name}}, pos) AS rf
       FROM (SELECT street, has_city, unnest(refs) AS r, generate_subscripts(refs, 1) AS pos FROM {p}t2) JOIN ref_lookup l ON l.key = r
       GROUP BY ALL),
{p}t3 AS (SELECT t.*, al, rf, an.name AS after_name, sn.name AS street_name, {is_ref(tcompact("rf['name']"))} AS bare
       FROM {p}t2 t LEFT JOIN {p}ah USING (txt) LEFT JOIN {p}rh ON {p}rh.street = t.street AND {p}rh.has_city = t.has_city
       LEFT JOIN name_lookup an ON an.key = t.aft LEFT JOIN name_lookup sn ON sn.key = t.txt),
{p}t4 AS (SELECT *, (rf IS NOT NULL AND bare AND aft <> '' AND NOT {is_ref('aft')}) AS ref_bare,
           txt NOT IN ('', 'sin calle', 'calle principal', 'salida', 'entrada') AS street_ok FROM {p}t3),
{p}t5 AS (SELECT *, CASE WHEN txt = '' THEN NULL
   WHEN rule IS NOT NULL THEN [rule[1], rule[1], rule[2], 'HIGH', 'CORRIDOR_RULE_OR_REF_ALIAS']
   WHEN al IS NOT NULL THEN [al['norm'], al['norm'], 'TEXT_ALIAS_TABLE', 'HIGH', 'ALIAS_TABLE:' || al['key']]
   WHEN ref_bare AND after_name IS NOT NULL THEN [upper(rf['key']), after_name, 'OSM_NAME', 'HIGH', 'REF_WITH_OSM_NAME:' || upper(rf['key'])]
   WHEN ref_bare THEN [upper(rf['key']), {title('aft')}, 'REF_TEXT_NAME', 'HIGH', 'REF_WITH_TEXT_NAME:' || upper(rf['key'])]
   WHEN rf IS NOT NULL THEN [upper(rf['key']), rf['name'], 'OSM_REF', 'HIGH', 'OSM_REF_LOOKUP']
   WHEN after_name IS NOT NULL THEN [after_name, after_name, 'OSM_NAME', 'HIGH', 'ROAD_NAME_AFTER_REF_OSM_NAME']
   WHEN aft <> '' THEN [{title('aft')}, {title('aft')}, 'TEXT_STREET', 'MEDIUM', 'ROAD_NAME_AFTER_REF_TEXT']
   WHEN street_ok AND street_name IS NOT NULL THEN [street_name, street_name, 'OSM_NAME', 'HIGH', 'OSM_NAME_EXACT']
   WHEN street_ok THEN [{title('txt')}, {title('txt')}, 'TEXT_STREET', CASE WHEN has_city THEN 'MEDIUM' ELSE 'LOW' END, 'TEXT_STREET_NO_OSM_EXACT']
   END AS r FROM {p}t4),
{p}resolved AS (SELECT street, has_city, refs, COALESCE(r[1], '') AS corridor_candidate, COALESCE(r[2], '') AS corridor_norm,
   CASE WHEN r IS NULL THEN '' ELSE {title('txt')} END AS corridor_local_name,
   COALESCE(r[3], 'UNRESOLVED') AS corridor_match_method, COALESCE(r[4], 'UNRESOLVED') AS corridor_match_confidence,
   CASE WHEN r IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS corridor_match_status,
   COALESCE(r[5], CASE WHEN txt = '' THEN 'NO_STREET_OR_NODE_TEXT' ELSE 'GENERIC_OR_EMPTY_ROAD_TEXT' END) AS corridor_resolution_detail,
   CASE WHEN r IS NULL THEN 'UNRESOLVED' ELSE {group('r[2]', 'r[3]')} END AS corridor_group FROM {p}t5)"""


def group(corridor: str, method: str) -> str:
    n = tcompact(corridor)
    return (
        f"CASE WHEN {n} = '' THEN 'UNRESOLVED' "
        f"WHEN len(list_filter(refs, lambda x: regexp_matches(x, '^(ca|rn) '))) > 0 THEN 'NACIONAL_REGIONAL' "
        f"WHEN len(list_filter(refs, lambda x: regexp_matches(x, '^(sal|lib|sam|ahu|cab|cha|cus|lap|mor|san|son|usu) '))) > 0 THEN 'DEPARTAMENTAL_LOCAL' "
        f"WHEN {has(n, ('panamericana', 'litoral', 'comalapa', 'troncal del norte', 'ruta militar'))} THEN 'NACIONAL_REGIONAL' "
        f"WHEN {method} IN ('OSM_NAME', 'TEXT_ALIAS', 'TEXT_ALIAS_TABLE') AND {has(n, ('bulevar', 'alameda', 'avenida', 'calle', 'paseo'))} THEN 'URBANO_LOCAL' "
        f"WHEN {method} = 'NODE_CONTEXT' THEN 'CONTEXTO_NODO' WHEN {is_ref(n)} THEN 'REFERENCIA_OSM_SIN_NOMBRE' "
        f"ELSE 'LOCAL_NO_CLASIFICADO' END"
    )


CONFIDENCE = "CASE corridor_match_confidence WHEN 'HIGH' THEN 1e0 WHEN 'MEDIUM' THEN 0.66e0 WHEN 'LOW' THEN 0.33e0 ELSE 0e0 END"

# --- jams --------------------------------------------------------------------

UNIQUE = f"""{cte('jam_obs')},
uj AS (
  SELECT o.uuid, min(ts) AS ts_first, arg_min(id, (ts, id)) AS id,
         CAST(max(level) AS DOUBLE) AS level_max, median(level) AS level_median, avg(level) AS level_mean,
         CAST(max(level) - min(level) AS DOUBLE) AS level_range,
         max(delay) AS delay_max, median(delay) AS delay_median, avg(delay) AS delay_mean, stddev_pop(delay) AS delay_std,
         max(delay) - min(delay) AS delay_range,
         max(length) AS length_max, median(length) AS length_median, avg(length) AS length_mean,
         stddev_pop(length) AS length_std, max(length) - min(length) AS length_range,
         min(speedkmh) AS speed_min, median(speedkmh) AS speed_median, avg(speedkmh) AS speed_mean,
         stddev_pop(speedkmh) AS speed_std, max(speedkmh) - min(speedkmh) AS speed_range, count(*) AS records_per_uuid
  FROM jam_obs o GROUP BY o.uuid),
jam1 AS (SELECT uj.*, COALESCE(s.street, '') AS street_modal, COALESCE(c.city, '') AS city_modal,
                CAST(hour({local('ts_first')}) AS INT) AS event_hour
         FROM uj LEFT JOIN {mode_by('jam_obs', 'uuid', 'street')} s USING (uuid)
         LEFT JOIN {mode_by('jam_obs', 'uuid', 'city')} c USING (uuid))"""

JAMS = f"""{ROADS}, {ALIASES}, {UNIQUE},
{resolve("SELECT street_modal AS street, " + tcompact('city_modal') + " <> '' AS has_city FROM jam1")},
jam2 AS (SELECT j.*, r.* EXCLUDE (street, has_city), {CONFIDENCE} AS corridor_match_confidence_score,
                CASE WHEN corridor_norm = '' THEN 'UNRESOLVED' ELSE corridor_norm END AS corridor_norm_group,
                1e0 / GREATEST(speed_min, 1e0) AS low_speed_component
         FROM jam1 j JOIN resolved r ON r.street = j.street_modal AND r.has_city = ({tcompact('city_modal')} <> '')),
jam3 AS (SELECT *, delay_max/60 AS delay_min, length_max/1000 AS length_km, speed_min <= 5 AS speed_collapse_flag,
                level_max >= 4 AS severe_jam_flag, level_max = 5 AS extreme_jam_flag,
                CASE WHEN speed_min <= 2 THEN 'DETENIDO' WHEN speed_min <= 5 THEN 'CASI_DETENIDO' WHEN speed_min <= 10 THEN 'MUY_LENTO'
                     WHEN speed_min <= 20 THEN 'LENTO' ELSE 'MODERADO' END AS speed_category,
                ROUND(100 * {wsum((.30, norm('level_max', 1.0)), (.30, norm('delay_max')), (.25, norm('length_max')), (.15, norm('low_speed_component')))}, 4) AS jam_intensity_score,
                ROUND(LEAST(GREATEST(1 - ({norm('speed_range')} + {norm('delay_range')} + {norm('length_range')} + {norm('level_range', 1.0)}) / 4, 0), 1), 4) AS jam_estimation_stability,
                {norm('CAST(records_per_uuid AS DOUBLE)')} AS records_norm
         FROM jam2),
jams AS (SELECT *, delay_min * length_km AS congestion_load, delay_min / GREATEST(length_km, 0.001e0) AS delay_density,
                CASE WHEN jam_estimation_stability >= 0.8 THEN 'HIGH' WHEN jam_estimation_stability >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS jam_estimation_stability_class,
                ROUND(100 * {wsum((.35, 'records_norm'), (.40, 'jam_estimation_stability'), (.25, 'corridor_match_confidence_score'))}, 4) AS congestion_reliability_proxy
         FROM jam3)"""

JAM_PANEL = f"""{JAMS},
jam_panel AS (
  SELECT corridor_norm_group AS corridor_norm, event_hour, count(*) AS jams_count, CAST(sum(records_per_uuid) AS BIGINT) AS records_count,
         sum(delay_min) AS delay_total_min, avg(delay_min) AS delay_avg_min, sum(length_km) AS length_total_km,
         avg(length_km) AS length_avg_km, avg(speed_mean) AS avg_speed_kmh, min(speed_min) AS min_speed_kmh,
         avg(level_mean) AS level_avg, max(level_max) AS level_max, count(*) FILTER (severe_jam_flag) AS severe_jam_count,
         count(*) FILTER (extreme_jam_flag) AS extreme_jam_count, count(*) FILTER (speed_collapse_flag) AS speed_collapse_count,
         sum(congestion_load) AS congestion_load_total, avg(delay_density) AS delay_density_avg,
         sum(jam_intensity_score) AS jam_intensity_total, avg(jam_intensity_score) AS jam_intensity_avg,
         avg(jam_estimation_stability) AS estimation_stability_avg,
         count(*) FILTER (corridor_match_confidence = 'HIGH') AS high_confidence_jams,
         count(*) FILTER (corridor_match_confidence = 'MEDIUM') AS medium_confidence_jams,
         count(*) FILTER (corridor_match_confidence = 'LOW') AS low_confidence_jams,
         count(*) FILTER (corridor_match_status = 'UNRESOLVED') AS unresolved_jams
  FROM jams GROUP BY ALL)"""

JAM_SUMMARY = f"""{JAM_PANEL},
js0 AS (
  SELECT corridor_norm, CAST(sum(jams_count) AS BIGINT) AS jams_count_total, CAST(sum(records_count) AS BIGINT) AS records_count_total,
         count(DISTINCT event_hour) AS active_congestion_hours, sum(delay_total_min) AS corridor_delay_burden,
         sum(length_total_km) AS corridor_length_burden, sum(congestion_load_total) AS corridor_congestion_load,
         avg(avg_speed_kmh) AS corridor_avg_speed, min(min_speed_kmh) AS corridor_min_speed,
         CAST(sum(severe_jam_count) AS BIGINT) AS severe_jam_count_total, CAST(sum(speed_collapse_count) AS BIGINT) AS speed_collapse_count_total,
         sum(jam_intensity_total) AS jam_intensity_total, avg(estimation_stability_avg) AS estimation_stability_avg,
         CAST(sum(high_confidence_jams) AS BIGINT) AS high_confidence_jams, CAST(sum(medium_confidence_jams) AS BIGINT) AS medium_confidence_jams,
         CAST(sum(low_confidence_jams) AS BIGINT) AS low_confidence_jams, CAST(sum(unresolved_jams) AS BIGINT) AS unresolved_jams,
         arg_max(event_hour, (jam_intensity_total, -event_hour)) AS peak_congestion_hour, max(jam_intensity_total) AS peak_hour_intensity,
         stddev_pop(jam_intensity_total) AS congestion_volatility,
         sum(jam_intensity_total)/24 AS p_mean,
         sqrt((sum(pow(jam_intensity_total - 0, 2)))/24 - pow(sum(jam_intensity_total)/24, 2)) AS p_std
  FROM jam_panel GROUP BY corridor_norm),
js1 AS (SELECT *, ROUND(active_congestion_hours/24e0, 4) AS corridor_congestion_recurrence,
               ROUND(severe_jam_count_total/CAST(jams_count_total AS DOUBLE), 4) AS corridor_severe_rate,
               ROUND(speed_collapse_count_total/CAST(jams_count_total AS DOUBLE), 4) AS corridor_speed_collapse_rate,
               ROUND((high_confidence_jams + medium_confidence_jams*0.66e0 + low_confidence_jams*0.33e0)/jams_count_total, 4) AS corridor_match_confidence_avg
        FROM js0),
jam_summary AS (SELECT *, CASE WHEN corridor_norm = 'UNRESOLVED' THEN 0e0 ELSE ROUND(100 * {wsum((.25, norm('corridor_delay_burden')), (.20, norm('corridor_congestion_load')),
    (.20, norm('CAST(active_congestion_hours AS DOUBLE)', 1.0)), (.15, norm('corridor_severe_rate', 1.0)), (.10, norm('corridor_speed_collapse_rate', 1.0)),
    (.10, norm('CAST(jams_count_total AS DOUBLE)')))}, 4) END AS corridor_jam_pressure_score FROM js1)"""


def utm16(lon: str, lat: str) -> tuple[str, str]:
    """Metres in UTM zone 16 north, by the Krüger series."""
    n, lam, sin = geo._N, f"radians({lon}-({geo._LON0}))", f"sin(radians({lat}))"
    e = 2 * math.sqrt(n) / (1 + n)
    t = f"sinh(atanh({sin})-{e!r}*atanh({e!r}*{sin}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam})/sqrt(1+pow({t}, 2)))"
    x = " + ".join([eta] + [f"{a!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, a in enumerate(geo._ALPHA, 1)])
    y = " + ".join([xi] + [f"{a!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, a in enumerate(geo._ALPHA, 1)])
    return f"({geo._EASTING!r} + {geo._K0 * geo._RECT!r}*({x}))", f"({geo._K0 * geo._RECT!r}*({y}))"
