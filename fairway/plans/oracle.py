"""The same chain of tables in DuckDB's SQL, and the text of each catalogue query over it."""

from __future__ import annotations

from fairway.config import DEFAULT_TYPE, NAME_KEYWORDS, PERIODS, SHIP_TEMPLATES, SPEED_TYPES
from fairway.operators.nodes import STOP_CELL


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742000e0 * atan2(sqrt({x}), sqrt(1 - {x})))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"
    return f"((degrees(atan2({y}, {x})) + 360e0) % 360e0)"


def angle(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 360e0 - abs({a} - {b}))"


def circ(s: str, c: str) -> str:
    return f"((degrees(atan2({s}, {c})) + 360e0) % 360e0)"


def cell(x: str, g: str) -> str:
    return f"cast(trunc(({x}) / {g}) as int)"


def dist_line(p: tuple[str, str], a: tuple[str, str], b: tuple[str, str]) -> str:
    x = lambda q: f"({q[1]} * 111000 * cos(radians({q[0]})))"
    y = lambda q: f"({q[0]} * 111000)"
    dx, dy, px, py = f"({x(b)} - {x(a)})", f"({y(b)} - {y(a)})", f"({x(p)} - {x(a)})", f"({y(p)} - {y(a)})"
    t = f"(case when {dx} * {dx} + {dy} * {dy} = 0 then 0e0 else greatest(0e0, least(1e0, ({px} * {dx} + {py} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) end)"
    return f"sqrt(pow({px} - {t} * {dx}, 2) + pow({py} - {t} * {dy}, 2))"


def curve() -> str:
    x = lambda a, o: f"({o} * 111000 * cos(radians({a})))"
    p = [(x("lat0", "lon0"), "(lat0 * 111000)"), (x("lat", "lon"), "(lat * 111000)"), (x("lat2", "lon2"), "(lat2 * 111000)")]
    side = lambda i, j: f"sqrt(pow({p[j][0]} - {p[i][0]}, 2) + pow({p[j][1]} - {p[i][1]}, 2))"
    cross = f"abs(({p[1][0]} - {p[0][0]}) * ({p[2][1]} - {p[1][1]}) - ({p[1][1]} - {p[0][1]}) * ({p[2][0]} - {p[1][0]}))"
    return f"(case when {side(0, 1)} < 1e-6 or {side(1, 2)} < 1e-6 or {side(0, 2)} < 1e-6 then 0e0 else 2e0 * {cross} / ({side(0, 1)} * {side(1, 2)} * {side(0, 2)}) end)"


PERIOD = "case " + " ".join(f"when hour < {end} then '{n}'" for n, _, end in PERIODS[:-1]) + f" else '{PERIODS[-1][0]}' end"
PEAK = "(hour in (6, 7, 8, 9, 17, 18, 19))::int"
CLUSTER_CELL = f"{400 / 111_000!r}::double"
TEMPLATES = ", ".join(f"('{k}', " + ", ".join(f"{float(x)!r}::double" for x in v) + ")" for k, v in SHIP_TEMPLATES.items())
BY_NAME = "case " + " ".join(f"when contains(upper(name), '{w.upper()}') then '{k}'" for w, k in NAME_KEYWORDS) + " end"


def by_speed(x: str) -> str:
    return "case " + " ".join(f"when {x} >= {lo} and {x} < {hi} then '{k}'" for lo, hi, k in SPEED_TYPES) + f" else '{DEFAULT_TYPE}' end"


def mean_degrees(x: str) -> str:
    return f"((2 * sum(round({x} * 1e9)::bigint) + count({x})) // (2 * count({x})))::double / 1e9"


CHAIN: dict[str, str] = {
    "ais": """select concat('S', user_id::varchar) as ship_name, us, event_id as row_idx,
  round(22.5e0 + (user_id % 5) * 1e-2 + tri * 2e-3 + (event_id % 13) * 1e-5 + case when event_id % 97 = 0 then 2e-2 else 0e0 end, 6) as lat,
  round(113.3e0 + tri * 1e-3 * (1 + user_id % 3) + (event_id % 11) * 1e-5, 6) as lon, value / 1e1 as speed, ((event_id * 37) % 360)::double as course
  from (select *, case when rn % 40 < 20 then rn % 40 else 40 - rn % 40 end as tri
        from (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as rn, (epoch_us(ts) - 1704067200000000) // 30 as us from events))""",
    "ded": "select * from ais qualify row_number() over (partition by ship_name, us order by row_idx) = 1",
    "fast": "select * from ded where speed >= 0 and speed <= 30",
    "stepped": f"""select *, (us - us0) / 1e6 as dt, {hav('lat0', 'lon0', 'lat', 'lon')} as dist
  from (select *, lag(us) over w as us0, lag(lat) over w as lat0, lag(lon) over w as lon0 from fast window w as (partition by ship_name order by us, row_idx))""",
    "calm": "select ship_name, us, row_idx, lat, lon, speed, course from stepped where not coalesce(dt > 0 and dt <= 3600 and (dist > 500 or dist / dt * 1.944e0 > 30), false)",
    "lasting": "select * from calm qualify count(*) over (partition by ship_name) >= 10",
    "fenced": "select * from lasting where lat between 18 and 42 and lon between 105 and 125 and speed is not null and course is not null",
    "gapped": """select * exclude (gap), sum(gap) over (partition by ship_name order by us, row_idx rows unbounded preceding)::int as trajectory_segment
  from (select *, coalesce(((us - lag(us) over (partition by ship_name order by us, row_idx)) / 1e6 > 3600)::int, 0) as gap from fenced)""",
    "points": "select * from gapped qualify count(*) over (partition by ship_name, trajectory_segment) >= 3 or count(*) over (partition by ship_name) = 1",
    "led": """select *, lead(us) over w as us2, lead(lat) over w as lat2, lead(lon) over w as lon2, lead(speed) over w as speed2, lead(course) over w as course2,
  lag(lat) over w as lat0, lag(lon) over w as lon0, row_number() over w - 1 as i, count(*) over (partition by ship_name) as n
  from points window w as (partition by ship_name order by us, row_idx)""",
    "moved": f"""select ship_name, us, row_idx, lat as start_lat, lon as start_lon, lat2 as end_lat, lon2 as end_lon, (us2 - us) / 1e6 as time_diff, (speed + speed2) / 2 as reported_speed,
  {angle('course', 'course2')} as course_change, {hav('lat', 'lon', 'lat2', 'lon2')} as distance, {bearing('lat', 'lon', 'lat2', 'lon2')} as bearing, ((us // 3600000000) % 24)::int as hour from led""",
    "segments": f"""select *, abs(actual_speed - reported_speed) as speed_diff, {PEAK} as is_peak_hour, (((us // 86400000000) + 3) % 7 >= 5)::int as is_weekend, {PERIOD} as time_period
  from (select *, distance / time_diff * 1.944e0 as actual_speed from moved where time_diff > 0 and time_diff < 86400 and distance >= 10) where actual_speed >= 0.5""",
    "turns": f"""select ship_name, us, row_idx, lat, lon, speed, course, case when curvature > 0.001 or {angle('b_in', 'b_out')} > 30 then 'turn_point' else 'waypoint' end as type
  from (select *, {bearing('lat0', 'lon0', 'lat', 'lon')} as b_in, {bearing('lat', 'lon', 'lat2', 'lon2')} as b_out, {curve()} as curvature from led where i >= 2 and i < n - 2)""",
    "islands": f"""select * from (select ship_name, min(us) as us, arg_min(course, row(us, row_idx)) as course, arg_min(speed, row(us, row_idx)) as speed, min(row_idx) as row_idx, {mean_degrees('lat')} as lat, {mean_degrees('lon')} as lon,
  count(*) as n_points, (max(us) - min(us)) / 1e6 as duration
  from (select *, sum(edge) over (partition by ship_name order by us, row_idx rows unbounded preceding) as island
        from (select *, coalesce((slow <> lag(slow) over (partition by ship_name order by us, row_idx))::int, 1) as edge from (select *, (speed < 3)::int as slow from points)))
  where slow = 1 group by ship_name, island) where duration > 300""",
    "stops": f"""select {cell('lat', f'{STOP_CELL!r}::double')} as gl, {cell('lon', f'{STOP_CELL!r}::double')} as gn, {mean_degrees('lat')} as lat, {mean_degrees('lon')} as lon, sum(duration) as duration, count(*) as merged_count,
  arg_min(ship_name, row(ship_name, us)) as ship_name, arg_min(us, row(ship_name, us)) as us, arg_min(course, row(ship_name, us)) as course, arg_min(speed, row(ship_name, us)) as speed from islands group by 1, 2""",
    "feats": "select ship_name, us, lat, lon, speed, course, type from turns union all select ship_name, us, lat, lon, speed, course, 'stop_point' from stops",
    "celled": f"select *, {cell('lat', '5e-4')} as gl, {cell('lon', '5e-4')} as gn from feats",
    "kinds": "select gl, gn, arg_max(type, row(n, -ascii(type))) as type from (select gl, gn, type, count(*) as n from celled group by 1, 2, 3) group by 1, 2",
    "nodes": f"""select row_number() over (order by frequency desc, gl, gn) - 1 as node_id, * exclude (s, c), {circ('s', 'c')} as heading, sqrt(s * s + c * c) as heading_concentration
  from (select gl, gn, {mean_degrees('lat')} as lat, {mean_degrees('lon')} as lon, any_value(k.type) as type, count(*) as frequency, count(distinct ship_name) as ship_count, avg(sin(radians(course))) as s, avg(cos(radians(course))) as c
        from celled join kinds k using (gl, gn) group by gl, gn)""",
    "near": f"""select node_id, lat, lon, {cell('lat', '1e-3')} + a as kl, {cell('lon', '1e-3')} + b as kn from nodes, (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b)""",
    "placed": f"""select p.*, node_id, d from points p join (
    select p.ship_name, p.row_idx, arg_min(q.node_id, row({hav('p.lat', 'p.lon', 'q.lat', 'q.lon')}, q.node_id)) as node_id, min({hav('p.lat', 'p.lon', 'q.lat', 'q.lon')}) as d
    from points p join near q on {cell('p.lat', '1e-3')} = q.kl and {cell('p.lon', '1e-3')} = q.kn group by 1, 2) x using (ship_name, row_idx) where d < 500""",
    "visits": "select * exclude (before) from (select *, lag(node_id) over (partition by ship_name order by us, row_idx) as before from placed) where before is null or before <> node_id",
    "steps": f"""select * from (select ship_name, node_id as from_node, lead(node_id) over w as to_node, {hav('lat', 'lon', 'lead(lat) over w', 'lead(lon) over w')} as distance, (lead(us) over w - us) / 1e6 as seconds,
  speed, course, ((us // 3600000000) % 24)::int as hour from visits window w as (partition by ship_name order by us, row_idx)) where to_node is not null and from_node <> to_node""",
    "edges": """select least(from_node, to_node) as u, greatest(from_node, to_node) as v, count(*) as weight, count(distinct ship_name) as ship_count, avg(distance) as avg_distance, avg(seconds) as avg_time, avg(speed) as avg_speed,
  avg(course) as avg_course, count(*) filter (from_node < to_node) as forward, count(*) filter (from_node > to_node) as backward from steps group by 1, 2""",
    "strong": "select * from edges where weight >= 3",
    "ends": "select u as node, v as other from strong union all select v, u from strong",
    "degs": "select node, count(distinct other) as degree from ends group by node",
    "dens": f"select {cell('(start_lat + end_lat) / 2', '5e-3')} as gl, {cell('(start_lon + end_lon) / 2', '5e-3')} as gn, count(*) as n from segments group by 1, 2",
    "node_density": f"""select node_id, coalesce(avg(d.n), 0) as density from (select node_id, {cell('lat', '5e-3')} + a as kl, {cell('lon', '5e-3')} + b as kn from nodes, (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b)) x
  left join dens d on d.gl = kl and d.gn = kn group by node_id""",
    "from_end": f"""select s.ship_name, s.row_idx, arg_min(q.node_id, row({hav('s.start_lat', 's.start_lon', 'q.lat', 'q.lon')}, q.node_id)) as u, min({hav('s.start_lat', 's.start_lon', 'q.lat', 'q.lon')}) as du
  from segments s join near q on {cell('s.start_lat', '1e-3')} = q.kl and {cell('s.start_lon', '1e-3')} = q.kn group by 1, 2""",
    "to_end": f"""select s.ship_name, s.row_idx, arg_min(q.node_id, row({hav('s.end_lat', 's.end_lon', 'q.lat', 'q.lon')}, q.node_id)) as v, min({hav('s.end_lat', 's.end_lon', 'q.lat', 'q.lon')}) as dv
  from segments s join near q on {cell('s.end_lat', '1e-3')} = q.kl and {cell('s.end_lon', '1e-3')} = q.kn group by 1, 2""",
    "mapped": "select s.*, u, v from segments s join from_end using (ship_name, row_idx) join to_end using (ship_name, row_idx) where du < 500 and dv < 500 and u <> v",
    "directed": "select distinct u, v from mapped",
    "mids": "select u, v, (a.lat + b.lat) / 2 as lat, (a.lon + b.lon) / 2 as lon from directed join nodes a on a.node_id = u join nodes b on b.node_id = v",
    "edge_density": f"""select u, v, coalesce(avg(d.n), 0) as density from (select u, v, {cell('lat', '5e-3')} + a as kl, {cell('lon', '5e-3')} + b as kn from mids, (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b)) x
  left join dens d on d.gl = kl and d.gn = kn group by u, v""",
    "waterway": "select u, v, density, case when density >= (select quantile_cont(density, 0.75) from node_density) then 'narrow' else 'open' end as waterway_type from edge_density",
    "stats": """select * exclude (diff), greatest(0e0, 1 - diff / greatest(avg_reported_speed, avg_actual_speed, 1e-6)) as speed_reliability from (
  select u, v, count(*) as segment_count, avg(distance) as avg_distance, avg(time_diff) as avg_travel_time, stddev_pop(time_diff) as std_travel_time, min(time_diff) as min_travel_time, max(time_diff) as max_travel_time,
  median(time_diff) as median_travel_time, avg(actual_speed) as avg_actual_speed, stddev_pop(actual_speed) as std_actual_speed, avg(reported_speed) as avg_reported_speed, avg(speed_diff) as diff from mapped group by u, v)""",
    "efeats": "select s.*, waterway_type from stats s join waterway using (u, v)",
    "periods": """select p.*, avg_time / whole as weight_ratio from (select u, v, time_period, avg(time_diff) as avg_time, stddev_pop(time_diff) as std_time, count(*) as sample_count from mapped group by 1, 2, 3) p
  join (select u, v, avg(time_diff) as whole from mapped group by 1, 2) using (u, v)""",
    "octs": "select u, v, (floor(bearing / 45e0)::int % 8) as octant, count(*) as n from mapped group by 1, 2, 3",
    "hours": f"select u, v, hour, {PERIOD} as time_period, edge_mean from (select u, v, avg(time_diff) as edge_mean from mapped group by 1, 2), (select unnest(range(24))::int as hour)",
    "filled": """select h.u, h.v, h.hour, coalesce(n, 0) as n,
  case when n >= 2 then hour_mean when n = 1 then 0.7e0 * hour_mean + 0.3e0 * edge_mean when pn >= 2 then period_mean else edge_mean end as predicted_time,
  case when n >= 2 then 'hour' when n = 1 then 'blend' when pn >= 2 then 'period' else 'model' end as source
  from hours h left join (select u, v, hour, count(*) as n, avg(time_diff) as hour_mean from mapped group by 1, 2, 3) a using (u, v, hour)
  left join (select u, v, time_period, count(*) as pn, avg(time_diff) as period_mean from mapped group by 1, 2, 3) b using (u, v, time_period)""",
    "templates": f"""select *, case when draft > 10 or tonnage > 50000 then 'high' when draft > 5 or tonnage > 10000 then 'medium' else 'low' end as risk_level, least(greatest(1 - length / 400e0, 0.1e0), 1e0) as maneuverability
  from (values {TEMPLATES}) as t(ship_type, length, width, draft, height, tonnage, max_speed)""",
    "limits": """select u, v, case when waterway_type <> 'narrow' then 15e0 when avg_distance < 200 then 6e0 else 8e0 end as depth, case when waterway_type <> 'narrow' then 120e0 when avg_distance < 200 then 40e0 else 60e0 end as channel_width,
  case when waterway_type <> 'narrow' then 60e0 when avg_distance < 200 then 20e0 else 30e0 end as clearance from efeats""",
    "passable": """select *, reason is null as passable from (select *, case when draft > depth * 1.2e0 then 'draft' when height > clearance * 1.2e0 then 'height' when width > channel_width * 1.2e0 then 'width' end as reason from limits, templates)""",
    "risks": """select u, v, ship_type, least(greatest(
  case when depth - draft < 2 then 40 - (depth - draft) * 10 when depth - draft < 5 then 20 + (5 - (depth - draft)) * 2 else 10 end
  + case when clearance - height < 10 then 20 when clearance - height < 20 then 10 else 0 end + case when channel_width - width < 20 then 15 when channel_width - width < 40 then 5 else 0 end
  + case when waterway_type = 'narrow' then 20 else 0 end + case when segment_count < 10 then 10 when segment_count < 50 then 5 else 0 end + case when avg_actual_speed < 3 then 10 when avg_actual_speed < 5 then 5 else 0 end
  + case risk_level when 'high' then 15 when 'medium' then 5 else 0 end, 0), 100)::double as risk from limits join efeats using (u, v), templates""",
    "both_ways": "select u, v, weight, avg_distance, avg_time from strong union all select v, u, weight, avg_distance, avg_time from strong",
    "hcl": f"""select *, count(*) over (partition by cl, cn, co) < 2 as is_noise from (
  select *, {cell('lat', CLUSTER_CELL)} as cl, cast(trunc(lon / ({CLUSTER_CELL} / cos(radians((select avg(lat) from nodes))))) as int) as cn, case when heading_concentration > 0.3 then floor(heading / 45e0)::int % 8 else -1 end as co from nodes)""",
    "hcl_type": "select cl, cn, co, arg_max(type, row(f, -ascii(type))) as type, coalesce(sum(f) filter (type = 'stop_point'), 0) as stop_frequency from (select cl, cn, co, type, sum(frequency) as f from hcl where not is_noise group by 1, 2, 3, 4) group by 1, 2, 3",
    "clusters": f"""select node_id, lat, lon, type, frequency, ship_count, node_count, stop_frequency, {circ('s', 'c')} as heading, sqrt(s * s + c * c) as heading_concentration, false as is_noise
  from (select cl, cn, co, min(node_id) as node_id, sum(frequency) as frequency, count(*) as node_count, sum(ship_count) as ship_count, sum(frequency * lat) / sum(frequency) as lat, sum(frequency * lon) / sum(frequency) as lon,
        sum(frequency * sin(radians(heading))) / sum(frequency) as s, sum(frequency * cos(radians(heading))) / sum(frequency) as c from hcl where not is_noise group by 1, 2, 3) join hcl_type using (cl, cn, co)
  union all select node_id, lat, lon, type, frequency, ship_count, 1, case when type = 'stop_point' then frequency else 0 end, heading, heading_concentration, true from hcl where is_noise""",
    "targets": f"""select s.node_id as small, l.node_id as large, {hav('s.lat', 's.lon', 'l.lat', 'l.lon')} as dist from clusters s, clusters l
  where s.node_count < 2 and l.node_count >= 2 and {hav('s.lat', 's.lon', 'l.lat', 'l.lon')} < 400
  qualify row_number() over (partition by s.node_id order by (s.type <> l.type)::int, round({hav('s.lat', 's.lon', 'l.lat', 'l.lon')}, 6), l.node_id) = 1""",
}


def needed(text: str) -> list[str]:
    """Names of the chain that a text uses, with what those use, in order."""
    import re

    want: set[str] = set()

    def visit(t: str) -> None:
        for w in set(re.findall(r"[a-z_]+", t)):
            if w in CHAIN and w not in want:
                want.add(w)
                visit(CHAIN[w])

    visit(text)
    return [n for n in CHAIN if n in want]


def sql(text: str, *extra: str, recursive: bool = False) -> str:
    """A query over the chain; ``extra`` are further common table expressions."""
    parts = [f"{n} as (\n  {CHAIN[n]})" for n in needed(" ".join([text, *extra]))] + list(extra)
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" + text) if parts else text
