import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import all_queries
from corridor_spark.operators.cell_index import nearest_indexed, open_cells, write_cells
from corridor_spark.operators.nearest import LOCAL, nearest, spread_pieces
from corridor_spark.plans import incidents as incident_plan
from corridor_spark.plans.alerts import prepare
from corridor_spark.plans.jams import unique_jams
from corridor_spark.session import fits, stage, stage_root
from corridor_spark.sources import envelopes, incidents, kml, road_store, roads, sinks, traffic
from corridor_spark.streaming import windows

SF = "/root/testdata/sf0.001"


def test_jam_and_alert_envelopes(spark, tmp_path):
    jam = {"uuid": "u", "id": "1", "ts": "2026-06-29T05:00:00Z", "street": "CA-1", "level": 3, "delay": 60.0, "length": 500.0, "speedKMH": 7.0}
    (tmp_path / "jams.json").write_text(json.dumps({"source": "x", "records": [jam, {**jam, "id": "2", "level": 5}]}))
    (tmp_path / "lines.json").write_text(json.dumps(jam) + "\n")
    row = unique_jams(traffic.read_jams(spark, str(tmp_path / "jams.json"))).first()
    assert (row["level_max"], row["speed_min"], row["event_hour"]) == (5.0, 7.0, 23)
    assert traffic.read_jams(spark, str(tmp_path / "lines.json"), lines=True).count() == 1
    assert traffic.read_jams(spark, str(tmp_path / "jams.json"), split=True).collect() == traffic.read_jams(spark, str(tmp_path / "jams.json")).collect()
    assert traffic.read_metadata(spark, str(tmp_path / "jams.json")).first()["source"] == "x"
    alert = {"uuid": "a", "ts": "2026-06-29T05:00:00Z", "type": "JAM", "geoWKT": "Point(-89.2 13.7)", "cluster_center_lon": -89.2, "cluster_center_lat": 13.7,
             "cluster_start_ts": "2026-06-29T04:00:00Z", "cluster_last_ts": "2026-06-29T05:30:00Z", "cluster_report_count": 4}
    (tmp_path / "alerts.json").write_text(json.dumps({"records": [alert]}))
    got = prepare(traffic.read_alerts(spark, str(tmp_path / "alerts.json")).withColumnRenamed("geoWKT", "geowkt")).first()
    assert got["has_valid_coordinate"] and got["cluster_duration_min"] == 90.0 and got["geo_cluster_distance_m"] == 0.0


@pytest.mark.parametrize("block, indent", [(300, None), (1 << 27, 1)])
def test_envelopes_read_by_many_tasks(spark, tmp_path, block, indent):
    odd = ["", 'a "quoted" } brace', "{[", "]}", "\\", '\\"}', "ñ}é", '"records": [', "line\nbreak }, {"]
    one = [{"uuid": f"a{i}", "street": odd[i % len(odd)] * (i % 4), "level": i, "more": [{"x": odd[(i + 1) % len(odd)]}, {}] * (i % 3), "none": {}} for i in range(24)]
    two = [{"uuid": f"b{i}", "level": None} for i in range(8)]
    head = {"meta": {"records": [{"uuid": "not this"}], "q": odd}, "list": [[1, {"records": [{}]}], {}, "in } a string"]}
    (tmp_path / "in").mkdir()
    for name, table in {"one": {**head, "records": one, "end": [{"uuid": "nor this"}]}, "two": {"records": two}, "three": {"records": []},
                        "four": {"other": one[:3]}, "five": {"a": 5, "records": [], "z": {"y": [{}]}}}.items():
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(table, indent=indent, ensure_ascii=bool(indent)))
    schema = "uuid string, street string, level int, more array<struct<x: string>>"
    want = spark.read.schema(f"records array<struct<{schema.replace(' string,', ': string,').replace(' int,', ': int,').replace('more ', 'more: ')}>>").option("multiLine", True)
    want = sorted(map(repr, want.json(str(tmp_path / "in")).select(F.explode("records").alias("r")).select("r.*").collect()))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        assert block > 800 or spark.read.option("lineSep", "}").text(str(tmp_path / "in" / "one.json")).rdd.getNumPartitions() > 1
        assert sorted(map(repr, envelopes.records(spark, str(tmp_path / "in"), schema).collect())) == want and len(want) == 32
        got = envelopes.heads(spark, str(tmp_path / "in"), "a int, end array<struct<uuid: string>>, z struct<y: array<struct<x: string>>>").collect()
        assert sorted((r["a"], len(r["end"] or []), len(r["z"]["y"]) if r["z"] else 0) if r["a"] else (0, len(r["end"] or []), 0) for r in got) == [
            (0, 0, 0), (0, 0, 0), (0, 1, 0), (5, 0, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_envelopes_that_break_off_or_hold_no_objects(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"records": [{"a": 1}, {"a": 2, "b": {"c": 3}}, {"a": 4, "b": {"c": 5}')
    (tmp_path / "mixed.json").write_text('{"records": [null, {"a": 6}, 7, {"a": 8}, null], "x": {"a": 9}}')
    (tmp_path / "blank.json").write_text("")
    read = lambda name: sorted(r["a"] for r in envelopes.records(spark, str(tmp_path / name), "a int").collect())
    assert read("cut.json") == [1, 2] and read("mixed.json") == [6, 8] and read("blank.json") == []


def test_incident_csv_keeps_blanks(spark, tmp_path):
    (tmp_path / "i.csv").write_text('uuid,address,observation\n1,,"linea uno\nlinea ""dos"""\n2,nan,x\n')
    rows = {r["uuid"]: r for r in incidents.read_incidents(spark, str(tmp_path / "i.csv")).collect()}
    assert rows["1"]["address"] == "" and rows["1"]["observation"] == 'linea uno\nlinea "dos"' and rows["2"]["address"] == "nan"


def test_network_json_and_features(spark, tmp_path):
    way = {"type": "way", "id": 7, "tags": {"name": "Avenida Sur", "highway": "primary"}, "geometry": [{"lat": 13.7, "lon": -89.2}, {"lat": 13.7, "lon": -89.19}, {"lat": 13.71, "lon": -89.19}]}
    (tmp_path / "n.json").write_text(json.dumps({"elements": [way, {"type": "node", "id": 1}, {**way, "id": 8, "geometry": way["geometry"][:1]}]}))
    segs = roads.read_network(spark, str(tmp_path / "n.json"), "SAN SALVADOR", "san_salvador", "bbox")
    row = segs.first()
    assert segs.count() == 1 and row["vertices"] == 3 and row["road_key_norm"] == "avenida sur" and 2100 < row["length_m"] < 2300
    assert roads.pieces(segs, ["name"]).count() == 2
    split = roads.read_network(spark, str(tmp_path / "n.json"), "SAN SALVADOR", "san_salvador", "bbox", split=True)
    assert split.collect() == segs.collect()
    sinks.write_features(sinks.line_features(segs, ["osm_way_id", "name"]), str(tmp_path / "out"))
    feature = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert feature["geometry"]["type"] == "LineString" and feature["properties"]["osm_way_id"] == 7
    points = spark.createDataFrame([(1, -89.2, 13.7), (2, None, 13.7)], "uuid int, lon double, lat double")
    assert sinks.point_features(points, "lon", "lat", ["uuid"]).count() == 1
    sinks.write_tables({"t": points.withColumn("a", F.array(F.lit("x"), F.lit("y")))}, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/t")).first()["a"] == "x;y"


def test_kml_lines(spark, tmp_path):
    doc = ('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>R1</name><styleUrl>#s</styleUrl><LineString><coordinates>-89.2,13.7,0 -89.1,13.7,0</coordinates></LineString></Placemark>'
           "<Placemark><name>R2</name><MultiGeometry><LineString><coordinates>-89,13 -88,13</coordinates></LineString><LineString><coordinates>bad</coordinates></LineString></MultiGeometry></Placemark></Document></kml>")
    (tmp_path / "r.kml").write_text(doc)
    lines = kml.read_kml(spark, str(tmp_path / "r.kml"))
    assert sorted(r["name"] for r in lines.collect()) == ["R1", "R2"]
    assert kml.road_stats(lines).first()["vertices"] == 4 and kml.styles(lines).first()["lines"] == 1


def test_departments_by_any_spelling():
    assert [d[0] for d in roads.select_departments(["Cabañas", "la_union"])] == ["cabanas", "la_union"]
    assert len(roads.select_departments([])) == 14


def test_stage_and_fits(spark):
    df = stage(spark.range(10), "t")
    assert df.count() == 10 and fits(df, 10) and not fits(df, 9)


def _stream(spark, tmp_path, rows, schema):
    batch = spark.createDataFrame(rows, schema)
    for i, part in enumerate(batch.randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return windows.read_stream(spark, f"{tmp_path}/in/*", batch.schema), batch


JAM_STREAM = "uuid string, id string, ts string, level int, delay double, length double, speedkmh double"


def test_running_jams_count_repeats_once(spark, tmp_path):
    rows = [("u", str(i % 20), f"2026-06-29 0{i % 5}:00:00", i % 20, float(i % 20), 100.0, 5.0) for i in range(40)]
    stream, _ = _stream(spark, tmp_path, rows, JAM_STREAM)
    jams = windows.jam_measures(windows.drain(windows.running_jams(stream), f"{tmp_path}/out", ["uuid", "frame"])).collect()
    assert [(r["records_per_uuid"], r["level_max"], r["level_mean"], r["time_period"]) for r in jams] == [(20, 19, 9.5, jams[0]["time_period"])]


def test_latest_snapshot_stream(spark, tmp_path):
    rows = [("m", f"2026-06-29 0{h}:00:00", float(h)) for h in range(8)] + [("quiet", "2026-06-29 00:30:00", None)]
    stream, _ = _stream(spark, tmp_path, rows, "mention string, ts string, likes double")
    frames = windows.drain(windows.latest_snapshots(stream, ["mention"], ["likes"]), f"{tmp_path}/out", ["mention", "frame"])
    newest = windows.newest_of(frames, ["mention"], ["likes"])
    assert {r["mention"]: (r["likes"], r["snapshots"]) for r in newest.collect()} == {"m": (7.0, 8), "quiet": (None, 1)}


def test_states_are_not_cut_at_midnight(spark, tmp_path):
    rows = [("u", str(i), f"2026-06-{29 + i // 2} {'23' if i < 2 else '00'}:5{i}:00", i, float(i), 100.0, 5.0) for i in range(4)]
    stream, _ = _stream(spark, tmp_path, rows, JAM_STREAM)
    jams = windows.jam_measures(windows.drain(windows.running_jams(stream), f"{tmp_path}/jams", ["uuid", "frame"])).collect()
    assert [(r["uuid"], r["records_per_uuid"], r["level_max"]) for r in jams] == [("u", 4, 3)]
    newest = windows.newest_of(windows.drain(windows.latest_snapshots(stream, ["uuid"], ["level"]), f"{tmp_path}/newest", ["uuid", "frame"]), ["uuid"], ["level"])
    assert [(r["level"], r["snapshots"]) for r in newest.collect()] == [(3, 4)]


def test_running_state_ends_and_restarts(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, JAM_STREAM).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def jam(uuid, number, ts, level):
        return (uuid, f"{uuid}-{number}", f"2026-06-29 {ts}", level, float(level), None, 5.0)

    schema = spark.createDataFrame([], JAM_STREAM).schema

    def measures():
        stream = windows.running_jams(windows.read_stream(spark, f"{tmp_path}/in/*", schema))
        frames = windows.drain(stream, f"{tmp_path}/out", ["uuid", "frame"])
        return {r["uuid"]: (r["records_per_uuid"], r["level_max"], r["level_mean"], r["length_max"]) for r in windows.jam_measures(frames).collect()}

    put("a", [jam(f"j{i}", 0, "00:05:00", 2) for i in range(50)])
    assert measures() == {f"j{i}": (1, 2, 2.0, None) for i in range(50)}
    assert len(measures()) == 50  # nothing new: the same result
    put("b", [jam("j0", 1, "00:10:00", 4), jam("k", 0, "09:00:00", 5)])
    assert measures()["j0"] == (2, 4, 3.0, None)  # an open frame goes on after the restart
    put("c", [jam("j1", 9, "00:20:00", 5), jam("j0", 2, "09:10:00", 3), jam("j0", 2, "09:10:00", 3)])
    found = measures()
    assert found["j1"] == (1, 2, 2.0, None)  # later than the watermark: left out
    assert found["j0"] == (3, 4, 3.0, None) and len(found) == 51  # back after its state had gone, the repeat once
    stream = windows.running_jams(windows.read_stream(spark, f"{tmp_path}/in/*", schema))
    put("d", [jam("k", 1, "09:20:00", 1)])
    query = windows.each_batch(stream, lambda df, n: df.write.format("noop").mode("overwrite").save(), f"{tmp_path}/out/_state")
    query.awaitTermination()
    sizes = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"] if "stateStoreSave" in op["operatorName"]]
    assert max(sizes) == 2  # j0 and k from nine o'clock; nothing of the 50 quiet jams


def test_stream_ranking_does_not_depend_on_batches(spark, tmp_path):
    rows = [(f"2026-06-29 0{i // 40}:{i % 40 + 10}:00", f"c{i % 7}", ("jam", "alert", "news")[i % 3], float(i % 11), float(i % 5), float(i % 13), float(i % 17)) for i in range(200)]
    schema = "ts string, corridor_key string, source string, delay_min double, congestion_load double, jam_intensity double, impact double"
    for i in range(5):  # files in the order of time
        spark.createDataFrame(rows[i * 40 : i * 40 + 40], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    seen = []
    for files in (1, 100):
        stream = windows.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, files=files)
        totals = windows.drain(windows.source_totals(stream), f"{tmp_path}/out{files}", ["window_end", "corridor_key"])
        seen.append(sorted(map(tuple, windows.rank_windows(totals).collect())))
    assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == 23  # the windows still open included


def test_nearest_in_flight(spark, tmp_path):
    pieces = spark.createDataFrame([(1, -89.2, 13.7, -89.19, 13.7)], "way_id long, ax double, ay double, bx double, by_ double")
    rows = [(i, "2026-06-29 01:00:00", -89.2 + i / 1000, 13.7001) for i in range(9)]
    stream, batch = _stream(spark, tmp_path, rows, "point_id long, ts string, x double, y double")
    index = write_cells(pieces, f"{tmp_path}/index", (200.0, 2000.0), ["way_id"])
    folders = set(os.listdir(stage_root(spark))) if os.path.isdir(stage_root(spark)) else set()
    windows.each_batch(stream, windows.nearest_in_batch(index, f"{tmp_path}/out", ["way_id"]), f"{tmp_path}/ck", "append").awaitTermination()
    assert not os.path.isdir(stage_root(spark)) or set(os.listdir(stage_root(spark))) == folders  # a batch leaves nothing behind
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("point_id", F.round("distance_m", 4)).collect()))
    want = sorted(map(tuple, nearest(batch, pieces, (200.0, 2000.0), ["way_id"]).select("point_id", F.round("distance_m", 4)).collect()))
    assert got == want and len(got) == 9


def test_cell_index_equals_nearest(spark, tmp_path):
    ways = [(i, -89.5 + (i * 37 % 101) / 100, 13.3 + (i * 53 % 97) / 100, -89.5 + (i * 37 % 101) / 100 + 0.004, 13.3 + (i * 53 % 97) / 100 + 0.003) for i in range(300)]
    ways += [(900 + i, *ways[0][1:]) for i in range(20)]  # the same line many times: ties go to the smallest id
    pieces = spark.createDataFrame(ways, "way_id long, ax double, ay double, bx double, by_ double").repartition(3)
    points = [(i, -89.5 + (i * 29 % 211) / 200, 13.3 + (i * 31 % 199) / 200) for i in range(150)]
    points += [(500, None, 13.5), (501, -89.4, None), (502, float("nan"), 13.5), (503, float("inf"), 13.5), (504, 10.0, 89.9), (505, *ways[0][1:3]), (506, *ways[0][1:3])]
    df = spark.createDataFrame(points, "point_id long, x double, y double")
    radii = (300.0, 3000.0)
    write_cells(pieces, f"{tmp_path}/i", radii, ["way_id"], tiles=16)
    index = open_cells(spark, f"{tmp_path}/i")
    shown = lambda rows: sorted((r["point_id"], r["way_id"], round(r["distance_m"], 4)) for r in rows.collect())
    want = shown(nearest(df.filter("abs(x) < 180"), pieces, radii, ["way_id"]))
    assert shown(nearest_indexed(df, index, ["way_id"])) == want and {(505, 0, 0.0), (506, 0, 0.0)} <= set(want)
    assert shown(nearest_indexed(df, index, ["way_id"], batch_points=3)) == want  # more points than are sent to the tasks
    assert nearest_indexed(df.limit(0), index, ["way_id"]).count() == 0
    assert nearest_indexed(df, write_cells(pieces.limit(0), f"{tmp_path}/none", radii, ["way_id"]), ["way_id"]).count() == 0
    few = nearest_indexed(df.limit(2), index, ["way_id"])
    few.collect()
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString()


def test_cell_index_makes_no_pairs_that_lose(spark, tmp_path):
    """A piece is listed a few times a radius, and of a crowded place's pairs only the winning ones leave a block."""
    ways = [(i % 390, -89.2 + i * 1e-5, 13.7 + (i * 7 % 400) * 1e-5, -89.2 + i * 1e-5 + 1e-3, 13.7 + (i * 7 % 400) * 1e-5 + 1e-3) for i in range(400)]
    odd = [(5000, float("nan"), 13.7, -89.2, 13.7), (5001, -89.2, 13.7, None, 13.7)]
    pieces = spark.createDataFrame(ways + odd, "way_id long, ax double, ay double, bx double, by_ double")
    points = [(i, -89.2 + i * 1.3e-5, 13.7 + (i * 11 % 300) * 1e-5) for i in range(300)] + [(7, -89.2, 13.7)]
    df = spark.createDataFrame(points, "point_id long, x double, y double")
    index = write_cells(pieces, f"{tmp_path}/i", (200.0, 2000.0), ["way_id"])
    assert spark.read.parquet(f"{tmp_path}/i/cells").count() <= 2 * 4 * 401
    want = {}
    for point, x, y in points:
        scale = 111_320.0 * math.cos(math.radians(y))
        for way, ax, ay, bx, by in ways:
            dx, dy, qx, qy = (bx - ax) * scale, (by - ay) * 111_320.0, (x - ax) * scale, (y - ay) * 111_320.0
            t = max(0.0, min(1.0, (qx * dx + qy * dy) / (dx * dx + dy * dy)))
            d = math.hypot(qx - t * dx, qy - t * dy)
            want[point] = min(want.get(point, (math.inf, 0)), (round(d, 6), way))
    for cell_pairs in (2_500_000_000, 900):  # whole cells, and blocks of 30 rows
        got = nearest_indexed(df, index, ["way_id"], cell_pairs=cell_pairs)
        assert {r["point_id"]: r["way_id"] for r in got.collect()} == {p: w for p, (_, w) in want.items()} and got.count() == len(want)


def test_cell_index_of_an_earlier_form(spark, tmp_path):
    """An index whose cells are a radius wide and that names no side of its tiles is read as it was written."""
    pieces = spark.createDataFrame([(i, -89.5 + i / 50, 13.3, -89.49 + i / 50, 13.31) for i in range(40)], "way_id long, ax double, ay double, bx double, by_ double")
    points = spark.createDataFrame([(i, -89.5 + i / 90, 13.3 + i % 5 / 400) for i in range(70)], "point_id long, x double, y double")
    rx, ry = LOCAL.reach(500.0, 13.4)
    tile = F.pmod(F.xxhash64(F.floor(F.col("_cx") / 64), F.floor(F.col("_cy") / 64)), F.lit(8)).cast("int")
    cells = spread_pieces(pieces, rx, ry).withColumns({"step": F.lit(0), "tile": tile})
    cells.write.partitionBy("step", "tile").parquet(f"{tmp_path}/i/cells")
    columns = ", ".join(f"`{name}` {kind}" for name, kind in cells.dtypes)
    spark.createDataFrame([(0, 500.0, rx, ry, 8, columns)], "step int, radius double, rx double, ry double, tiles int, columns string").write.parquet(f"{tmp_path}/i/steps")
    shown = lambda rows: sorted((r["point_id"], r["way_id"], round(r["distance_m"], 4)) for r in rows.collect())
    want = shown(nearest(points, pieces, (500.0,), ["way_id"]))
    assert shown(nearest_indexed(points, open_cells(spark, f"{tmp_path}/i"), ["way_id"])) == want and len(want) > 20


def test_stage_root_is_shared_setting(spark):
    assert "corridor_spark" in stage_root(spark)


ORACLE_SAMPLE = ("unique_jams", "top_corridors", "nearest_road", "dense_panel", "lag_analysis", "event_score", "road_phrases", "operational_topk", "moving_window")


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_small_scale_oracle(spark, name):
    from check import TABLES, canon

    queries, oracles = all_queries()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = [r.asDict() for r in queries[name](spark, SF).collect()]
    cursor = con.execute(oracles[name])
    head = [d[0] for d in cursor.description]
    assert canon(got) == canon([dict(zip(head, r)) for r in cursor.fetchall()])


def _store(spark, path, **networks):
    schema = "osm_way_id long, name string, highway string, source_department string, coords array<array<double>>"

    def segs(rows):
        return roads.segments(spark.createDataFrame([(i, n, "primary", d, [[x, 13.7], [x + 0.001, 13.7]]) for i, n, d, x in rows], schema))

    road_store.write_store(path, **{name: segs(rows) for name, rows in networks.items()})
    return road_store.open_store(spark, path)


def _points(spark, rows):
    return spark.createDataFrame([(u, d, x, y, True, True, capital, "VALID_POINT") for u, d, x, y, capital in rows],
                                 "uuid string, department_norm string, longitude_num double, latitude_num double, coordinate_pair_present boolean, "
                                 "coordinate_inside_sv_bbox boolean, coordinate_inside_amss_bbox boolean, coordinate_quality_status string")


def _scopes(df):
    return {r["uuid"]: (r["nearest_osm_source_scope"], r["nearest_osm_way_id"]) for r in df.collect()}


def test_store_cascade_takes_department_national_capital(spark, tmp_path):
    own, whole, capital = [(1, "Calle Uno", "01", -89.2)], [(1, "Calle Uno", "01", -89.2), (2, "Calle Dos", "02", -89.21), (2, "Calle Dos", "03", -89.21)], [(3, "Calle Tres", "", -89.205)]
    points = _points(spark, [("own", "01", -89.21, 13.7, True), ("other", "02", -89.21, 13.7, True), ("blank", None, -89.204, 13.7, False), ("far", "01", -88.2, 13.7, False)])
    full = _store(spark, f"{tmp_path}/a", departments=own, whole=whole, capital=capital)
    assert full.filter("network = 'NATIONAL'").count() == 2 and full.filter("source_department = '01'").count() == 2  # '01' stays text
    assert _scopes(incident_plan.nearest_stored(points, full)) == {
        "own": ("DEPARTMENT", 1), "other": ("NATIONAL", 2), "blank": ("NATIONAL", 1), "far": ("DEPARTMENT", None)}
    city = _store(spark, f"{tmp_path}/b", departments=own, capital=capital)
    assert _scopes(incident_plan.nearest_stored(points, city)) == {
        "own": ("DEPARTMENT", 1), "other": ("AMSS", 3), "blank": ("NO_OSM_NETWORK", None), "far": ("DEPARTMENT", None)}
    none = incident_plan.nearest_stored(points.filter("uuid = 'blank'"), city).first()
    assert (none["osm_match_status"], none["nearest_osm_distance_m"]) == ("NO_OSM_NETWORK_FOR_POINT", None)
    with pytest.raises(ValueError):
        road_store.write_store(f"{tmp_path}/c")
    empty = _store(spark, f"{tmp_path}/d", departments=[], whole=[])
    assert {s for s, _ in _scopes(incident_plan.nearest_stored(points, empty)).values()} == {"NO_OSM_NETWORK"}
    assert road_store.stored_roads(empty, spark.createDataFrame([("x",)], "corridor_key string")).count() == 0


def test_store_reads_only_what_a_query_names(spark, tmp_path):
    rows = [(i, f"Calle {i % 7}", str(i % 5), -89.2 + i / 1000) for i in range(70)]
    store = _store(spark, f"{tmp_path}/s", departments=rows, whole=rows)

    def plan_of(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    two = road_store.network(store, "DEPARTMENT", ["1", "3"])
    names = [r[0] for r in two.select(F.input_file_name()).distinct().collect()]
    assert two.count() == 28 and {f.split("source_department=")[1][0] for f in names} == {"1", "3"}
    assert "source_department" in plan_of(two).split("PartitionFilters: [")[1].split("]")[0]
    named = spark.createDataFrame([("2", "p"), (None, "q"), ("9", "r")], "source_department string, point_id string")
    found = road_store.departments_of(named, store)
    assert found.count() == 14 and "dynamicpruning" in plan_of(found)
    keys = spark.createDataFrame([("calle 3",), (None,), ("",), ("none",)], "corridor_key string")
    found = road_store.stored_roads(store, keys)
    assert sorted(r["osm_way_id"] for r in found.collect()) == [i for i in range(70) if i % 7 == 3] and "dynamicpruning" in plan_of(found)
    assert road_store.select_segments(store, ["4", "8"]).count() == 14  # one of the two has a network
    assert road_store.select_segments(store, ["8"]).count() == 70  # none has: the national one
    assert road_store.select_segments(store).count() == 0  # neither departments nor a capital network
