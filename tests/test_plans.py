import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corridor_spark.operators.tables import empty_like
from corridor_spark.operators.similar import candidates
from corridor_spark.plans import associate, evaluate, incidents, integrate, jams, resolve, studies
from corridor_spark.sources import aliases, incidents as source, roads


@pytest.fixture(scope="module")
def lookups(spark):
    ways = [(1, "Avenida Bernal", "", "primary", "A", 0.010), (2, "Carretera Vieja", "CA-9", "trunk", "A", 0.020),
            (3, "", "LIB-15", "secondary", "B", 0.015)]
    segs = roads.segments(spark.createDataFrame(ways, "osm_way_id long, name string, ref string, highway string, source_department string, d double")
                          .withColumn("coords", F.array(F.array(F.lit(-89.2), F.lit(13.7)), F.array(F.lit(-89.2) + F.col("d"), F.lit(13.7)))))
    catalog = roads.road_catalog(segs)
    alias = spark.createDataFrame([("mercado viejo", "Corredor Mercado", "URBANO_LOCAL", "VIA_URBANA", 90.0), ("mercado", "Otro", "", "", 50.0)],
                                  "raw_value string, corridor_norm string, corridor_group string, road_scope string, priority double")
    return resolve.Lookups(roads.name_lookup(catalog), roads.ref_lookup(catalog), aliases.alias_lookup(alias))


CASES = [
    ("CA-1", "", "", "x", "Carretera Panamericana", "OSM_REF", "HIGH"),
    ("CA-4 Norte", "", "", "x", "CA 4 Norte", "TEXT_STREET", "MEDIUM"),
    ("Troncal del Norte CA-4", "", "", "x", "Carretera Troncal del Norte", "OSM_REF", "HIGH"),
    ("zona mercado viejo", "", "", "x", "Corredor Mercado", "TEXT_ALIAS_TABLE", "HIGH"),
    ("CA-9", "", "", "x", "Carretera Vieja", "OSM_REF", "HIGH"),
    ("LIB 15 / Calle Sol", "", "", "x", "Calle Sol", "REF_TEXT_NAME", "HIGH"),
    ("Av. Bernal", "", "", "x", "Avenida Bernal", "OSM_NAME", "HIGH"),
    ("Calle Luna", "", "", "", "Calle Luna", "TEXT_STREET", "LOW"),
    ("salida", "", "Colonia Sur", "x", "Colonia Sur", "NODE_CONTEXT", "LOW"),
    ("", "", "", "x", "", "UNRESOLVED", "UNRESOLVED"),
    ("calle principal", "entrada", "", "x", "", "UNRESOLVED", "UNRESOLVED"),
]


def test_traffic_resolution(spark, lookups):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "uuid int, street_modal string, start_node_modal string, end_node_modal string, city_modal string")
    got = {r["uuid"]: (r["corridor_norm"], r["corridor_match_method"], r["corridor_match_confidence"])
           for r in resolve.resolve_traffic(df, lookups).collect()}
    assert got == {i: c[4:] for i, c in enumerate(CASES)}


def test_alias_group_wins(spark, lookups):
    df = spark.createDataFrame([("zona mercado viejo", None, None, "x")], "street_modal string, start_node_modal string, end_node_modal string, city_modal string")
    row = resolve.resolve_traffic(df, lookups).first()
    assert (row["corridor_group"], row["road_scope"], row["corridor_resolution_detail"]) == ("URBANO_LOCAL", "VIA_URBANA", "ALIAS_TABLE:mercado viejo")


@pytest.mark.parametrize("evidence, mentions, snapshots", [
    ("", 0, 0), ("nan", 0, 0), ("{}", 0, 0), ("[{\"source\": \"a\"", 0, 0), ("[]", 0, 0),
    (json.dumps([1, {"mention_id": "m", "engagement": [3, {"captured_at": "2026-06-28", "likes": "4"}, {"captured_at": "2026-06-27", "likes": 9}]}]), 1, 2),
    (json.dumps([{"mention_id": "m", "engagement": []}, "x"]), 1, 0)])
def test_irregular_evidence(spark, evidence, mentions, snapshots):
    raw = spark.createDataFrame([("1", evidence)], "uuid string, evidence string").withColumns(
        {c: F.lit("") for c in source.RAW_COLUMNS if c not in ("uuid", "evidence")})
    m = source.mentions(raw)
    assert m.count() == mentions and source.snapshots(m).count() == snapshots
    event = incidents.events(raw).first()
    if snapshots:
        assert m.first()["latest_likes"] == 9.0  # last array item
        assert source.latest_engagement(m).first()["latest_likes"] == 4.0  # newest capture time
        assert event["latest_likes"] == 4.0 and event["engagement_snapshots"] == 3
    assert event["mentions"] == (0 if mentions == 0 else 2)


def test_empty_observations(spark):
    assert jams.unique_jams(empty_like(spark, "uuid string, ts timestamp_ntz, id string")).count() == 0


def test_unique_jam_ties_and_nulls(spark):
    rows = [("u", "b", "2026-06-29T05:00:00Z", "Z", 2.0), ("u", "a", "2026-06-29T05:00:00Z", "A", None), ("u", "c", "2026-06-29T07:00:00Z", " ", 4.0)]
    row = jams.unique_jams(spark.createDataFrame(rows, "uuid string, id string, ts string, street string, delay double")).first()
    assert (row["id"], row["street_modal"], row["delay_median"], row["records_per_uuid"], row["event_hour"]) == ("a", "A", 3.0, 3, 23)


def test_partitioning_does_not_change_results(spark):
    rng = random.Random(2)
    rows = [(str(rng.randrange(40)), str(i), f"2026-06-29T{rng.randrange(24):02d}:00:00Z", f"Calle {rng.randrange(9)}", rng.random() * 900, rng.random() * 50)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "uuid string, id string, ts string, street string, delay double, speedkmh double")
    pick = ["uuid", "id", "street_modal", "delay_median", "speed_min", "records_per_uuid"]
    a = sorted(map(tuple, jams.unique_jams(df.repartition(1)).select(*pick).collect()))
    b = sorted(map(tuple, jams.unique_jams(df.repartition(7, "delay")).select(*pick).collect()))
    assert a == b


def test_dense_grid_and_one_sided_corridor(spark):
    keys = spark.createDataFrame([("a", "A"), ("b", "B")], "corridor_key string, corridor_name string")
    jam = spark.createDataFrame([("a", 3, 2)], "corridor_key string, event_hour int, jam_count long").withColumns(
        {c: F.lit(1.0) for c in integrate.JAM_MEASURES if c != "jam_count"})
    alert = spark.createDataFrame([("b", 3, 1), ("a", 2, 1)], "corridor_key string, event_hour int, alert_count long").withColumns(
        {c: F.lit(1.0) for c in integrate.ALERT_MEASURES if c != "alert_count"})
    panel = integrate.dense_panel(jam, alert, keys).cache()
    assert panel.count() == 48
    row = panel.filter("corridor_key = 'a' and event_hour = 3").first()
    assert row["alert_leads_jam_1h_flag"] and not row["alert_lags_jam_1h_flag"] and row["jam_without_alert_flag"]


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        studies.check_weights({"x": {"events": 0.5}})


def _roads(spark, n=300):
    rng = random.Random(4)
    rows = [(f"r{i:03d}", f"R{i}", ";".join(sorted(rng.sample("ABCDEF", rng.choice([1, 1, 2, 5])))), rng.choice([0.05, 0.4, 3.0, 12.0]) * (1 + rng.random()),
             rng.choice([1.0, .86, .72, .56, .45, .28, .18]), rng.choice([0.0, 0.5, 1.0]), round(rng.random(), 6), 1) for i in range(n)]
    rows += [(f"t{i}", "twin", "A", 2.0, 1.0, 0.5, 0.9, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "osm_candidate_key string, osm_candidate_name string, osm_departments string, osm_length_km double, "
                               "osm_hierarchy_score double, osm_maxspeed_norm double, osm_structural_prior double, osm_segment_count int")
    return df.withColumns({"departments": F.split("osm_departments", ";"), "osm_department_count": F.size(F.split("osm_departments", ";")),
                           "osm_predominant_road_type": F.lit("X")}).cache()


@pytest.mark.parametrize("single", [True, False])
def test_operational_topk_is_brute_force(spark, single):
    rng = random.Random(9)
    feats = [(str(i), max(0.03, rng.random() ** 3 * 9), rng.random(), rng.random(), rng.choice(["", "A", "B", "Q"])) for i in range(250)]
    features = spark.createDataFrame(feats, "uuid string, jam_length double, expected_osm_hierarchy double, expected_osm_speed_context double, inferred_department string")
    roads_ = _roads(spark)
    got = {(r["uuid"], r["model"], r["candidate_rank"]): r["operational_candidate_key"]
           for r in associate.operational_topk(features, roads_, single_department=single).collect()}
    pairs = features.join(roads_.select(F.struct("*").alias("road")), F.lit(True))
    for model in associate.MODELS:
        scored = pairs.select("uuid", associate.road_score(model, F.col("road"), single).alias("s"), "road.osm_candidate_key").toPandas()
        for uuid, rows in scored.groupby("uuid"):
            want = rows.sort_values(["s", "osm_candidate_key"], ascending=[False, True]).osm_candidate_key.tolist()[:5]
            assert [got[uuid, model, k] for k in range(1, 6)] == want


def test_shortlists_do_not_pass_through_the_driver(spark):
    """A shortlist is small on disk and large in memory, so jams meet it in a merge join whatever its files' size."""
    features = spark.createDataFrame([("1", 0.5, 0.5, 0.5, "A"), ("2", 3.0, 0.9, 0.1, "")], "uuid string, jam_length double, "
                                     "expected_osm_hierarchy double, expected_osm_speed_context double, inferred_department string")
    top = associate.operational_topk(features, _roads(spark))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell" in plan and "Broadcast" not in plan


def test_similar_texts_lose_nothing(spark):
    rng = random.Random(6)
    words = ["calle", "avenida", "sol", "luna", "norte", "sur", "arce", "bernal", "los", "heroes"]
    texts = sorted({" ".join(rng.choice(words)[: rng.randint(2, 9)] for _ in range(rng.randint(1, 4))) for _ in range(160)})
    names, others = texts[::2], texts[1::2]
    got = {(r["name"], r["alias"]): (r["score"], r["method"]) for r in associate.similar_texts(
        spark.createDataFrame([(t,) for t in names], "name string"), spark.createDataFrame([(t,) for t in others], "alias string")).collect()}
    want = {(a, b): associate.text_match(a, b) for a in names for b in others if associate.text_match(a, b)[0] >= 0.55}
    assert got == want and any(m == "FUZZY" for _, m in want.values())


@pytest.mark.parametrize("keep", [0.35, 0.55, 0.75])
def test_similar_texts_of_any_length(spark, keep):
    """Short and long texts, texts without a shared word, frequent words, nulls, blanks and repeats."""
    rng = random.Random(17)
    base = ["".join(rng.choices("abcdeé", k=rng.choice([1, 2, 3, 5, 9, 30, 62, 66, 120]))) for _ in range(60)]
    edit = lambda t: "".join(rng.choice([c, c, c, c, c, "", rng.choice("ab c")]) for c in t).strip()
    texts = [t for b in base for t in (b, edit(b), edit(b), "calle " + b[:6], b[:4] + " calle de " + b[4:9])]
    names, others = texts[::2], texts[1::2]
    rows = lambda ts, c: spark.createDataFrame([(t,) for t in [*ts, None, "", ts[0]]], f"{c} string")
    found = associate.similar_texts(rows(names, "name"), rows(others, "alias"), keep).collect()
    want = {(a, b): associate.text_match(a, b) for a in set(names) for b in set(others) if associate.text_match(a, b)[0] >= keep}
    assert {(r["name"], r["alias"]): (r["score"], r["method"]) for r in found} == want and len(found) == len(want)
    assert keep > 0.7 or any(m == "FUZZY" and not set(a.split()) & set(b.split()) for (a, b), (_, m) in want.items())


def test_similar_texts_compare_few_pairs(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("aeioulnrst", k=7))
    names, others = ([f"{word()} {word()}" for _ in range(300)] for _ in range(2))
    rows = lambda ts, c: spark.createDataFrame([(t,) for t in ts], f"{c} string")
    assert candidates(rows(names, "name"), rows(others, "alias"), 0.55).count() < 0.05 * 300 * 300


def test_text_match_methods():
    assert associate.text_match("a b", "a b") == (1.0, "EXACT")
    assert associate.text_match("avenida sur", "avenida sur poniente")[1] == "CONTAINS"
    assert associate.text_match("calle arce norte", "arce")[1] == "PARTIAL_WEAK"
    assert associate.text_match("abc", "abd")[0] == round(0.7 * SequenceMatcher(None, "abc", "abd").ratio(), 4)


def test_geocode_scoring(spark):
    rows = [("highway", "residential", "", "Avenida Bernal, San Salvador", "avenida bernal", "san salvador", 13.7, 0.5),
            ("place", "city", "", "Otra", "avenida bernal", "x", 13.7, 0.0), ("shop", "mall", "", "Lejos", "avenida bernal", "x", 13.7, 0.0),
            ("highway", "road", "", "Avenida Bernal", "avenida bernal", "x", 40.0, 0.0)]
    df = spark.createDataFrame(rows, "category string, type string, addresstype string, display_name string, corridor_candidate string, municipality string, lat double, importance double")
    df = df.withColumns({"lon": F.lit(-89.2), "department": F.lit(""), "query": F.lit("Avenida Bernal, El Salvador")})
    got = [(r["geocode_level"], r["geocode_confidence"], r["geocode_usable_for_road_analysis"], r["geocode_status"]) for r in evaluate.score_geocodes(df).collect()]
    assert got[0] == ("ROAD_OR_CORRIDOR", 0.95, True, "GEOCODED")
    assert got[1][0] == "MUNICIPALITY_OR_ADMIN" and got[2][:2] == ("AMBIGUOUS_LOW_CONTEXT_MATCH", 0.35)
    assert got[3][2:] == (False, "OUTSIDE_EL_SALVADOR_BBOX")


def test_geocode_queries(spark):
    df = spark.createDataFrame([("Calle Arce, San Salvador", "San Salvador", "San Salvador", "calle arce")], "a string, m string, d string, c string")
    got = df.select(evaluate.geocode_queries(F.col("a"), F.col("m"), F.col("d"), F.col("c")).alias("q")).first()["q"]
    assert got == ["Calle Arce, San Salvador, El Salvador", "calle arce, San Salvador, San Salvador, El Salvador", "San Salvador, San Salvador, El Salvador"]


def test_geocode_order(spark):
    events = spark.createDataFrame([("e", None, None, 0.0), ("o", 13.7, -89.2, 0.0)], "event_id string, latitude_num double, longitude_num double, geo_confidence double")
    scored = spark.createDataFrame([("e", 1, 0.5, False, "first"), ("e", 2, 0.6, True, "second"), ("e", 3, 0.9, True, "third")],
                                   "event_id string, query_order int, geocode_confidence double, geocode_usable_for_road_analysis boolean, display_name string"
                                   ).withColumns({"lat": F.lit(13.7), "lon": F.lit(-89.2), "geocode_level": F.lit("ROAD_OR_CORRIDOR"), "geocode_status": F.lit("GEOCODED")})
    got = {r["event_id"]: (r["geocode_status"], r["geocode_display_name"]) for r in evaluate.geocoded_events(events, scored).collect()}
    assert got["e"] == ("GEOCODED", "second") and got["o"][0] == "ORIGINAL_COORDINATES"


def test_base_corridors_choose_table_and_column(spark):
    empty = spark.createDataFrame([], "corridor_norm string, events double")
    table = spark.createDataFrame([(" ", "a", 1.0), (None, "b", 2.0)], "corridor_norm string, corridor_candidate string, events double")
    base, column = studies.base_corridors([empty, table])
    assert column == "corridor_candidate" and base.count() == 2
    assert {r["corridor"] for r in studies.weight_profiles(base, column).collect()} == {"a", "b"}
    for tables in ([empty], [table.drop("corridor_candidate")]):
        with pytest.raises(ValueError):
            studies.base_corridors(tables)


def test_damaged_evidence_is_left_out(spark):
    good = json.dumps([{"mention_id": "m", "source": "s", "engagement": [{"captured_at": "2024-01-01 00:00:00", "likes": 3}]}])
    rows = [("1", good), ("2", good + "}"), ("3", "[7, \"x\", " + good[1:]), ("4", ""), ("5", None)]
    raw = spark.createDataFrame(rows, "uuid string, evidence string").withColumns({"ticketNumber": F.lit("t"), "datetime": F.lit("2024-01-01 00:00:00")})
    found = source.mentions(raw)
    assert sorted(r["event_uuid"] for r in found.collect()) == ["1", "3"]
    assert {r["event_uuid"]: r["latest_likes"] for r in source.latest_engagement(found).collect()} == {"1": 3.0, "3": 3.0}


def test_city_aliases_name_departments(spark):
    found = aliases.city_aliases(spark, {"LA PAZ": ("Zacatecoluca", "San Luis  Talpa")}).collect()
    assert sorted((r["key"], r["department"]) for r in found) == [("san luis talpa", "LA PAZ"), ("zacatecoluca", "LA PAZ")]


def test_tables_on_the_way_to_the_alerts_go(spark, tmp_path):
    import os
    from urllib.parse import urlparse

    from corridor_spark.layers import Layers
    from corridor_spark.session import stage_root

    spark.range(40).selectExpr("id AS event_id", "timestamp'2024-01-02 03:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id % 7 AS user_id",
                               "'a' AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(200).selectExpr("id AS p_partkey", "concat('road ', id % 9) AS p_name", "'b' AS p_brand", "CAST(id % 50 AS INT) AS p_size"
                                ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name", "CAST(id AS INT) AS n_regionkey"
                              ).write.parquet(f"{tmp_path}/nation.parquet")
    folder = urlparse(stage_root(spark)).path
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = Layers(spark, str(tmp_path))
    rows = found.alerts.collect()
    assert len(rows) == 40 and sum(r["nearest_way_id"] is not None for r in rows) == sum(r["has_valid_coordinate"] for r in rows) > 30
    left = {name[:-33] for name in set(os.listdir(folder)) - before}
    assert {"alerts", "prepared-alerts", "pieces", "names"} <= left
    assert not left & {"near-alerts", "alert-roads", "placed-alerts", "nearest", "left", "numbered-pieces", "alert-texts"}
    # what other layers share is still there
    assert found.prepared_alerts.count() == 40 and found.lookups.names.count() and found.alert_panel.count()


def test_event_layers_do_not_carry_the_evidence(spark, tmp_path):
    from corridor_spark.layers import Layers

    one = json.dumps([{"source": "a", "engagement": [{"captured_at": "2024-01-01 00:00:00", "likes": 1}, {"likes": 2}]}])
    evidence = spark.createDataFrame([("1", one, "{}", "x"), ("2", "", "{}", "y")], "uuid string, evidence string, reliability string, observation string")
    found = Layers(spark, str(tmp_path))
    found.raw_incidents = evidence
    kept = found.base_events
    assert "evidence" not in kept.columns and {"reliability", "observation", "engagement_snapshots"} <= set(kept.columns)
    whole = {r["uuid"]: r["engagement_snapshots"] for r in incidents.events(evidence).collect()}
    assert {r["uuid"]: r["engagement_snapshots"] for r in kept.collect()} == whole and any(whole.values())


def _small_tables(spark, folder):
    spark.range(40).selectExpr("id AS event_id", "timestamp'2024-01-02 03:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id % 7 AS user_id",
                               "'a' AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(f"{folder}/events.parquet")
    spark.range(200).selectExpr("id AS p_partkey", "concat('road ', id % 9) AS p_name", "'b' AS p_brand", "CAST(id % 50 AS INT) AS p_size"
                                ).write.parquet(f"{folder}/part.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name", "CAST(id AS INT) AS n_regionkey"
                              ).write.parquet(f"{folder}/nation.parquet")


def test_alerts_meet_their_roads_before_columns_are_derived(spark, tmp_path, monkeypatch):
    from contextlib import contextmanager

    from corridor_spark import layers

    written, real = {}, layers.scratch

    @contextmanager
    def watched(session):
        with real(session) as keep:
            def kept(df, name):
                written[name] = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
                return keep(df, name)

            yield kept

    monkeypatch.setattr(layers, "scratch", watched)
    _small_tables(spark, tmp_path)
    found = layers.Layers(spark, str(tmp_path))
    assert found.alerts.count() == 40
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", written["near-alerts"])
    assert any("cluster_report_count" in columns for columns in moved)
    assert not any(c in columns for columns in moved for c in ("street_norm", "x_utm", "event_hour", "route_ref"))
    both = found.alerts.select(*found.prepared_alerts.columns)
    assert both.exceptAll(found.prepared_alerts).isEmpty() and found.prepared_alerts.exceptAll(both).isEmpty()


def test_long_evidence_stands_in_small_row_groups(spark, tmp_path, monkeypatch):
    import glob
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    from corridor_spark import fixtures
    from corridor_spark.layers import Layers

    text = "concat('[{\"source\":\"', array_join(transform(sequence(1, 8000), i -> sha2(concat(id, ':', i), 256)), ''), '\"}]')"
    rows = spark.range(0, 40, 1, 1).selectExpr("CAST(id AS STRING) AS uuid", "'t' AS ticketNumber", "'2024-01-01 00:00:00' AS datetime", f"{text} AS evidence")
    monkeypatch.setattr(fixtures, "raw_incidents", lambda session, folder: rows)
    found = Layers(spark, str(tmp_path))
    for table in (found.raw_incidents, found.mentions):
        files = [pq.ParquetFile(f).metadata for name in table.inputFiles() for f in glob.glob(urlparse(name).path)]
        groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
        assert sum(g.num_rows for g in groups) == 40
        assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups) < 6 << 20
    assert found.mentions.agg(F.min(F.length("source"))).first()[0] == 512_000


def test_snapshots_are_taken_out_in_one_pass(spark):
    """Newest snapshot by time, then place; items that are no objects count in the list only, and no item's schema is worked out."""
    engagement = [{"captured_at": "2026-01-02 00:00:00", "likes": "3", "views": "nan"}, 7, None, [1], {"captured_at": "2026-01-02 00:00:00", "likes": "x", "shares": True, "_": 1},
                  {"captured_at": "2026-01-01 00:00:00", "likes": 50, "comments": 2}, {"likes": 90}, {"captured_at": "bad", "likes": 91}]
    evidence = [{"source": "a", "engagement": engagement}, {"source": "b", "engagement": engagement[:1] + engagement[5:]}, 5, None, {"engagement": {"likes": 1}}, {"engagement": [3]}, []]
    rows = [("u", json.dumps(evidence), "{}"), ("v", "[]", "{}"), ("w", json.dumps(evidence)[:-1], None)]
    out = incidents.events(spark.createDataFrame(rows, "uuid string, evidence string, reliability string"))
    got = {r["uuid"]: tuple(r[c] for c in ("latest_likes", "latest_comments", "latest_shares", "latest_quotes", "latest_views", "engagement_snapshots", "engagement_mentions", "mentions"))
           for r in out.collect()}
    assert got == {"u": (3.0, 0.0, 0.0, 0.0, 0.0, 13, 3, 7), "v": (0.0,) * 5 + (0, 0, 0), "w": (0.0,) * 5 + (0, 0, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in plan and plan.count("$.captured_at") == 0


def test_incident_text_is_compacted_once(spark):
    """The long text is folded once; tags that run from one part into the next are still cut from the whole."""
    columns = ("corridor_candidate", "road_name_candidates", "address", "observation", "nearest_osm_ref", "nearest_osm_name", "intersection_candidate")
    texts = ["", None, "Bulevar del Ejército", "calle <b", "x> y z", "a < b > y c", "avenida Olímpica y calle ß"]
    rows = [(f"u{i}{j}{k}", a, b, c, c, "", "Calle 1", "") for i, a in enumerate(texts) for j, b in enumerate(texts) for k, c in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("uuid", *columns))).withColumns(
        {"osm_match_status": F.lit("SPATIAL_OSM_HIGH"), "nearest_osm_distance_m": F.lit(80.0)})
    joined = lambda *names: F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in names])
    padded = lambda col: F.concat(F.lit(" "), resolve.compact_text(col), F.lit(" "))
    whole = padded(joined("corridor_candidate", "road_name_candidates", "address", "observation"))
    context = padded(joined("address", "observation", "corridor_candidate"))
    want = df.select("uuid", F.coalesce(resolve._phrase_rule(whole, 1), resolve._phrase_rule(whole, 2)).alias("ruled"), context.contains(" y ").alias("y"))
    got = {r["uuid"]: r for r in resolve.resolve_incident(df).collect()}
    for r in want.collect():
        found = got[r["uuid"]]
        if r["ruled"] is not None:
            assert found["text_corridor_norm"] == r["ruled"]
        if found["text_corridor_norm"] not in ("", found["nearest_osm_corridor_norm"]):
            assert (found["text_osm_resolution"] == "INTERSECTION_ACCEPTED") == r["y"]
    plan = resolve.resolve_incident(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("_told#") > 2 and "AS _ctx#" in plan


def test_folding_passes_over_ascii(spark):
    """The long class of characters is tried on other characters only; results are those of the exact form."""
    from corridor_spark.functions.text import fold, fold_exact

    df = spark.createDataFrame([("av. Olímpica ﬁn ㎞ 12 ½ Straße ﬃ ª Ǆ" * 3,), ("plain",), ("",), (None,)], "t string")
    assert r"(?=[^\x00-\x7f])" in df.select(fold(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    for r in df.select(F.regexp_replace(fold(F.col("t")), "[^ -~]+", " ").alias("a"), F.regexp_replace(fold_exact(F.col("t")), "[^ -~]+", " ").alias("b")).collect():
        assert r["a"] == r["b"]
