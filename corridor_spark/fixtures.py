"""Views that give the driver tables the shape of the analyses' inputs.

The SQL runs unchanged in Spark and DuckDB, so a query and its oracle start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JAM_OBS = """
SELECT CAST(FLOOR(event_id/4e0) AS BIGINT) AS uuid, event_id AS id, ts,
       CAST((event_id*31) % 5 AS INT) + 1 AS level,
       value*20e0 AS delay,
       CAST((event_id*37) % 4000 AS DOUBLE) + 50e0 AS length,
       CAST((event_id*17) % 45 AS DOUBLE) AS speedkmh,
       CASE WHEN user_id % 10 = 0 THEN '' WHEN user_id % 10 = 1
            THEN CONCAT('CA-', CAST(user_id % 8 AS STRING), ' / Blvd. Corredor ', CAST(user_id % 40 AS STRING))
            ELSE CONCAT('Av. Corredor ', CAST(user_id % 40 AS STRING)) END AS street,
       CONCAT('city ', CAST(user_id % 14 AS STRING)) AS city
FROM events
"""

ALERT = """
SELECT event_id AS uuid, ts,
       CASE event_id % 4 WHEN 0 THEN 'ACCIDENT' WHEN 1 THEN 'ROAD_CLOSED' WHEN 2 THEN 'JAM' ELSE 'HAZARD' END AS type,
       CASE event_id % 12 WHEN 0 THEN 'ACCIDENT_MAJOR' WHEN 2 THEN 'JAM_HEAVY_TRAFFIC'
            WHEN 6 THEN 'JAM_STAND_STILL_TRAFFIC' WHEN 3 THEN 'HAZARD_ON_ROAD_POT_HOLE'
            WHEN 7 THEN 'HAZARD_ON_ROAD_LANE_CLOSED' WHEN 11 THEN 'HAZARD_WEATHER_FLOOD' ELSE '' END AS subtype,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE -89.42e0 + CAST((event_id*7919) % 2600 AS DOUBLE)/10000e0 END AS lon,
       CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 101 = 5 THEN 40e0
            ELSE 13.55e0 + CAST((event_id*104729) % 1600 AS DOUBLE)/10000e0 END AS lat,
       CONCAT('Av. Corredor ', CAST(user_id % 50 AS STRING)) AS street,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CONCAT('city ', CAST(user_id % 14 AS STRING)) END AS city,
       CAST((event_id*13) % 20 AS INT) + 1 AS cluster_report_count,
       CAST(event_id % 11 AS DOUBLE) AS reliability, CAST(event_id % 6 AS DOUBLE) AS reportrating,
       CAST(event_id % 5 AS DOUBLE) AS confidence
FROM events
"""

ROAD_PIECE = """
SELECT p_partkey AS way_id,
       CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0
            THEN CONCAT('Avenida Corredor ', CAST(p_partkey % 40 AS STRING))
            ELSE CONCAT(p_name, ' ', p_brand) END AS name,
       CASE WHEN p_size % 3 = 0 THEN CONCAT('CA-', CAST(p_size % 7 AS STRING)) ELSE '' END AS ref,
       CASE p_size % 6 WHEN 0 THEN 'trunk' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary'
            WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' ELSE 'service' END AS highway,
       CAST(p_partkey % 14 AS INT) AS department,
       -89.42e0 + CAST((p_partkey*6151) % 2600 AS DOUBLE)/10000e0 AS ax,
       13.55e0 + CAST((p_partkey*3571) % 1600 AS DOUBLE)/10000e0 AS ay,
       -89.42e0 + CAST((p_partkey*6151) % 2600 AS DOUBLE)/10000e0 + (CAST((p_partkey*31) % 41 AS DOUBLE) - 20e0)/8000e0 AS bx,
       13.55e0 + CAST((p_partkey*3571) % 1600 AS DOUBLE)/10000e0 + (CAST((p_partkey*29) % 43 AS DOUBLE) - 21e0)/8000e0 AS by_
FROM part
"""

SNAPSHOT = """
SELECT user_id AS incident, event_type AS mention, event_id AS snapshot_index, ts AS captured_at,
       CAST(FLOOR(value) AS DOUBLE) AS likes, CAST(event_id % 7 AS DOUBLE) AS comments,
       CAST(event_id % 5 AS DOUBLE) AS shares, CAST(event_id % 3 AS DOUBLE) AS quotes,
       CAST(FLOOR(value*50e0) AS DOUBLE) AS views
FROM events
"""

INCIDENT = """
SELECT d.doc_id AS uuid, d.text AS observation, d.source AS source, CAST(d.doc_id % 14 AS INT) AS department,
       CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE CAST(d.doc_id % 45 AS INT) END AS municipality,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 97 = 1 THEN 40e0
            ELSE 13e0 + CAST((d.doc_id*53) % 400 AS DOUBLE)/250e0 END AS lat,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL
            ELSE -90.2e0 + CAST((d.doc_id*53) % 400 AS DOUBLE)/160e0 END AS lon,
       CAST(d.doc_id % 10 AS DOUBLE)/10e0 AS geo_confidence
FROM documents d
"""

ALIAS = """
SELECT CONCAT('corredor ', CAST(n_nationkey * 5 AS STRING)) AS raw_value_norm,
       CONCAT('Corredor ', n_name) AS corridor_norm,
       50e0 + CAST(n_regionkey AS DOUBLE)*10e0 AS priority
FROM nation
"""

# The incident with road text, severity phrases and territory, over whole document texts.
INCIDENT_TEXT = """
SELECT d.doc_id AS uuid, CONCAT('T-', CAST(d.doc_id AS STRING)) AS ticketNumber,
       CONCAT('2024-01-', LPAD(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), ' ', LPAD(CAST(d.doc_id % 24 AS STRING), 2, '0'), ':15:00') AS datetime,
       CASE d.doc_id % 3 WHEN 0 THEN 'TRAFFIC_ACCIDENT' WHEN 1 THEN 'Traffic accident' ELSE 'OTHER' END AS incident,
       CASE WHEN d.doc_id % 10 = 9 THEN '' ELSE CAST(d.doc_id % 14 AS STRING) END AS department,
       CASE WHEN d.doc_id % 6 = 0 THEN '' WHEN d.doc_id % 6 = 1 THEN 'Ilopango' WHEN d.doc_id % 6 = 2 THEN 'Santa Tecla'
            ELSE CONCAT('Municipio ', CAST(d.doc_id % 45 AS STRING)) END AS municipality,
       CASE d.doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'Carretera Panamericana, km 12'
            WHEN 2 THEN CONCAT('Avenida Corredor ', CAST(d.doc_id % 40 AS STRING), ' frente a mercado')
            WHEN 3 THEN CONCAT('interseccion de la Calle ', CAST(d.doc_id % 9 AS STRING), ' y la Avenida Corredor ', CAST(d.doc_id % 40 AS STRING))
            WHEN 4 THEN 'Bulevar del Ejército' WHEN 5 THEN CONCAT('Calle Corredor ', CAST(d.doc_id % 30 AS STRING), ' sector norte, kilometro 7')
            WHEN 6 THEN 'Autopista a Comalapa' ELSE CASE d.doc_id % 5 WHEN 0 THEN 'av. Olímpica, km 12 1/2' WHEN 1 THEN 'Calle 10-a Oriente de la en Escalon'
                 WHEN 2 THEN 'Alameda Juan Pablo y paseo central' ELSE 'colonia central' END END AS address,
       CONCAT(d.text, CASE d.doc_id % 11 WHEN 0 THEN ' dos personas lesionadas y 3 heridos' WHEN 1 THEN ' 2 fallecidos en motocicleta'
            WHEN 2 THEN ' solo daños materiales' WHEN 3 THEN ' un camion bloqueo el carril' WHEN 4 THEN ' peaton atropellado por un bus'
            WHEN 5 THEN ' choque multiple con lesionados 4 personas' ELSE '' END) AS observation,
       d.source AS source,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 97 = 1 THEN 40e0
            ELSE 13.55e0 + CAST((d.doc_id*53) % 400 AS DOUBLE)/2500e0 END AS lat,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL
            ELSE -89.42e0 + CAST((d.doc_id*57) % 400 AS DOUBLE)/1600e0 END AS lon,
       CAST(d.doc_id % 10 AS DOUBLE)/10e0 AS geo_confidence
FROM documents d
"""

VIEWS = {
    "incident_text": (INCIDENT_TEXT, "documents"),
    "jam_obs": (JAM_OBS, "events"),
    "alert": (ALERT, "events"),
    "road_piece": (ROAD_PIECE, "part"),
    "snapshot": (SNAPSHOT, "events"),
    "incident": (INCIDENT, "documents"),
    "alias": (ALIAS, "nation"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table; tables of texts and of roads, whose rows are much work, are spread over the cores when they come in fewer files than that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "conversations", "part") and len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs as a DataFrame."""
    sql, source = VIEWS[name]
    head, _, tail = sql.rpartition(f"FROM {source}")
    return spark.sql(f"{head}FROM {{source}}{tail}", source=table(spark, sf_dir, source))


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text incidents: the flat snapshots packed into ``evidence`` JSON; one in ten carries array items that are no objects."""
    flat = view(spark, sf_dir, "snapshot").withColumn(
        "s", F.struct(F.col("captured_at").cast("string").alias("captured_at"), "likes", "comments", "shares", "quotes",
                      "views")
    )
    mentions = flat.groupBy("incident", "mention").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("snapshot_index", "s"))), lambda x: x.s).alias("engagement")
    )
    packed = mentions.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct(
        F.col("mention").alias("mention_id"), F.concat(F.lit("src_"), "mention").alias("source"), "engagement"
    ))).alias("m"))
    json = F.to_json("m")
    evidence = (
        F.when(F.col("incident") % 10 == 3, F.concat(F.lit('[7, "x", '), F.substring(json, 2, 1 << 30)))
        .otherwise(json)
    )
    packed = packed.select(F.col("incident").alias("uuid"), evidence.alias("evidence"), F.size("m").alias("n"))
    links = F.array(
        F.struct(F.lit("MERGE").alias("decision"), (F.col("uuid") % 7 / 10).alias("dedupe_score")),
        F.struct(F.lit("NEW").alias("decision"), (F.col("uuid") % 3 / 10).alias("dedupe_score")),
    )
    text = view(spark, sf_dir, "incident_text")
    reliability = F.to_json(F.struct(
        F.coalesce("n", F.lit(0)).alias("mentions"), F.lit(2).alias("links_count"), "geo_confidence", links.alias("links")))
    return text.join(packed, "uuid", "left").select(
        *[F.col(c).cast("string").alias(c) for c in ("uuid", "ticketNumber", "datetime", "incident", "department",
                                                     "municipality", "address", "observation")],
        F.coalesce(F.col("lat").cast("string"), F.lit("")).alias("latitude"),
        F.coalesce(F.col("lon").cast("string"), F.lit("nan")).alias("longitude"),
        "source", reliability.alias("reliability"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def cte(*names: str) -> str:
    """The derived inputs as CTEs for the oracle."""
    return ", ".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in names)
