"""Word lists, rules, labels, weights and thresholds.

Every table here is a value the results depend on, not logic. Functions take
them as defaults, so another country's lexicon can be passed instead.
"""

from __future__ import annotations

LOCAL_ZONE = "America/El_Salvador"
HOURS_PER_DAY = 24

# --- Fixed values: bounding boxes (south, west, north, east) -----------------
COUNTRY_BOX = (13.0, -90.2, 14.6, -87.6)
CAPITAL_BOX = (13.55, -89.42, 13.92, -89.00)
ALERT_BOX = (13.0, -90.4, 14.7, -87.5)
FRAME_BOX = (13.05, -90.20, 14.45, -87.65)

# --- Fixed values: route references ------------------------------------------
ROUTE_PREFIXES = (
    "ca", "rn", "lib", "sam", "sal", "ahu", "cab", "cha", "cus",
    "lap", "mor", "paz", "san", "son", "usu",
)
NATIONAL_PREFIXES = ("ca", "rn")
DEPARTMENT_PREFIXES = (
    "sal", "lib", "sam", "ahu", "cab", "cha", "cus", "lap", "mor", "san", "son", "usu",
)

# --- Fixed values: road word replacements, whole words -----------------------
ROAD_WORDS = (
    (("av", "avda"), "avenida"),
    (("blvd", "boulevard", "blvr"), "bulevar"),
    (("carr", "ctra"), "carretera"),
    (("autop",), "autopista"),
    (("prol",), "prolongacion"),
)
# The catalogue's own replacements, applied in this order before punctuation goes.
CATALOG_WORDS = (
    (r"\bboulevard\b", "bulevar"),
    (r"\bblvd\b", "bulevar"),
    (r"\bblvr\b", "bulevar"),
    (r"\bblv\b", "bulevar"),
    (r"\bav\.\b", "avenida"),
    (r"\bav\b", "avenida"),
    (r"\bave\b", "avenida"),
    (r"\bavenida\.\b", "avenida"),
    (r"\bcarret\.\b", "carretera"),
    (r"\bctra\b", "carretera"),
    (r"\bcalz\.\b", "calle"),
    (r"\bcalle\.\b", "calle"),
    (r"\bautop\.\b", "autopista"),
    (r"\bpanamerican highway\b", "carretera panamericana"),
)

# --- Fixed values: small words kept lower in titles --------------------------
TITLE_SMALL_WORDS = ("de", "del", "la", "las", "los", "y", "el")
TRAFFIC_SMALL_WORDS = ("a", "al", *TITLE_SMALL_WORDS)

# --- Fixed values: traffic corridor rules (name, references, text aliases) ---
TRAFFIC_RULES = (
    ("Carretera Panamericana",
     ("ca 1", "ca 1a", "ca 1w", "ca1", "ca1a", "ca1w"),
     ("carretera panamericana", "panamericana", "ca 1", "ca 1a", "ca 1w", "ca1", "ca1a", "ca1w")),
    ("Carretera del Litoral",
     ("ca 2", "ca 2e", "ca 2w", "ca2", "ca2e", "ca2w"),
     ("carretera del litoral", "litoral", "ca 2", "ca 2e", "ca 2w", "ca2", "ca2e", "ca2w")),
    ("Carretera Troncal del Norte", ("ca 4", "ca4"),
     ("carretera troncal del norte", "troncal del norte")),
    ("Autopista a Comalapa", ("rn 5", "rn5"),
     ("autopista a comalapa", "autopista comalapa", "carretera a comalapa", "rn 5", "rn5")),
    ("Ruta Militar", ("rn 18", "rn18", "ca 7", "ca7"),
     ("ruta militar", "rn 18", "rn18", "ca 7", "ca7")),
    ("Bulevar Venezuela", (), ("bulevar venezuela", "boulevard venezuela")),
    ("Bulevar del Ejercito", (), ("bulevar del ejercito", "boulevard del ejercito")),
    ("Bulevar Constitucion", (), ("bulevar constitucion", "boulevard constitucion")),
    ("Bulevar de Los Proceres", (), ("bulevar de los proceres", "boulevard de los proceres")),
    ("Bulevar Monseñor Romero", ("rn 21", "rn21"),
     ("bulevar monsenor romero", "rn 21", "rn21")),
    ("Carretera al Puerto de La Libertad", (),
     ("carretera al puerto de la libertad", "carretera del puerto de la libertad",
      "carretera al puerto", "carretera a la libertad")),
    ("Calle al Volcan", (), ("calle al volcan", "calle a el volcan")),
    ("Carril del Sitramss", (), ("carril del sitramss", "sitramss")),
)
# This rule's reference is shared by other roads, so it also needs this text.
AMBIGUOUS_RULE = ("Carretera Troncal del Norte", "ca 4", "troncal del norte")
GENERIC_STREETS = ("", "sin calle", "calle principal", "salida", "entrada")
NATIONAL_NAME_TERMS = ("panamericana", "litoral", "comalapa", "troncal del norte", "ruta militar")
URBAN_NAME_TERMS = ("bulevar", "alameda", "avenida", "calle", "paseo")

# --- Fixed values: incident corridor rules and lexicons ----------------------
INCIDENT_RULES = (
    ("Carretera Panamericana", ("ca 1", "ca 1w", "ca1", "ca1w"),
     ("carretera panamericana", "panamericana", "boulevard del ejercito", "bulevar del ejercito",
      "tramo los chorros", "los chorros", "ca 1", "ca 1w")),
    ("Autopista a Comalapa", ("rn 5", "rn5"),
     ("autopista a comalapa", "autopista comalapa", "carretera a comalapa", "carretera comalapa", "rn 5")),
    ("Carretera al Puerto de La Libertad", (),
     ("carretera al puerto de la libertad", "carretera al puerto", "carretera del puerto de la libertad",
      "carretera que conduce del puerto de la libertad", "carretera que conecta el puerto de la libertad",
      "puerto de la libertad hacia santa tecla", "puerto de la libertad con santa tecla")),
    ("Paseo General Escalón", (), ("paseo general escalon", "paseo escalon", "general escalon")),
    ("Carretera Quezaltepeque - San Juan Opico", ("lib 25", "lib25"),
     ("calle de tacachico a san juan opico", "calle tacachico a san juan opico",
      "carretera de quezaltepeque a san juan opico", "quezaltepeque con san juan opico",
      "quezaltepeque a san juan opico", "lib 25")),
)
KNOWN_CORRIDORS = {
    "carretera troncal del norte": ("carretera troncal del norte", "troncal del norte"),
    "carretera panamericana": ("carretera panamericana", "panamericana"),
    "tramo los chorros": ("tramo los chorros", "los chorros"),
    "bulevar del ejercito": ("bulevar del ejercito", "boulevard del ejercito"),
    "carretera de oro": ("carretera de oro",),
    "boulevard constitucion": ("boulevard constitucion", "bulevar constitucion", "el constitucion"),
    "autopista a comalapa": ("autopista a comalapa", "autopista comalapa", "carretera a comalapa"),
    "bulevar venezuela": ("bulevar venezuela", "boulevard venezuela", "entrada al venezuela"),
    "avenida bernal": ("avenida bernal", "av bernal"),
    "autopista norte": ("autopista norte",),
    "carretera a sonsonate": ("carretera a sonsonate", "carretera hacia sonsonate"),
    "carretera a santa ana": ("carretera a santa ana", "carretera hacia santa ana"),
    "carretera al puerto de la libertad": (
        "carretera al puerto de la libertad", "carretera al puerto", "carretera del puerto de la libertad"),
    "paseo general escalon": ("paseo general escalon",),
    "calle a mariona": ("calle a mariona", "calle de mariona"),
    "avenida jerusalen": ("avenida jerusalen",),
    "ruta de paz": ("ruta de paz",),
    "periferico gerardo barrios": ("periferico gerardo barrios",),
}
CAPITAL_CORRIDORS = {
    "carretera troncal del norte": ("carretera troncal del norte", "troncal del norte"),
    "carretera panamericana": ("carretera panamericana", "panamericana"),
    "tramo los chorros": ("tramo los chorros", "los chorros"),
    "bulevar del ejercito": ("bulevar del ejercito", "boulevard del ejercito"),
    "carretera de oro": ("carretera de oro",),
    "boulevard constitucion": ("boulevard constitucion", "bulevar constitucion", "el constitucion"),
    "autopista a comalapa": ("autopista a comalapa", "autopista comalapa"),
    "bulevar venezuela": ("bulevar venezuela", "boulevard venezuela", "entrada al venezuela"),
    "avenida bernal": ("avenida bernal", "av bernal"),
    "calle agua caliente": ("calle agua caliente", "calle de agua caliente"),
    "calle antigua a tonacatepeque": ("calle antigua a tonacatepeque", "calle tonacatepeque"),
    "calle antigua a nejapa": ("calle antigua a nejapa",),
    "carretera a quezaltepeque": ("carretera a quezaltepeque",),
    "carretera a los planes de renderos": ("carretera a los planes de renderos", "planes de renderos"),
    "calle los sisimiles": ("calle los sisimiles", "los sisimiles"),
    "autopista norte": ("autopista norte",),
    "49 avenida sur": ("49 av sur", "49 avenida sur"),
    "59 avenida sur": ("59 avenida sur",),
    "75 avenida norte": ("75 avenida norte", "calle 75 avenida norte"),
    "29 avenida norte": ("29 avenida norte", "29 av nte", "29 av. nte"),
    "10 avenida norte": ("10 avenida norte", "10a avenida norte", "10. avenida norte"),
    "calle buenos aires": ("calle buenos aires",),
    "calle ramon belloso": ("calle ramon belloso",),
    "avenida barberena": ("avenida barberena",),
    "calle cuba": ("calle cuba",),
    "bulevar merliot": ("bulevar merliot", "boulevard merliot"),
    "bulevar sur": ("bulevar sur", "boulevard sur"),
    "periferico claudia lars": ("periferico claudia lars", "bulevar claudia lars", "boulevard claudia lars"),
    "carretera al puerto de la libertad": ("carretera al puerto de la libertad", "carretera al puerto"),
}

# --- Fixed values: road phrase words -----------------------------------------
ROAD_KINDS = (
    "carretera", "autopista", "bulevar", "boulevard", "avenida", "av", "calle", "ruta",
    "periferico", "bypass", "troncal", "alameda", "paseo",
)
ROAD_FILLERS = ("que", "conduce", "de", "del", "la", "las", "los", "el", "a", "al", "hacia", "y", "en")
PHRASE_STOPS = (
    "accidente", "percance", "colision", "choque", "atropello", "retiro", "genera", "genero", "provoca",
    "provoco", "impacta", "impacto", "involucra", "involucrados", "deja", "dejando", "fallece", "fallecio",
    "fallecido", "lesionado", "lesionada", "herido", "herida", "volqueta", "vehiculo", "vehiculos", "camion",
    "motocicleta", "motociclista", "bus", "microbus", "sedan", "pick", "rastra", "conductor", "conductora",
    "reportado", "registrado", "tras", "en", "a la altura", "frente", "cerca", "cercanias", "inmediaciones",
    "sentido", "sector", "antes", "despues", "rumbo", "hacia", "sobre", "por", "con", "contra",
)
# road words that begin a phrase in the capital area's form (patterns), and its kilometre rule
CAPITAL_ROAD_WORDS = (
    "carretera", "autopista", "bulevar", "boulevard", "avenida", r"av\.?", "calle", "ruta", "periferico", "bypass",
    "troncal",
)
CAPITAL_KM = r"\b(?:kilometro|km)\s*([0-9]+(?:\s*(?:1/2|1/4|3/4|½|¼|¾))?)"
# crossings named in a text: two roads each
CROSSING_PATTERNS = (
    r"interseccion de la? (.+?) y la? (.+?)(?:,|;| en |$)",
    r"interseccion de (.+?) y (.+?)(?:,|;| en |$)",
    r"(.+? avenida .+?) y (.+? calle .+?)(?:,|;| en |$)",
    r"(.+? calle .+?) y (.+? avenida .+?)(?:,|;| en |$)",
)
CAPITAL_PHRASE_STOPS = (
    "accidente", "percance", "colision", "choque", "atropello", "retiro", "genera", "involucra", "deja", "en",
    "a la altura", "frente", "cerca", "cercanias", "inmediaciones", "sentido", "sector", "antes", "despues",
    "rumbo", "hacia", "sobre", "por",
)
ROAD_TYPE_TERMS = (
    ("NACIONAL_ESTRUCTURANTE",
     ("autopista", "carretera", "troncal", "panamericana", "ruta", "periferico", "bypass")),
    ("ARTERIAL_URBANA", ("bulevar", "boulevard", "alameda", "paseo")),
)
NODE_TERMS = ("desvio", "retorno", "redondel", "semaforo")

# --- Fixed values: number words ----------------------------------------------
NUMBER_WORDS = {
    "un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5,
    "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
}

# --- Fixed values: severity terms --------------------------------------------
SEVERITY_TERMS = {
    "fatality_flag": ("fallecid", "muert", "fatal", "perdio la vida", "sin vida", "murio"),
    "injury_flag": ("lesion", "herid", "atendid", "trasladad"),
    "material_damage_only_flag": ("solo danos materiales", "sin heridos", "no dejo heridos"),
    "vulnerable_user_flag": ("motocic", "moto", "peaton", "atropell", "ciclist"),
    "motorcycle_flag": ("motocic", "moto"),
    "pedestrian_flag": ("peaton", "atropell"),
    "heavy_vehicle_flag": ("camion", "rastra", "furgon", "pipa", "bus", "microbus", "volqueta"),
    "obstruction_flag": ("carril", "paso", "carga vehicular", "cierre", "bloque", "derrame", "trafico"),
    "multi_vehicle_flag": ("multiple", "triple", "varios vehiculos", "tres vehiculos", "dos vehiculos"),
}
EARLY_SEVERITY_TERMS = {
    "fatality_flag": ("fallecid", "muert", "fatal", "perdio la vida", "sin vida", "murio"),
    "injury_flag": ("lesion", "herid", "atendid"),
    "material_damage_only_flag": ("solo danos materiales",),
    "vulnerable_user_flag": ("motocic", "moto", "peaton", "atropell", "ciclist"),
    "motorcycle_flag": ("motocic", "moto"),
    "pedestrian_flag": ("peaton", "atropell"),
    "heavy_vehicle_flag": ("camion", "rastra", "furgon", "pipa", "bus", "microbus"),
    "obstruction_flag": ("carril", "paso", "carga vehicular", "cierre", "bloque", "derrame", "arbol",
                         "desperfecto", "trafico"),
    "multi_vehicle_flag": ("multiple", "triple", "varios vehiculos", "tres vehiculos", "dos vehiculos",
                           "vehiculos involucrados"),
}
INJURY_WORDS, INJURY_STEMS = r"(?:lesionad\w*|herid\w*)", ("lesionad", "herid")
FATALITY_WORDS, FATALITY_STEMS = r"(?:fallecid\w*|muert\w*)", ("fallecid", "muert")
SEVERITY_BONUS = (
    ("vulnerable_user_flag", 0.08),
    ("pedestrian_flag", 0.04),
    ("motorcycle_flag", 0.03),
    ("heavy_vehicle_flag", 0.05),
    ("multi_vehicle_flag", 0.06),
    ("obstruction_flag", 0.03),
)
MULTI_EVENT_TERMS = (
    "diferentes percances", "varios accidentes", "varios percances",
    "al menos cinco lesionados en accidentes", "jornada de accidentes", "resumen",
)

# --- Fixed values: departments -----------------------------------------------
# (slug, name, iso, box)
DEPARTMENTS = (
    ("ahuachapan", "AHUACHAPAN", "SV-AH", (13.64, -90.14, 14.08, -89.65)),
    ("cabanas", "CABAÑAS", "SV-CA", (13.78, -88.98, 14.15, -88.48)),
    ("chalatenango", "CHALATENANGO", "SV-CH", (13.93, -89.45, 14.45, -88.70)),
    ("cuscatlan", "CUSCATLÁN", "SV-CU", (13.62, -89.15, 14.03, -88.78)),
    ("la_libertad", "LA LIBERTAD", "SV-LI", (13.42, -89.78, 14.06, -89.08)),
    ("la_paz", "LA PAZ", "SV-PA", (13.15, -89.14, 13.72, -88.70)),
    ("la_union", "LA UNION", "SV-UN", (13.15, -87.98, 13.80, -87.60)),
    ("morazan", "MORAZÁN", "SV-MO", (13.50, -88.35, 13.95, -87.70)),
    ("san_miguel", "SAN MIGUEL", "SV-SM", (13.12, -88.45, 13.82, -87.75)),
    ("san_salvador", "SAN SALVADOR", "SV-SS", (13.55, -89.42, 13.92, -89.00)),
    ("san_vicente", "SAN VICENTE", "SV-SV", (13.35, -88.95, 13.88, -88.45)),
    ("santa_ana", "SANTA ANA", "SV-SA", (13.75, -89.92, 14.46, -89.20)),
    ("sonsonate", "SONSONATE", "SV-SO", (13.49, -89.96, 13.93, -89.45)),
    ("usulutan", "USULUTÁN", "SV-US", (13.15, -88.75, 13.65, -88.05)),
)
DEPARTMENT_NAMES = {
    "cabanas": "CABAÑAS",
    "chalatenango": "CHALATENANGO",
    "cuscatlan": "CUSCATLÁN",
    "la libertad": "LA LIBERTAD",
    "la paz": "LA PAZ",
    "morazan": "MORAZÁN",
    "san miguel": "SAN MIGUEL",
    "san salvador": "SAN SALVADOR",
    "san vicente": "SAN VICENTE",
    "santa ana": "SANTA ANA",
    "sonsonate": "SONSONATE",
    "usulutan": "USULUTÁN",
}
MENTIONED_DEPARTMENTS = (
    "ahuachapan", "cabanas", "chalatenango", "cuscatlan", "la libertad", "la paz", "la union", "morazan",
    "san miguel", "san salvador", "san vicente", "santa ana", "sonsonate", "usulutan",
)
MUNICIPALITY_NAMES = {
    "antiguo cuscatlan": "Antiguo Cuscatlán",
    "armenia": "Armenia",
    "candelaria de la frontera": "Candelaria de la Frontera",
    "chalatenango": "Chalatenango",
    "ciudad arce": "Ciudad Arce",
    "ciudad delgado": "Ciudad Delgado",
    "colon": "Colón",
    "cuscatancingo": "Cuscatancingo",
    "cuscatlan norte": "Cuscatlán Norte",
    "el barillo": "El Barillo",
    "el transito": "El Tránsito",
    "ilobasco": "Ilobasco",
    "ilopango": "Ilopango",
    "izalco": "Izalco",
    "la libertad": "La Libertad",
    "la libertad centro": "La Libertad Centro",
    "la libertad sur": "La Libertad Sur",
    "la paz centro": "La Paz Centro",
    "los naranjos": "Los Naranjos",
    "los planes de renderos": "Los Planes de Renderos",
    "mejicanos": "Mejicanos",
    "nejapa": "Nejapa",
    "quezaltepeque": "Quezaltepeque",
    "san carlos": "San Carlos",
    "san francisco gotera": "San Francisco Gotera",
    "san juan opico": "San Juan Opico",
    "san luis talpa": "San Luis Talpa",
    "san miguel": "San Miguel",
    "san pablo tacachico": "San Pablo Tacachico",
    "san pedro perulapan": "San Pedro Perulapán",
    "san rafael cedros": "San Rafael Cedros",
    "san salvador": "San Salvador",
    "san salvador centro": "San Salvador Centro",
    "san salvador este": "San Salvador Este",
    "san salvador sur": "San Salvador Sur",
    "san vicente norte": "San Vicente Norte",
    "santa ana": "Santa Ana",
    "santa ana centro": "Santa Ana Centro",
    "santa maria": "Santa María",
    "santa tecla": "Santa Tecla",
    "santiago de maria": "Santiago de María",
    "santiago nonualco": "Santiago Nonualco",
    "sonsonate": "Sonsonate",
    "soyapango": "Soyapango",
}
CITY_DEPARTMENTS = {
    "AHUACHAPAN": ("ahuachapan", "atiquizaya", "apaneca", "tacuba", "turin", "san francisco menendez",
                   "cara sucia", "la hachadura"),
    "CABAÑAS": ("cabanas", "sensuntepeque", "ilobasco", "victoria", "dolores", "jutiapa", "tejutla"),
    "CHALATENANGO": ("chalatenango", "nueva concepcion", "la palma", "la reina", "tejutla", "agua caliente"),
    "CUSCATLÁN": ("cuscatlan", "cojutepeque", "san rafael cedros", "suchitoto", "el carmen",
                  "san pedro perulapan"),
    "LA LIBERTAD": ("la libertad", "santa tecla", "antiguo cuscatlan", "colon", "lourdes", "quezaltepeque",
                    "san juan opico", "sitio del nino", "ciudad arce", "nuevo cuscatlan", "san jose villanueva",
                    "zaragoza", "merliot", "talnique", "comasagua", "tamanique"),
    "LA PAZ": ("la paz", "zacatecoluca", "olocuilta", "santiago nonualco", "san pedro masahuat", "cuyultitan",
               "el rosario"),
    "LA UNION": ("la union", "santa rosa de lima", "conchagua", "pasaquina", "anamoros", "el sauce", "intipuca"),
    "MORAZÁN": ("morazan", "san francisco gotera", "jocoro", "el divisadero", "sociedad", "corinto", "osicala"),
    "SAN MIGUEL": ("san miguel", "moncagua", "chapeltique", "lolotique", "ciudad barrios", "chinameca", "quela",
                   "quelepa", "san jorge", "el transito", "sesori"),
    "SAN SALVADOR": ("san salvador", "soyapango", "apopa", "mejicanos", "ciudad delgado", "san marcos",
                     "san martin", "ilopango", "cuscatancingo", "planes de renderos", "san bartolo",
                     "ayutuxtepeque", "nejapa", "santo tomas", "aguilares", "tonacatepeque", "guazapa",
                     "panchimalco", "rosario de mora", "santiago texacuangos", "el paisnal", "colonia escalon",
                     "san benito", "flor blanca", "san jacinto", "zacamil"),
    "SAN VICENTE": ("san vicente", "apastepeque", "san ildefonso", "san lorenzo", "tecoluca", "verapaz",
                    "guadalupe"),
    "SANTA ANA": ("santa ana", "chalchuapa", "el congo", "metapan", "coatepeque", "candelaria de la frontera"),
    "SONSONATE": ("sonsonate", "sonzacate", "acajutla", "izalco", "juayua", "nahuizalco",
                  "san antonio del monte", "armenia"),
    "USULUTÁN": ("usulutan", "jiquilisco", "santiago de maria", "santa maria", "concepcion batres",
                 "mercedes umana", "el triunfo", "ereguayquin", "santa elena", "ozatlan", "jucuapa"),
}

# --- Fixed values: capital area ----------------------------------------------
CAPITAL_CORE = (
    "san salvador", "san salvador centro", "san salvador este", "san salvador oeste", "san salvador norte",
    "soyapango", "ciudad delgado", "mejicanos", "apopa", "nejapa", "guazapa", "cuscatancingo",
    "ayutuxtepeque", "ilopango", "san martin", "tonacatepeque", "san marcos", "panchimalco", "santo tomas",
    "santiago texacuangos",
)
CAPITAL_EXTENDED = ("santa tecla", "antiguo cuscatlan", "la libertad sur", "merliot")
CAPITAL_HINTS = (
    "san salvador", "soyapango", "ciudad delgado", "mejicanos", "apopa", "nejapa", "guazapa", "zacamil",
    "metrocentro", "fenadesal", "terminal de oriente", "terminal del sur", "salvador del mundo",
    "san jacinto", "escalon", "universidad de el salvador", "bulevar del ejercito",
    "boulevard del ejercito", "carretera de oro", "boulevard constitucion", "bulevar constitucion",
    "avenida bernal", "autopista norte", "troncal del norte",
)
# (sub-area, municipalities, text terms), first hit wins
CAPITAL_SUBAREAS = (
    ("ESTE", ("soyapango", "ilopango", "san martin", "san salvador este"), ()),
    ("NORTE", ("apopa", "nejapa", "guazapa", "ciudad delgado", "cuscatancingo", "ayutuxtepeque"), ()),
    ("NORTE-OESTE", ("mejicanos",), ("zacamil",)),
    ("OESTE", ("santa tecla", "antiguo cuscatlan", "la libertad sur"),
     ("merliot", "escalon", "salvador del mundo", "constitucion")),
    ("SUR", (), ("san jacinto", "planes de renderos", "panchimalco", "terminal del sur", "comalapa")),
    ("CENTRO", ("san salvador", "san salvador centro"),
     ("centro de san salvador", "metrocentro", "avenida bernal")),
    ("ESTE", (), ("carretera de oro", "bulevar del ejercito", "boulevard del ejercito")),
    ("NORTE", (), ("troncal del norte", "autopista norte")),
)

# --- Fixed values: alerts ----------------------------------------------------
ALERT_TYPE_LABELS = {
    "ACCIDENT": "Accidente",
    "ROAD_CLOSED": "Cierre vial",
    "JAM": "Congestion reportada",
    "HAZARD": "Peligro vial",
}
ALERT_SUBTYPE_LABELS = {
    "ACCIDENT_MAJOR": "Accidente mayor",
    "JAM_HEAVY_TRAFFIC": "Trafico pesado",
    "JAM_STAND_STILL_TRAFFIC": "Trafico detenido",
    "HAZARD_ON_SHOULDER_CAR_STOPPED": "Vehiculo detenido en hombro",
    "HAZARD_ON_ROAD_LANE_CLOSED": "Carril cerrado",
    "HAZARD_ON_ROAD_POT_HOLE": "Bache",
    "HAZARD_ON_ROAD": "Peligro en via",
    "HAZARD_ON_ROAD_CONSTRUCTION": "Construccion en via",
    "HAZARD_ON_ROAD_OBJECT": "Objeto en via",
    "HAZARD_ON_ROAD_CAR_STOPPED": "Vehiculo detenido en via",
    "HAZARD_WEATHER": "Clima",
    "HAZARD_WEATHER_FLOOD": "Inundacion",
    "HAZARD_WEATHER_FOG": "Neblina",
    "HAZARD_ON_ROAD_ICE": "Superficie deslizante",
    "HAZARD_ON_ROAD_TRAFFIC_LIGHT_FAULT": "Falla de semaforo",
}
# (type, subtype fragments, group); first hit wins, no fragments = the rest of the type
ALERT_GROUPS = (
    ("ACCIDENT", (), "ACCIDENTE"),
    ("ROAD_CLOSED", (), "CIERRE_VIAL"),
    ("JAM", ("STAND_STILL",), "TRAFICO_DETENIDO"),
    ("JAM", ("HEAVY",), "TRAFICO_PESADO"),
    ("JAM", (), "CONGESTION_REPORTADA"),
    ("HAZARD", ("POT_HOLE",), "BACHE"),
    ("HAZARD", ("LANE_CLOSED", "CONSTRUCTION"), "OBRA_CARRIL_CERRADO"),
    ("HAZARD", ("CAR_STOPPED",), "VEHICULO_DETENIDO"),
    ("HAZARD", ("OBJECT",), "OBJETO_EN_VIA"),
    ("HAZARD", ("TRAFFIC_LIGHT",), "FALLA_SEMAFORO"),
    ("HAZARD", ("WEATHER", "FLOOD", "FOG", "ICE"), "CLIMA_RIESGO"),
    ("HAZARD", (), "PELIGRO_EN_VIA"),
)
ALERT_SEVERITY = (
    ("ROAD_CLOSED", (), 92.0),
    ("ACCIDENT", ("MAJOR",), 96.0),
    ("ACCIDENT", (), 88.0),
    ("JAM", ("STAND_STILL",), 76.0),
    ("JAM", ("HEAVY",), 66.0),
    ("JAM", (), 56.0),
    ("HAZARD", ("LANE_CLOSED",), 72.0),
    ("HAZARD", ("CONSTRUCTION",), 62.0),
    ("HAZARD", ("CAR_STOPPED",), 58.0),
    ("HAZARD", ("TRAFFIC_LIGHT",), 64.0),
    ("HAZARD", ("FLOOD",), 78.0),
    ("HAZARD", ("ICE",), 70.0),
    ("HAZARD", ("OBJECT",), 55.0),
    ("HAZARD", ("POT_HOLE",), 48.0),
    ("HAZARD", ("WEATHER", "FOG"), 52.0),
    ("HAZARD", (), 50.0),
)
CRITICAL_GROUPS = ("ACCIDENTE", "CIERRE_VIAL", "TRAFICO_DETENIDO")
SAFETY_GROUPS = ("ACCIDENTE", "PELIGRO_EN_VIA", "BACHE", "VEHICULO_DETENIDO", "OBJETO_EN_VIA", "CLIMA_RIESGO")
OPERATIONAL_GROUPS = ("CIERRE_VIAL", "TRAFICO_DETENIDO", "TRAFICO_PESADO", "OBRA_CARRIL_CERRADO", "FALLA_SEMAFORO")

# --- Fixed values: match confidence ------------------------------------------
CONFIDENCE_SCORES = {"HIGH": 1.0, "MEDIUM": 0.66, "LOW": 0.33, "UNRESOLVED": 0.0}

# --- Fixed values: distance classes (upper bound in metres, label) -----------
ALERT_DISTANCE = ((50, "SPATIAL_HIGH"), (150, "SPATIAL_MEDIUM"), (500, "SPATIAL_LOW_REVIEW"))
ALERT_DISTANCE_FAR = "SPATIAL_FAR_REVIEW"
ALERT_DISTANCE_SCORE = {"SPATIAL_HIGH": 1.0, "SPATIAL_MEDIUM": 0.75, "SPATIAL_LOW_REVIEW": 0.45,
                        "SPATIAL_FAR_REVIEW": 0.15}
INCIDENT_DISTANCE = ((50, "SPATIAL_OSM_HIGH"), (150, "SPATIAL_OSM_MEDIUM"), (500, "SPATIAL_OSM_LOW_REVIEW"))
INCIDENT_DISTANCE_FAR = "SPATIAL_OSM_DISTANCE_CONFLICT"
NAMED_DISTANCE = (
    (50, "RECUPERABLE_NAMED_SEGMENT_<=50M"),
    (150, "RECUPERABLE_NAMED_SEGMENT_<=150M"),
    (300, "POTENCIAL_NAMED_SEGMENT_<=300M"),
    (500, "BAJA_CONFIANZA_NAMED_SEGMENT_<=500M"),
    (750, "MUY_BAJA_CONFIANZA_NAMED_SEGMENT_<=750M"),
)
NAMED_DISTANCE_FAR = "NO_NAMED_SEGMENT_WITHIN_750M"
EARLY_DISTANCE = ((30, "HIGH"), (50, "MEDIUM"), (100, "LOW"))
EARLY_DISTANCE_FAR = "REVIEW"

# --- Fixed values: event score component maps --------------------------------
GEO_COMPONENT = {
    "VALID_POINT": 100,
    "VALID_POINT_REPEATED_COORDINATE": 85,
    "LOW_GEO_CONFIDENCE_POINT": 55,
    "MISSING_POINT": 25,
    "OUTSIDE_EL_SALVADOR_BBOX": 5,
}
ROAD_COMPONENT = {
    "SPATIAL_OSM_HIGH": 100,
    "SPATIAL_OSM_MEDIUM": 75,
    "SPATIAL_OSM_LOW_REVIEW": 50,
    "OUTSIDE_AMSS_OSM_SCOPE": 35,
    "NO_COORDINATE_FOR_OSM": 20,
    "INVALID_POINT_FOR_OSM": 10,
    "NO_NEAR_OSM_SEGMENT": 15,
    "SPATIAL_OSM_DISTANCE_CONFLICT": 20,
    "NO_OSM_NETWORK_FOR_POINT": 15,
    "OSM_SEGMENTS_MISSING": 10,
}
EVENT_SCORE_WEIGHTS = (
    ("severity_component", 0.20),
    ("mentions_component", 0.16),
    ("source_diversity_component", 0.12),
    ("impact_social_component", 0.22),
    ("geo_quality_component", 0.14),
    ("osm_association_component", 0.10),
    ("temporal_recency_component", 0.06),
)
EVENT_SCORE_CLASSES = ((20, "BAJA"), (40, "MODERADA"), (60, "RELEVANTE"), (80, "ALTA"), (100, "CRITICA"))

# --- Fixed values: road classes ----------------------------------------------
ROAD_CLASSES = (
    ("NACIONAL_ESTRUCTURANTE", ("motorway", "trunk", "motorway link", "trunk link")),
    ("ARTERIAL_PRINCIPAL", ("primary", "primary link")),
    ("ARTERIAL_SECUNDARIA", ("secondary", "secondary link")),
    ("COLECTORA", ("tertiary", "tertiary link")),
    ("LOCAL_RESIDENCIAL", ("residential", "living street")),
    ("SERVICIO_ACCESO", ("service",)),
    ("NO_CLASIFICADA_OSM", ("unclassified",)),
)
ROAD_CLASS_OTHER = "OTRA"
ROAD_HIERARCHY = {
    "NACIONAL_ESTRUCTURANTE": 1.00,
    "ARTERIAL_PRINCIPAL": 0.86,
    "ARTERIAL_SECUNDARIA": 0.72,
    "COLECTORA": 0.56,
    "NO_CLASIFICADA_OSM": 0.45,
    "LOCAL_RESIDENCIAL": 0.28,
    "SERVICIO_ACCESO": 0.18,
}
ROAD_HIERARCHY_DEFAULT = 0.45
MAJOR_HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link", "primary_link",
                  "secondary_link")
GENERIC_ROAD_KEYS = ("", "calle", "avenida", "boulevard", "bulevar", "pasaje", "calle principal",
                     "avenida principal", "pasaje s n", "senda", "senda s n", "carretera", "camino",
                     "calle antigua")

# --- Fixed values: weight profiles -------------------------------------------
PROFILE_COLUMNS = ("events", "severity_sum", "fatality_events", "injury_events", "vulnerable_events",
                   "mentions", "impact_social", "osm_high_medium")
WEIGHT_PROFILES = {
    "ACTUAL_PIPELINE": {
        "events": 0.24, "mentions": 0.14, "impact_social": 0.18, "severity_sum": 0.16,
        "fatality_events": 0.10, "injury_events": 0.07, "vulnerable_events": 0.05, "osm_high_medium": 0.06},
    "A_RECURRENCIA_VOLUMEN": {
        "events": 0.40, "severity_sum": 0.18, "fatality_events": 0.10, "injury_events": 0.07,
        "vulnerable_events": 0.05, "mentions": 0.08, "impact_social": 0.07, "osm_high_medium": 0.05},
    "B_SEVERIDAD": {
        "events": 0.16, "mentions": 0.06, "impact_social": 0.08, "severity_sum": 0.25,
        "fatality_events": 0.20, "injury_events": 0.12, "vulnerable_events": 0.08, "osm_high_medium": 0.05},
    "C_SOCIAL_NOTICIOSO": {
        "events": 0.14, "mentions": 0.25, "impact_social": 0.35, "severity_sum": 0.08,
        "fatality_events": 0.05, "injury_events": 0.04, "vulnerable_events": 0.03, "osm_high_medium": 0.06},
}
PROFILE_LABELS = {
    "ACTUAL_PIPELINE": "Score actual del pipeline exploratorio",
    "A_RECURRENCIA_VOLUMEN": "Escenario A: recurrencia y volumen",
    "B_SEVERIDAD": "Escenario B: severidad vial",
    "C_SOCIAL_NOTICIOSO": "Escenario C: amplificacion social/noticiosa",
}

# --- Fixed values: reference study -------------------------------------------
# reference: (shown as, corridor, group, scope, prior decision)
TARGET_REFS = {
    "rn 10": ("RN 10", "RN 10 - El Congo / Izalco", "NACIONAL_REGIONAL", "CORREDOR_ESTRUCTURANTE",
              "SEMI_CURADA_MEDIA"),
    "rn 17": ("RN 17", "RN 17 - Carretera El Delirio", "NACIONAL_REGIONAL", "CORREDOR_ESTRUCTURANTE",
              "SEMI_CURADA_ALTA"),
    "san 16": ("SAN 16", "SAN 16 - Chalchuapa / La Magdalena / El Coco", "DEPARTAMENTAL_LOCAL",
               "REFERENCIA_DEPARTAMENTAL", "SEMI_CURADA_ALTA"),
    "rn 12": ("RN 12", "Ruta a Los Naranjos", "NACIONAL_REGIONAL", "CORREDOR_ESTRUCTURANTE",
              "SEMI_CURADA_ALTA"),
    "san 24": ("SAN 24", "SAN 24 - El Congo / Santa Ana", "DEPARTAMENTAL_LOCAL", "REFERENCIA_DEPARTAMENTAL",
               "SEMI_CURADA_MEDIA"),
}
NODE_NAME_TERMS = ("redonel", "redondel", "rotonda", "roundabout")

# --- Fixed values: unresolved-case clues -------------------------------------
ROAD_TERM_PATTERN = (
    r"(?i)\b(carretera|autopista|calle|avenida|alameda|boulevard|bulevar|bypass|by ?pass|redondel|"
    r"desvio|desvío|km|kilometro|kilómetro|pasarela|puente|sentido|via|vía|tramo|periferico|periférico)\b"
)
TEXT_CLUES = (
    ("direccion_general", r"(?i)\b(sentido|subiendo|bajando|conduce|conecta|hacia)\b"),
    ("referencia_lugar",
     r"(?i)\b(frente|altura|cerca|zona|centro|caserio|caserío|desvio|desvío|restaurante|colegio|vidri|walmart|motel)\b"),
    ("infraestructura",
     r"(?i)\b(carretera|calle|avenida|bypass|by ?pass|via|vía|puente|km|kil[oó]metro)\b"),
)
NO_TEXT_CLUE = "SIN_PISTA_VIAL_TEXTUAL"

# --- Fixed values: geocode classes -------------------------------------------
GEOCODE_ROAD = ("road", "residential", "primary", "secondary", "tertiary", "trunk", "motorway", "unclassified",
                "route")
GEOCODE_POI = ("school", "hospital", "fuel", "bus_station", "station", "marketplace", "commercial")
GEOCODE_POI_CLASS = ("amenity", "shop", "building", "tourism")
GEOCODE_ADMIN = ("city", "town", "village", "municipality", "county", "state", "administrative")

# --- Fixed values: fitness ---------------------------------------------------
TEXT_MATCH_OK = ("TEXT_MATCH_ACCEPTED", "TEXT_MATCH_REVIEW", "WEAK_TEXT_MATCH_REVIEW")
SPATIAL_MATCH_OK = (
    "SPATIAL_TEXT_HIGH", "SPATIAL_TEXT_MEDIUM", "SPATIAL_TEXT_LOW_REVIEW", "SPATIAL_TEXT_REVIEW_MEDIUM",
    "SPATIAL_TEXT_REVIEW_LOW", "SPATIAL_NEAREST_ONLY_REVIEW", "TEXTUAL_CORRIDOR_ONLY",
    "TEXTUAL_CORRIDOR_REVIEW_ONLY",
)
FITNESS_WEIGHTS = (
    ("clasificabilidad_evento", 0.18),
    ("severidad_identificable", 0.18),
    ("preparacion_espacial", 0.20),
    ("asociacion_vial_osm", 0.20),
    ("confiabilidad_informativa", 0.14),
    ("control_sesgo_cobertura", 0.10),
)
REVIEW_STRATA = ("SPATIAL_TEXT_HIGH", "SPATIAL_TEXT_MEDIUM", "TEXTUAL_CORRIDOR_ONLY",
                 "TEXT_MATCH_DISTANCE_CONFLICT", "TEXTUAL_CORRIDOR_REVIEW_ONLY", "NO_SPATIAL_INPUT")
REVIEW_ANSWERS = ("manual_event_is_vial", "manual_severity_correct", "manual_geocode_correct",
                  "manual_road_match_correct", "manual_accept_for_metric", "manual_notes")

# --- Fixed values: issue codes, in the order in which the conditions are listed -
JAM_ISSUES = (
    "UNRESOLVED", "UNRESOLVED_HIGH_IMPACT", "TEXT_STREET_NOT_IN_OSM", "NODE_CONTEXT_USED_AS_CORRIDOR",
    "LOW_CONFIDENCE_HIGH_IMPACT", "REFERENCE_WITHOUT_FUNCTIONAL_NAME", "SAME_STREET_MULTIPLE_CORRIDORS",
    "SAME_REF_MULTIPLE_CORRIDORS",
)
ALERT_ISSUES = (
    "UNRESOLVED", "UNRESOLVED_HIGH_IMPACT", "LOW_SPATIAL_CONFIDENCE", "TEXT_OSM_CORRIDOR_MISMATCH", "MISSING_CITY",
    "MISSING_STREET", "LOW_CONFIDENCE_HIGH_IMPACT",
)

# --- Fixed values: decision codes of the reference study, first hit wins ------
REFERENCE_DECISIONS = (
    "NORMALIZABLE_SEMI_AUTOMATICO", "NORMALIZABLE_CON_ALIAS_CURADO", "NORMALIZABLE_POR_FAMILIA_REF_CON_VALIDACION",
    "FAMILIA_REF_SIN_NOMBRE_FUNCIONAL", "NORMALIZABLE_SOLO_CON_VALIDACION", "CONSERVAR_REF_TECNICA", "SIN_EVIDENCIA_LOCAL",
)

# --- Fixed values: readiness by spatial level (status, weight) ----------------
READINESS = {
    "POINT": ("USABLE_PARA_METRICA_ESPACIAL", 1.0),
    "ADDRESS_TEXT": ("USABLE_CON_GEOCODIFICACION", 0.75),
    "MUNICIPALITY": ("USABLE_PARA_METRICA_TERRITORIAL", 0.45),
    "DEPARTMENT": ("USABLE_PARA_METRICA_TERRITORIAL", 0.45),
    "MULTI_LOCATION_NEWS": ("USABLE_SOLO_COMO_CONTEXTO", 0.20),
    "TEXT_ONLY": ("REQUIERE_EXTRACCION_GEOESPACIAL", 0.25),
}
NOT_READY = ("NO_USABLE_TODAVIA", 0.10)

# --- Fixed values: maturity of the input variables (name, column, class) ------
MATURITY = (
    ("fecha_hora_evento", "datetime", "USABLE_AHORA"), ("tipo_incidente", "incident", "USABLE_AHORA"),
    ("texto_observacion", "observation", "USABLE_AHORA_CON_NLP_SIMPLE"), ("menciones", "mentions", "USABLE_AHORA"),
    ("fuentes_distintas", "source_diversity", "USABLE_AHORA"), ("severidad_preliminar", "severity_score", "USABLE_CON_VALIDACION"),
    ("lesionados", "injury_flag", "USABLE_CON_VALIDACION"), ("fallecidos", "fatality_flag", "USABLE_CON_VALIDACION_PRIORITARIA"),
    ("usuarios_vulnerables", "vulnerable_user_flag", "USABLE_CON_VALIDACION"),
    ("departamento", "department", "USABLE_AHORA_TERRITORIAL"), ("municipio", "municipality", "USABLE_AHORA_TERRITORIAL"),
    ("direccion_textual", "address", "USABLE_CON_GEOCODIFICACION"),
    ("latitud_longitud", "latitude_num", "INSUFICIENTE_PARA_ANALISIS_VIAL_MASIVO"),
    ("confianza_geografica", "geo_confidence", "USABLE_AHORA_COMO_CONTROL"),
    ("calidad_del_dato", "data_quality_score", "USABLE_AHORA_COMO_INDICADOR_INTERNO"),
)
