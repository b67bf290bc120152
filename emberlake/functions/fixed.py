"""Vocabularies, thresholds and labels the results depend on.

Everything in this file must have exactly these values for the results to be
right. They are kept as plain text, in their natural order.
"""

# Event vocabulary, first matching rule wins.
EVENT_TERMS = {
    "confinement_lift": [
        "aixeca el confinament", "levanta el confinamiento", "levantado el confinamiento",
        "fin do confinamento", "konfinamendua amaitu",
    ],
    "evacuation_lift": [
        "aixeca l'evacuacio", "levantada la evacuacion", "fin de la evacuacion", "ebakuazioa amaitu",
    ],
    "evacuation_expansion": [
        "amplia l'evacuacio", "amplia la evacuacion", "nuevas evacuaciones", "ebakuazioa zabaldu",
    ],
    "confinement_order": [
        "ordre de confinament", "orden de confinamiento", "confineu-vos", "confinense", "konfinatzeko agindua",
    ],
    "evacuation_order": [
        "ordre d'evacuacio", "orden de evacuacion", "evacueu", "evacuen", "ebakuatzeko agindua",
    ],
    "es_alert_test": ["simulacre es-alert", "simulacro es-alert", "proba es-alert", "es-alert proba"],
    "es_alert_cancelled": [
        "cancel·lat es-alert", "cancelado es-alert", "es-alert cancelada", "es-alert bertan behera",
    ],
    "es_alert_sent": [
        "enviat un es-alert", "enviado un es-alert", "ha enviado es-alert", "s'ha enviat es-alert", "es-alert bidali",
    ],
    "es_alert_received": [
        "he rebut es-alert", "hem rebut es-alert", "recibido es-alert", "me ha llegado es-alert", "es-alert jaso",
    ],
    "es_alert_announcement": [
        "s'enviara un es-alert", "se enviara un es-alert", "previsto enviar es-alert", "es-alert enviarase",
    ],
    "plan_deactivation": ["desactiva el pla", "desactiva el plan", "plan desactivado", "plana desaktibatu"],
    "plan_activation": ["activa el pla", "activa el plan", "plan activado", "plana aktibatu"],
    "plan_update": ["actualitza el pla", "actualiza el plan", "actualizacion del plan", "planaren eguneraketa"],
    "emergency_deactivation": [
        "desactiva l'emergencia", "desactiva la emergencia", "fin de la emergencia de interes",
    ],
    "emergency_activation": [
        "declara l'emergencia", "declara la emergencia", "emergencia de interes nacional", "larrialdi egoera",
    ],
    "risk_alert_update": [
        "alerta per risc", "alerta por riesgo", "aviso por riesgo", "alerta activada", "alerta activa",
    ],
    "fire_extinguished": [
        "extinguido", "extinguida", "extingit", "extingida", "lume extinguido", "baso-sutea itzalita",
    ],
    "firefighting_update": [
        "tasques d'extincio", "labores de extincion", "consolidar el perimetre", "consolidar el perimetro",
        "eixos de contencio", "lineas de contencion", "incendio declarado", "incendi declarat",
        "incendio activo", "incendi actiu", "incendio estabilizado", "incendi estabilitzat",
        "incendio controlado", "incendi controlat", "dotaciones de bomberos", "dotacions de bombers",
        "medios de extincion", "mitjans d'extincio", "medios aereos", "mitjans aeris",
        "trabajan en la extincion", "treballen en l'extincio", "evolucion del incendio", "evolucio de l'incendi",
        "perimetro del incendio", "perimetre de l'incendi", "incendi de vegetacio", "incendio de vegetacion",
        "incendi forestal", "incendio forestal", "foc forestal", "fuego forestal",
    ],
}

# Risk vocabulary, first matching rule wins.
RISK_TERMS = {
    "wildfire": [
        "incendi forestal", "incendio forestal", "incendi de vegetacio", "incendio de vegetacion",
        "foc forestal", "fuego forestal", "lume forestal", "baso-sute",
    ],
    "flood": ["inundacio", "inundacion", "riada", "uholde", "enchente"],
    "chemical": ["risc quimic", "riesgo quimico", "fuga quimica", "nube toxica", "arrisku kimiko"],
    "weather": ["tempesta", "tormenta", "nevades", "nevadas", "fenomeno meteorologico", "ekaitz"],
    "nuclear": ["nuclear", "radiologic", "radiologico", "erradiologiko"],
}

# Sentences carrying one of these are instructions.
INSTRUCTION_TERMS = [
    "confineu-vos", "confinense", "permanezca", "romangueu", "evacueu", "evacuen", "no se acerque",
    "no us acosteu", "siga las indicaciones", "seguiu les indicacions", "itxi ateak", "peche portas",
]

# Marker words per language, padded with spaces when searched.
LANGUAGE_MARKERS = {
    "ca": ["els", "les", "amb", "confinament", "incendi", "proteccio", "enviat", "confineu-vos"],
    "es": ["los", "las", "del", "confinamiento", "incendio"],
    "eu": ["eta", "sute", "udalerri", "ebakuazio", "larrialdi"],
    "gl": ["unha", "incendio", "concello", "evacuacion", "emerxencia"],
}

# Names and tokens left out of matching.
EXCLUDED_PLACES = ["agost"]
TRAILING_ARTICLES = ["el", "la", "els", "les", "los", "las", "o", "a"]
TITLE_STOP_TOKENS = [
    "alert", "emergencia", "emergency", "actualitzacio", "actualizacion", "incendi", "incendio",
]
WILDFIRE_TOKENS = ["incendi", "incendio", "forestal", "baso sute", "#if"]
PAGE_TITLE_KEYWORDS = [
    "es-alert", "emerg", "incendi", "evac", "confin", "inund", "112", "proteccion civil", "proteccio civil",
]

# Evidence rank and confidence by publication source type.
EVIDENCE_RANK = {"official": 1, "reliable_media": 2, "multiple_witnesses": 3, "individual": 4}
EVIDENCE_CONFIDENCE = {1: 0.96, 2: 0.78, 3: 0.62, 4: 0.30}
WITNESS_QUORUM = 3

# Confidence score weights, provenance scores and caps.
CONFIDENCE_WEIGHTS = {
    "source_authority": 0.2, "officiality": 0.2, "freshness": 0.2, "delay": 0.1,
    "geometry_quality": 0.15, "input_availability": 0.1, "coherence": 0.05,
}
OFFICIALITY = {"official": 1.0, "observed": 0.65, "estimated": 0.45, "unverified": 0.25}
PROVENANCE_CAP = {"official": 1.0, "observed": 0.88, "estimated": 0.79, "unverified": 0.55}
FRESHNESS_STEPS = [(1, 1.0), (6, 0.85), (24, 0.65), (72, 0.35)]
FRESHNESS_FLOOR, FRESHNESS_UNKNOWN = 0.15, 0.45
DELAY_STEPS = [(1, 1.0), (6, 0.75), (24, 0.45)]
DELAY_FLOOR, DELAY_UNKNOWN = 0.2, 0.75
CONFIDENCE_CATEGORIES = [(0.8, "high"), (0.55, "medium"), (0.3, "low")]
CONFIDENCE_VERSION = "confidence-v1"

# Windows and radii.
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
LINK_DISTANCE_M, LINK_MINUTES = 2500.0, 180.0
MATCH_WINDOW_DAYS = 14
FIRE_LINK_DISTANCE_M, FIRE_LINK_DAYS_BEFORE = 5000.0, 2
GROUP_MAX_DISTANCE_M, GROUP_MAX_DAYS = 50_000.0, 7
SPAIN_BBOX = (-10.0, 35.5, 4.5, 44.5)

# Traffic vocabulary (source code -> label).
CAUSE_LABELS = {
    "abnormalTraffic": "Transit anormal",
    "accident": "Accident",
    "environmentalObstruction": "Obstacle ambiental",
    "infrastructureDamage": "Dany a la infraestructura",
    "obstruction": "Obstacle",
    "poorEnvironmentConditions": "Condicions ambientals adverses",
    "roadMaintenance": "Obres o manteniment",
}
DETAIL_LABELS = {"fire": "Incendi", "roadworks": "Obres", "vehicleOnFire": "Vehicle incendiat"}
LANE_LABELS = {
    "allLanesCompleteCarriageway": "Tots els carrils",
    "leftLane": "Carril esquerre",
    "rightLane": "Carril dret",
    "middleLane": "Carril central",
    "hardShoulder": "Vorera",
}
DIRECTION_LABELS = {
    "both": "Ambdós sentits", "positive": "Sentit creixent",
    "negative": "Sentit decreixent", "unknown": "Desconegut",
}
SERVICE_LABELS = {"low": "Verd", "medium": "Groc", "high": "Vermell", "highest": "Negre"}
TRAFFIC_CATEGORIES = [
    ("CARRETERAS CORTADAS", ["roadclosed", "road closed", "carriagewayclosed", "closed", "closure"]),
    ("TRÁFICO LENTO", ["slow", "congestion", "queue", "stationarytraffic", "heavilycongested"]),
    ("CIRCULACIÓN RESTRINGIDA",
     ["restriction", "restricted", "weightrestriction", "heightrestriction", "do not use", "narrowlanes"]),
    ("DESVÍOS Y EMBOLSAMIENTOS", ["diversion", "detour", "rerouting", "holding", "embolsamiento"]),
]
TRAFFIC_CATEGORY_DEFAULT = "OTRAS AFECCIONES"

# Eight compass points in degrees.
COMPASS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}

# Wire formats of the feeds.
DETECTION_REQUIRED = ["latitude", "longitude", "acq_date", "acq_time", "satellite", "confidence", "frp"]
TRAFFIC_MAP_XOR_KEY = 0x66
WAY_TAGS = ["highway", "surface", "width", "access", "maxweight", "incline", "tracktype", "smoothness"]
PLAN_AREA_BBOX = "0.15,40.5,3.35,42.9"

# Ending of the external id of an incident made from a perimeter, metadata keys that reconciliation derives anew.
OWN_INCIDENT_ENDING = ":incident"
DERIVED_FIRE_KEYS = [
    "merged_into", "hidden", "reconciliation_score", "reconciliation_reasons", "merged_incident_ids", "reconciliation_matches", "hashtags", "primary_hashtag",
    "affected_locations", "evidence_sources",
]
