"""Names, coordinates, lists and thresholds results depend on."""

# ---- fixed values: province capitals (latitude, longitude), final method ----
PROVINCES = {
    "AZUAY": (-2.9001, -79.0059),
    "BOLIVAR": (-1.5905, -79.0007),
    "CANAR": (-2.7396, -78.8484),
    "CARCHI": (0.8117, -77.7178),
    "CHIMBORAZO": (-1.6635, -78.6546),
    "COTOPAXI": (-0.9333, -78.6167),
    "EL ORO": (-3.2581, -79.9554),
    "ESMERALDAS": (0.9592, -79.6539),
    "GALAPAGOS": (-0.9020, -89.6100),
    "GUAYAS": (-2.1709, -79.9224),
    "IMBABURA": (0.3517, -78.1223),
    "LOJA": (-3.9931, -79.2042),
    "LOS RIOS": (-1.8022, -79.5344),
    "MANABI": (-1.0546, -80.4545),
    "MORONA SANTIAGO": (-2.3086, -78.1170),
    "NAPO": (-0.9938, -77.8129),
    "ORELLANA": (-0.4625, -76.9868),
    "PASTAZA": (-1.4869, -78.0031),
    "PICHINCHA": (-0.1807, -78.4678),
    "SANTA ELENA": (-2.2267, -80.8583),
    "SANTO DOMINGO DE LOS TSACHILAS": (-0.2542, -79.1750),
    "SUCUMBIOS": (0.0869, -76.8934),
    "TUNGURAHUA": (-1.2417, -78.6197),
    "ZAMORA CHINCHIPE": (-4.0692, -78.9567),
}

# ---- fixed values: province centroids used by the first round ----
PROVINCES_FIRST_ROUND = {
    "AZUAY": (-2.900, -79.005),
    "BOLIVAR": (-1.594, -79.001),
    "CANAR": (-2.554, -78.939),
    "CARCHI": (0.812, -77.717),
    "CHIMBORAZO": (-1.664, -78.654),
    "COTOPAXI": (-0.933, -78.616),
    "EL ORO": (-3.259, -79.961),
    "ESMERALDAS": (0.968, -79.652),
    "GALAPAGOS": (-0.744, -90.314),
    "GUAYAS": (-2.190, -79.889),
    "IMBABURA": (0.350, -78.122),
    "LOJA": (-3.993, -79.204),
    "LOS RIOS": (-1.803, -79.535),
    "MANABI": (-1.055, -80.454),
    "MORONA SANTIAGO": (-2.308, -78.117),
    "NAPO": (-0.994, -77.813),
    "ORELLANA": (-0.462, -76.987),
    "PASTAZA": (-1.487, -78.002),
    "PICHINCHA": (-0.225, -78.512),
    "SANTA ELENA": (-2.227, -80.859),
    "SANTO DOMINGO DE LOS TSACHILAS": (-0.253, -79.175),
    "SUCUMBIOS": (0.087, -76.888),
    "TUNGURAHUA": (-1.241, -78.620),
    "ZAMORA CHINCHIPE": (-4.068, -78.955),
}

# ---- fixed values: province spellings folded into the names above ----
PROVINCE_ALIASES = {
    "SANTO DOMINGO": "SANTO DOMINGO DE LOS TSACHILAS",
    "SANTO DOMINGO DE LOS TSACHILA": "SANTO DOMINGO DE LOS TSACHILAS",
    "STO DOMINGO DE LOS TSACHILAS": "SANTO DOMINGO DE LOS TSACHILAS",
    "CANIAR": "CANAR",
}

EARTH_RADIUS_KM = 6371.0088

# ---- fixed values: labels ----
CATALOGUE = "Catalogo Electronico"
CATALOGUE_FIRST_ROUND = "Catálogo Electrónico"
OTHER_MODALITY = "Otros"
NO_DATA = "(sin dato)"
KEPT_MODALITIES = 8
COMPETITIVE_MODALITIES = [
    "Subasta Inversa Electrónica",
    "Menor Cuantía",
    "Cotización",
    "Licitación",
    "Contratacion directa",
]
PRIORITY_PROVINCES = ["GUAYAS", "PICHINCHA"]

# ---- fixed values: stop words of the first round's text model ----
STOP_WORDS = [
    "de", "la", "el", "los", "las", "y", "en", "para", "con", "por", "del", "al",
    "un", "una", "unos", "unas", "a", "o", "que", "se", "su", "sus", "e", "u",
    "servicio", "servicios", "adquisicion", "adquisición",
]

# ---- fixed values: model variables and weights ----
NUMERIC = [
    "distance_km",
    "code_jaccard4",
    "text_sim",
    "budget_deviation",
    "buyer_code_activity",
    "buyer_affinity",
]
CATEGORY = "modality"
CATEGORY_WEIGHT = 1.0 / 3.0
ALGORITHMS = ["kprototypes", "kmeans", "hierarchical", "kmedoids", "density", "gmm"]

# ---- fixed values: thresholds ----
SEED = 42
SAMPLE_SIZE = 3000
K_RANGE = range(3, 11)
VOCABULARY = 5000
WINSOR = (0.01, 0.99)
MAX_CATALOGUE_SHARE = 0.60
MIN_COMPETITIVE_AWARDS = 30
MIN_CODES = 5
REDUNDANT_R = 0.95
COLLINEAR_R = 0.999
NEAR_CONSTANT = 0.98
RECODED_ETA2 = 0.99
MAX_COPY_ARI = 0.90
MIN_ENTROPY = 0.50
MIN_COVERAGE = 85.0
MAX_NOISE_PCT = 50.0
FIRST_ROUND_MIN_COVERAGE = 90.0
FIRST_ROUND_MIN_ARI = 0.60
FIRST_ROUND_TIE = 0.02
CONTAMINATION = 0.05
LEVEL_HIGH = 0.35
LEVEL_MEDIUM = 0.15
LEVEL_LOW = 0.05
NEAR_KM = 120.0

# ---- fixed values: verdict and reason labels ----
VERDICT_HIGH, VERDICT_MEDIUM, VERDICT_LOW, VERDICT_NONE = "ALTA", "MEDIA", "BAJA", "NULA"
VERDICT_EXPLORE = "EXPLORACION"
REASON_BOTH = "Rubro y descripción"
REASON_CODE = "Mismo rubro"
REASON_TEXT = "Descripción similar"
REASON_BUYER = "Comprador conocido"
REASON_WEAK = "Coincidencia débil"

# ---- fixed values: identifier patterns ----
TAX_ID = r"(\d{13})"
PORTAL_CODE = r"^ocds-[a-z0-9]+-(.+)-\d+$"

# ---- fixed values: audited fields, in report order ----
AUDITED_FIELDS = [
    "parties[]",
    "parties[].address.region (supplier)",
    "parties[].address.region (buyer)",
    "awards[].suppliers[].id",
    "awards[].value.amount",
    "awards[].items[].classification.id",
    "awards[].items[].description",
    "buyer.id",
    "tender",
    "tender.items[].classification.id",
    "tender.items[].description",
    "tender.value.amount",
    "planning.budget",
    "tender.procurementMethodDetails",
    "tender.status",
    "tender.tenderPeriod.endDate",
    "tender.tenderers[]",
    "bids.details[]",
]
