"""Vocabularies, label maps and weights that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from showgrid.util import lookup

# --- Fixed values: venue groups and their locations -------------------------------------------
VENUE_GROUPS = {
    "Renoir": ["Princesa", "Retiro", "Plaza de España"],
    "Embajadores": ["Embajadores Glorieta", "Embajadores Ercilla"],
    "Cinesa": [
        "Cinesa Equinoccio", "Cinesa La Gavia", "Cinesa La Moraleja", "Cinesa Las Rosas", "Cinesa Las Rozas",
        "Cinesa Manoteras", "Cinesa Mendez Alvaro", "Cinesa Nassica", "Cinesa Oasiz", "Cinesa Parquesur",
        "Cinesa Plaza Loranca 2", "Cinesa Principe Pio", "Cinesa Proyecciones", "Cinesa Xanadu",
    ],
    "Yelmo": [
        "Yelmo Ideal", "Yelmo Islazul", "Yelmo La Vaguada", "Yelmo Palafox Luxury", "Yelmo Parque Corredor",
        "Yelmo Plaza Norte 2", "Yelmo Planetocio", "Yelmo Plenilunio", "Yelmo Rivas H2O", "Yelmo TresAguas",
    ],
}

# Legacy chain label -> group whose locations replace it
LEGACY_CHAINS = {"Cines Renoir": "Renoir", "Cines Embajadores": "Embajadores", "Cinesa": "Cinesa", "Cines Yelmo": "Yelmo"}

# Venue display order: first pattern found in the lower-cased name wins, others get 999
VENUE_ORDER = [
    (r"\bdor[eé]\b|filmoteca", 0), ("cineteca", 1), ("berlanga", 2), ("estudio", 3), ("golem", 4),
    ("renoir|^princesa$|^retiro$|^plaza de españa$", 5), ("equis", 6), ("embajadores", 7),
    ("verdi", 8), ("paz", 9), ("cinesa", 10), ("yelmo", 11),
]

# Raw page label -> location
LOCATION_LABELS = {"Cine Embajadores": "Embajadores Glorieta", "Cine Embajadores Río": "Embajadores Ercilla"}

# Cinema id in the showtime API -> location
API_CINEMAS = {
    35: "Yelmo Ideal", 82: "Yelmo La Vaguada", 48: "Yelmo Islazul", 70: "Yelmo Palafox Luxury",
    72: "Yelmo Parque Corredor", 55: "Yelmo Plaza Norte 2", 34: "Yelmo Planetocio", 36: "Yelmo Plenilunio",
    37: "Yelmo Rivas H2O", 38: "Yelmo TresAguas",
}

# Raw version label -> version
VERSION_LABELS = {"DIGITAL": "dubbed", "3D DIGITAL": "dubbed"}

# --- Fixed values: title clean-up -------------------------------------------------------------
TITLE_PREFIXES = [
    "Jueves de Imprescindibles:", "Miércoles Cultural:", "Anime Day:", "Sesión TETA:", "Verdi Club:",
    "Mañanas de Ópera y Ballet:", "F. Espectador:", "Domingo de clásicos:", "Cine y política:", "Espacio Queer:",
    "SESIÓN TETA:", "Clásicos al detalle:", "Música en cine:", "AETERNA:", "Muestra Aeterna:",
    "Nuevas miradas de cine asiático:", "Modo avión:",
]
TITLE_PREFIX_PATTERN = r"(?i)^(?:Laca y Palomitas[^:]*):?\s*"
VERSION_SUFFIX_PATTERNS = [
    r"\s*\(VOSE\)\s*$", r"\s*\(V\.O\.S\.E\.\)\s*$", r"(?i)\s*\(DOBLADA AL ESPAÑOL\)\s*$", r"\s*-\s*VOSE\s*$",
]

# --- Fixed values: Spanish calendar words -----------------------------------------------------
SPANISH_MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre",
    "diciembre",
]
SPANISH_MONTH_ABBREVIATIONS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
SPANISH_WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]

# --- Fixed values: facet ranges ---------------------------------------------------------------
RUNTIME_CHIPS = [("< 1h", 0, 59), ("1–1.5h", 60, 89), ("1.5–2h", 90, 119), ("2–3h", 120, 179), ("3h+", 180, None)]

# --- Fixed values: language codes -------------------------------------------------------------
LANGUAGE_NAMES = {
    "en": "English", "fr": "French", "es": "Spanish", "de": "German", "it": "Italian", "pt": "Portuguese",
    "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "ru": "Russian", "ar": "Arabic", "hi": "Hindi",
    "sv": "Swedish", "da": "Danish", "no": "Norwegian", "pl": "Polish", "cs": "Czech", "ro": "Romanian",
    "uk": "Ukrainian", "ca": "Catalan", "sk": "Slovak", "ml": "Malayalam", "tl": "Tagalog", "ur": "Urdu",
    "az": "Azerbaijani", "nl": "Dutch", "fi": "Finnish", "el": "Greek", "he": "Hebrew", "hu": "Hungarian",
    "id": "Indonesian", "ms": "Malay", "th": "Thai", "tr": "Turkish", "vi": "Vietnamese", "bn": "Bengali",
    "fa": "Persian", "ta": "Tamil", "te": "Telugu", "la": "Latin", "xx": "No spoken language",
}
SPANISH_LANGUAGE_VALUES = ["es", "Spanish"]
COUNTRY_ALIASES = {"UK": "United Kingdom", "USA": "United States of America"}

# --- Fixed values: crew jobs ------------------------------------------------------------------
DIRECTOR_PRIORITY = {"Series Director": 0, "Director": 1}
WRITER_JOBS = ["Writer", "Screenplay", "Story", "Novel"]

# --- Fixed values: labels ---------------------------------------------------------------------
GENRES_ES = {
    "action": "Acción", "adventure": "Aventura", "animation": "Animación", "biography": "Biografía",
    "comedy": "Comedia", "crime": "Crimen", "documentary": "Documental", "drama": "Drama", "family": "Familiar",
    "fantasy": "Fantasía", "film-noir": "Cine negro", "history": "Historia", "horror": "Terror", "music": "Música",
    "musical": "Musical", "mystery": "Misterio", "romance": "Romance", "science fiction": "Ciencia ficción",
    "short": "Cortometraje", "sport": "Deporte", "thriller": "Thriller", "tv movie": "Película para TV",
    "war": "Bélico", "western": "Wéstern",
}
PROPER_NAME_CATEGORIES = ["director", "cast", "cinematographer", "composer", "writer", "company"]
PERSON_CATEGORIES = ["director", "cast", "cinematographer", "composer", "writer"]

# --- Fixed values: content vector -------------------------------------------------------------
VECTOR_WEIGHTS = {
    "genre": 0.10, "director": 0.14, "cast": 0.14, "keyword": 0.20, "country": 0.08, "language": 0.06,
    "decade": 0.08, "company": 0.06, "collection": 0.04, "runtime": 0.04, "rating": 0.06,
}
VECTOR_CAPS = {"cast": 5, "keyword": 10, "company": 3}
MIN_GENRE_DIVISOR = 3
IDF_PENALTY_CATEGORIES = ["country", "lang", "runtime", "rating"]

# --- Fixed values: feature graph --------------------------------------------------------------
EDGE_WEIGHTS = {
    "director": 3.0, "cinematographer": 2.5, "writer": 2.5, "cast": 2.5, "keyword": 2.0, "composer": 2.0,
    "genre": 1.5, "collection": 1.5, "company": 1.0, "country": 0.5, "decade": 0.5, "language": 0.3,
}
EDGE_CAPS = {"director": 2, "cinematographer": 2, "composer": 2, "writer": 3, "cast": 5, "keyword": 10, "company": 3}
LEAD_CAST = 2
LEAD_CAST_FACTOR = 1.5
RECOMMENDATION_WEIGHT = 2.0
MAX_HUB_FRACTION = 0.30
PRUNABLE_CATEGORIES = ["genre", "country", "language", "decade"]
BLOCKED_KEYWORDS = [
    "aftercreditsstinger", "duringcreditsstinger", "post-credits scene", "black and white", "woman director", "anime",
    "based on manga", "excited", "amused", "admiring", "dramatic", "inspirational", "somber", "playful", "suspenseful",
    "tense", "angry", "defiant", "arrogant", "sequel", "remake", "3d",
]
DEFAULT_WATCHED_WEIGHT = 0.5625
SIMILAR_CATEGORIES = ["director", "cinematographer", "composer", "writer", "cast", "collection"]

# --- Fixed values: enrichment queue -----------------------------------------------------------
LEASE_MINUTES = 5
MAX_RETRIES = 5
MAX_WORKERS = 5
BATCH_SIZE = 30

# --- Fixed values: special-session rules (first match wins) ------------------------------------
SPECIAL_TITLE_RULES = [
    ("conference", "prefix", r"(?i)^(ciclo de|conversa:|masterclass|mesa redonda|coloquio)|conversa:"),
    ("shorts", "shorts", r"(?i)sesión de cortometrajes"),
    ("festival", "festival", r"(?i)palmarés"),
    ("event", "showcase", r"(?i)presenta:"),
    ("event", "numbered", r"#\d+|(?i:sesión [ivx]+\b)"),
]
VARIOUS_AUTHORS_PATTERN = r"(?i)^(varios/as autores/as|vv\.\s?aa\.|varios autores)"


def venue_groups(spark: SparkSession) -> DataFrame:
    rows = [(group, place) for group, places in VENUE_GROUPS.items() for place in places]
    return lookup(spark, rows, "venue_group string, location string")


def legacy_chains(spark: SparkSession) -> DataFrame:
    rows = [(chain, place) for chain, group in LEGACY_CHAINS.items() for place in VENUE_GROUPS[group]]
    return lookup(spark, rows + [("Cineteca Madrid", "Cineteca Madrid")], "chain string, location string")
