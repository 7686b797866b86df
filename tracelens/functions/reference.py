"""Reference distributions and places, as small ordered tables.

The order of the rows is data: where a text may hold several keys, the first key in the table wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Official population figures and shares that results must equal.
TOTAL_POPULATION = 49_128_297
SEX = {"hombre": 0.492, "mujer": 0.508}
MARITAL = {"casado": 0.458, "con_pareja": 0.242, "divorciado": 0.078, "soltero": 0.152, "viudo": 0.070}
MARITAL_BY_SEX = {
    "hombre": {"casado": 0.464, "con_pareja": 0.270, "divorciado": 0.072, "soltero": 0.169, "viudo": 0.025},
    "mujer": {"casado": 0.452, "con_pareja": 0.216, "divorciado": 0.083, "soltero": 0.136, "viudo": 0.113},
}
AGE_BANDS = {
    "0-4": 0.038, "5-9": 0.042, "10-14": 0.046, "15-19": 0.045, "20-24": 0.045, "25-29": 0.052, "30-34": 0.062, "35-39": 0.070, "40-44": 0.081,
    "45-49": 0.084, "50-54": 0.078, "55-59": 0.072, "60-64": 0.064, "65-69": 0.056, "70-74": 0.052, "75-79": 0.042, "80-84": 0.030, "85+": 0.041,
}
STUDIES = {
    "medicina": 0.0128, "enfermeria": 0.0231, "derecho": 0.0308, "ingenieria informatica": 0.0300, "ingenieria industrial": 0.0114,
    "administracion de empresas": 0.0328, "psicologia": 0.0331, "magisterio": 0.0524, "arquitectura": 0.0127, "farmacia": 0.0048,
    "biologia": 0.0201, "periodismo": 0.0064, "economia": 0.0101, "veterinaria": 0.0027,
}
OCCUPATIONS = {
    "docente": 0.049, "sanitario": 0.055, "desarrollador de software": 0.018, "ingeniero": 0.020, "abogado": 0.008,
    "comercial": 0.049, "hosteleria": 0.044, "administracion publica": 0.065, "construccion": 0.060, "transporte": 0.030,
}
NATIONALITY = {"espanola": 0.851, "extranjera": 0.149}
EMPLOYMENT = {"activo": 0.531, "parado": 0.059, "jubilado": 0.234, "estudiante": 0.082, "otro_inactivo": 0.094}
HOUSEHOLD = {"unipersonal": 0.257, "pareja_sin_hijos": 0.232, "pareja_con_hijos": 0.334, "monoparental": 0.100, "otro": 0.077}
#: The key of the Balearic Islands differs from that of the communities, so their Catalan can't be estimated; kept as it is.
LANGUAGE_BY_COMMUNITY = {
    "cataluna": {"catalan": 0.555, "castellano_u_otra": 0.445},
    "islas baleares": {"catalan": 0.429, "castellano_u_otra": 0.571},
    "comunidad valenciana": {"valenciano": 0.352, "castellano_u_otra": 0.648},
    "pais vasco": {"euskera": 0.337, "castellano_u_otra": 0.663},
    "galicia": {"gallego": 0.828, "castellano_u_otra": 0.172},
    "navarra": {"euskera": 0.146, "castellano_u_otra": 0.854},
}
ORIENTATION = {"heterosexual": 0.914, "gay": 0.022, "lesbiana": 0.015, "bisexual": 0.017, "pansexual": 0.002, "asexual": 0.002, "homosexual": 0.028}
RELIGION = {"judaismo": 0.001, "islam": 0.022, "catolicismo": 0.63, "cristianismo": 0.67, "budismo": 0.005, "hinduismo": 0.003, "ateismo": 0.18, "agnosticismo": 0.08}
#: Symbol, sign, days.
ZODIAC = (
    ("♈", "aries", "21 mar - 19 abr"), ("♉", "tauro", "20 abr - 20 may"), ("♊", "geminis", "21 may - 20 jun"), ("♋", "cancer", "21 jun - 22 jul"), ("♌", "leo", "23 jul - 22 ago"), ("♍", "virgo", "23 ago - 22 sep"),
    ("♎", "libra", "23 sep - 22 oct"), ("♏", "escorpio", "23 oct - 21 nov"), ("♐", "sagitario", "22 nov - 21 dic"), ("♑", "capricornio", "22 dic - 19 ene"), ("♒", "acuario", "20 ene - 18 feb"), ("♓", "piscis", "19 feb - 20 mar"),
)
# People by province and municipality.
PROVINCES = {
    "madrid": 7_113_886, "barcelona": 5_959_941, "valencia": 2_763_996, "sevilla": 1_977_664, "alicante": 2_033_566, "malaga": 1_791_183,
    "murcia": 1_586_989, "cadiz": 1_261_420, "vizcaya": 1_167_233, "a coruna": 1_135_623, "baleares": 1_249_844, "las palmas": 1_171_547,
    "santa cruz de tenerife": 1_087_319, "zaragoza": 998_443, "asturias": 1_015_128, "pontevedra": 947_818, "granada": 945_797, "tarragona": 875_530,
    "gerona": 830_429, "castellon": 627_620, "toledo": 755_081, "badajoz": 665_155, "cordoba": 773_163, "jaen": 618_143,
    "navarra": 683_854, "almeria": 770_554, "guipuzcoa": 733_149, "valladolid": 528_644, "cantabria": 593_623, "leon": 448_030,
    "lerida": 458_226, "huelva": 538_789, "burgos": 362_663, "caceres": 388_190, "salamanca": 328_446, "la rioja": 326_803,
    "lugo": 326_022, "orense": 305_278, "albacete": 390_751, "guadalajara": 285_839, "ciudad real": 494_848, "alava": 341_961,
    "huesca": 230_087, "zamora": 165_564, "avila": 160_738, "palencia": 158_702, "segovia": 158_251, "teruel": 136_091,
    "cuenca": 199_859, "soria": 90_183, "ceuta": 83_567, "melilla": 87_067,
}
MUNICIPALITIES = {
    "madrid": 3_330_000, "barcelona": 1_660_000, "valencia": 800_000, "sevilla": 690_000, "zaragoza": 680_000, "malaga": 590_000,
    "murcia": 460_000, "bilbao": 345_000, "leon": 122_000, "salamanca": 143_000, "avila": 57_000, "valladolid": 296_000,
    "burgos": 174_000, "santander": 172_000, "vitoria": 253_000, "gijon": 267_000, "oviedo": 220_000, "pamplona": 205_000,
    "santiago de compostela": 98_000, "logrono": 152_000, "caceres": 96_000, "segovia": 51_000, "soria": 39_000, "teruel": 35_000,
}
# Community -> (name to show, provinces).
COMMUNITIES = {
    "andalucia": ("Andalucía", ["sevilla", "cadiz", "malaga", "granada", "cordoba", "jaen", "almeria", "huelva"]),
    "aragon": ("Aragón", ["zaragoza", "huesca", "teruel"]),
    "asturias": ("Asturias", ["asturias"]),
    "baleares": ("Islas Baleares", ["baleares"]),
    "canarias": ("Canarias", ["las palmas", "santa cruz de tenerife"]),
    "cantabria": ("Cantabria", ["cantabria"]),
    "castilla y leon": ("Castilla y León", ["valladolid", "leon", "burgos", "salamanca", "zamora", "avila", "palencia", "segovia", "soria"]),
    "castilla la mancha": ("Castilla-La Mancha", ["toledo", "ciudad real", "albacete", "guadalajara", "cuenca"]),
    "cataluna": ("Cataluña", ["barcelona", "tarragona", "gerona", "lerida"]),
    "comunidad valenciana": ("Comunidad Valenciana", ["valencia", "alicante", "castellon"]),
    "extremadura": ("Extremadura", ["badajoz", "caceres"]),
    "galicia": ("Galicia", ["a coruna", "pontevedra", "lugo", "orense"]),
    "madrid": ("Comunidad de Madrid", ["madrid"]),
    "murcia": ("Región de Murcia", ["murcia"]),
    "navarra": ("Comunidad Foral de Navarra", ["navarra"]),
    "pais vasco": ("País Vasco", ["vizcaya", "guipuzcoa", "alava"]),
    "la rioja": ("La Rioja", ["la rioja"]),
    "ceuta": ("Ceuta", ["ceuta"]),
    "melilla": ("Melilla", ["melilla"]),
}
# Names of communities in use.
ALIASES = {
    "andalucia": "andalucia", "andalusia": "andalucia", "aragon": "aragon", "asturias": "asturias", "principado de asturias": "asturias",
    "baleares": "baleares", "islas baleares": "baleares", "illes balears": "baleares", "balearic islands": "baleares",
    "canarias": "canarias", "islas canarias": "canarias", "canary islands": "canarias", "cantabria": "cantabria",
    "castilla y leon": "castilla y leon", "castilla-y-leon": "castilla y leon", "castile and leon": "castilla y leon", "castille and leon": "castilla y leon",
    "castilla la mancha": "castilla la mancha", "castilla-la mancha": "castilla la mancha", "castile-la mancha": "castilla la mancha",
    "cataluna": "cataluna", "catalunya": "cataluna", "catalonia": "cataluna",
    "comunidad valenciana": "comunidad valenciana", "comunitat valenciana": "comunidad valenciana", "valencian community": "comunidad valenciana",
    "region of valencia": "comunidad valenciana", "extremadura": "extremadura", "galicia": "galicia",
    "madrid": "madrid", "comunidad de madrid": "madrid", "community of madrid": "madrid",
    "murcia": "murcia", "region de murcia": "murcia", "region of murcia": "murcia", "murcia region": "murcia",
    "navarra": "navarra", "comunidad foral de navarra": "navarra", "navarre": "navarra",
    "pais vasco": "pais vasco", "euskadi": "pais vasco", "basque country": "pais vasco", "la rioja": "la rioja", "rioja": "la rioja",
    "ceuta": "ceuta", "melilla": "melilla",
}
# Table -> (day of its last check, days after which it is stale).
VERIFIED = {
    "TOTAL_POPULATION_ES": ("2025-01-01", 400), "SEX_DISTRIBUTION": ("2025-01-01", 400), "MARITAL_STATUS_DISTRIBUTION": ("2026-08-11", 2190),
    "MARITAL_STATUS_BY_SEX": ("2026-08-11", 2190), "AGE_DISTRIBUTION_5Y": ("2025-01-01", 400), "PROVINCE_POPULATION": ("2026-08-11", 400),
    "OCCUPATION_DISTRIBUTION": (None, None), "STUDIES_DISTRIBUTION": ("2026-08-11", 400), "NATIONALITY_DISTRIBUTION": ("2026-08-11", 400),
    "SITUACION_LABORAL_DISTRIBUTION": ("2025-10-01", 400), "HOUSEHOLD_TYPE_DISTRIBUTION": ("2024-01-01", 2190), "LANGUAGE_BY_CCAA": ("2021-01-01", 2190),
}
DEFAULT_STALE_DAYS = 400

SPECIAL_CATEGORIES = ("orientacion_sexual", "religion")
# The chained steps in their order, then those that are only listed.
STEPS = (
    "sexo", "edad", "ubicacion", "estudios", "ocupacion", "nacionalidad", "situacion_laboral", "tipo_hogar", "lengua_materna",
    "orientacion_sexual", "religion", "signo_zodiacal", "estado_civil", "universidad", "empresa",
)

SINGLE = {
    "sexo": SEX, "estudios": STUDIES, "ocupacion": OCCUPATIONS, "nacionalidad": NATIONALITY, "situacion_laboral": EMPLOYMENT, "tipo_hogar": HOUSEHOLD,
    "estado_civil": MARITAL, "edad_rango": AGE_BANDS, "orientacion_sexual": ORIENTATION, "religion": RELIGION, "signo_zodiacal": {sign: 1 / 12 for _, sign, _ in ZODIAC},
}


def one_year_ages() -> dict[int, float]:
    """Share of each year of age: a band's share in equal parts; the open band reaches to 100."""
    out = {}
    for band, p in AGE_BANDS.items():
        lo, hi = (85, 100) if band == "85+" else map(int, band.split("-"))
        out |= dict.fromkeys(range(lo, hi + 1), p / (hi - lo + 1))
    return out


def distributions(spark: SparkSession) -> DataFrame:
    """field, key, given (null, or the value of another field), p, ord."""
    rows = [(f, k, None, float(p), n) for f, t in SINGLE.items() for n, (k, p) in enumerate(t.items())]
    rows += [("edad", str(a), None, p, a) for a, p in one_year_ages().items()]
    rows += [("estado_civil", k, s, p, n) for s, t in MARITAL_BY_SEX.items() for n, (k, p) in enumerate(t.items())]
    rows += [("lengua_materna", k, c, p, n) for c, t in LANGUAGE_BY_COMMUNITY.items() for n, (k, p) in enumerate(t.items())]
    return spark.createDataFrame(rows, "field string, key string, given string, p double, ord int")


def populations(spark: SparkSession) -> DataFrame:
    """level, key, population, ord."""
    community = {c: sum(PROVINCES[p] for p in ps) for c, (_, ps) in COMMUNITIES.items()}
    rows = [(level, k, n, i) for level, t in (("municipio", MUNICIPALITIES), ("provincia", PROVINCES), ("comunidad_autonoma", community)) for i, (k, n) in enumerate(t.items())]
    return spark.createDataFrame(rows, "level string, key string, population long, ord int")


def places(spark: SparkSession) -> DataFrame:
    """province, community, community_name, provinces_in_community."""
    rows = [(p, c, name, len(ps)) for c, (name, ps) in COMMUNITIES.items() for p in ps]
    return spark.createDataFrame(rows, "province string, community string, community_name string, provinces_in_community int")


def aliases(spark: SparkSession) -> DataFrame:
    """alias, community, ord."""
    return spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(ALIASES.items())], "alias string, community string, ord int")
