"""Fixed values that results depend on.

These constants must equal the analysed project's values for the results to
match; they are stated plainly, in their natural order, in one place.
"""

# --- fixed values: World Bank 2023 income thresholds (GDP per capita, USD),
# bands are [low, high); a value outside every band falls to the last label.
INCOME_BANDS = [
    ("Poveri estremi", 0.0, 1136.0),
    ("Reddito basso-medio", 1136.0, 4466.0),
    ("Reddito medio-alto", 4466.0, 13846.0),
    ("Ricchi avanzati", 13846.0, float("inf")),
]
INCOME_BAND_ORDER = [b[0] for b in INCOME_BANDS]
INCOME_BAND_FALLBACK = "Ricchi avanzati"
CLUSTER_ORDER = list(reversed(INCOME_BAND_ORDER))  # richest first

# --- fixed values: event gender classification (lower-cased text, first match wins)
EVENT_GENDER_RULES = [
    ("Femminile", r"\bwomen\b|women's|, women"),
    ("Maschile", r"\bmen\b|men's|, men"),
]
EVENT_GENDER_DEFAULT = "Misto/Altro"
ATHLETE_SEX_LABELS = {"Male": "Maschile", "Female": "Femminile"}
ATHLETE_SEX_UNKNOWN = "Sconosciuto"

# --- fixed values: null-share bands (percent of nulls per column)
# variant 1: < 30 Keep, 30 < p < 50 Maybe, everything else (including exactly 30) Drop
NULL_BANDS_V1 = ("Keep", "Maybe", "Drop")
# variant 2: > 30 excluded, > 15 caution, else reliable
NULL_BANDS_V2 = ("Esclusa (>30%)", "Cautela (15-30%)", "Affidabile (<15%)")

# --- fixed values: plausibility ranges (value outside -> null)
RANGE_RULES = {
    "life_expectancy": (20.0, 100.0),
    "urbanization_pct": (0.0, 100.0),
    "infant_mortality": (0.0, None),
}

# --- fixed values: Italian month names -> month number (default 12 when unknown)
ITALIAN_MONTHS = {
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6,
    "luglio": 7, "agosto": 8, "settembre": 9, "ottobre": 10, "novembre": 11, "dicembre": 12,
}
UNKNOWN_MONTH = 12
DATE_SENTINEL = "0000-00-00"

# --- fixed values: spend-change bins (a, b] and labels; medal direction labels
DELTA_BINS = [(-float("inf"), -15.0, "Taglio"), (-15.0, 15.0, "Stabile"),
              (15.0, 40.0, "Aumento mod."), (40.0, float("inf"), "Aumento forte")]
DIRECTION_UP, DIRECTION_DOWN = "Più medaglie", "Meno medaglie"

# --- fixed values: outcome profile naming rule (checked in this order)
OUTCOME_NAMES = [("Potenze assolute", "avg_medals", 40.0),
                 ("Specializzati", "medals_per_m", 2.0),
                 ("Emergenti/Medi", "avg_medals", 8.0)]
OUTCOME_DEFAULT = "Partecipanti"

# --- fixed values: sport accessibility thresholds (percent)
ACCESSIBLE_MIN, EXCLUSIVE_MAX = 50.0, 30.0

# --- fixed values: scenario projection
GROWTH_CLIP = (-0.05, 0.10)
GROWTH_DEFAULT = 0.025
POP_GROWTH = 1.015
LIFE_STEP = 0.5
URBAN_STEP, URBAN_CAP = 0.5, 100.0

# --- fixed values: period split and edition window
EARLY_PERIOD_MAX, LATE_PERIOD_MIN = 1996, 2000
PERIOD_LABELS = ("1964-1996", "2000-2020")
FIRST_YEAR, LAST_YEAR = 1964, 2020
