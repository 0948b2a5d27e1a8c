"""Reference dimensions as small DataFrames. All are literal, so their size is fixed and they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Regions in order, localities of each region, residents of each locality, trips of each purpose by
# destination region, trips between regions, destination types of each purpose, amenities kept, and thresholds.
REGIONS = ["Southern Harbour", "Northern Harbour", "South Eastern", "Western", "Northern"]

LOCALITIES = {
    "Southern Harbour": [
        "Bormla", "Il-Fgura", "Il-Furjana", "Ħal Luqa", "Ħaż-Żabbar", "Il-Kalkara", "Il-Marsa", "Raħal Ġdid",
        "Santa Luċija", "L-Isla", "Ħal Tarxien", "Il-Belt Valletta", "Il-Birgu", "Ix-Xgħajra", "Wied il-Għajn",
    ],
    "Northern Harbour": [
        "Birkirkara", "Il-Gżira", "Ħal Qormi", "Il-Ħamrun", "L-Imsida", "Pembroke", "San Ġwann", "Santa Venera",
        "Fleur-de-Lys", "San Ġiljan", "Is-Swieqi", "Ta' Xbiex", "Tal-Pietà", "Tas-Sliema",
    ],
    "South Eastern": [
        "Birżebbuġa", "Il-Gudja", "Ħal Għaxaq", "Ħal Kirkop", "Ħal Safi", "Marsaskala", "Marsaxlokk", "L-Imqabba",
        "Il-Qrendi", "Iż-Żejtun", "Iż-Żurrieq",
    ],
    "Western": [
        "Ħad-Dingli", "Ħal Balzan", "Ħal Lija", "Ħ'Attard", "Ħaż-Żebbuġ", "L-Iklin", "L-Imdina", "L-Imtarfa",
        "Ir-Rabat", "Is-Siġġiewi",
    ],
    "Northern": ["Ħal Għargħur", "Il-Mellieħa", "L-Imġarr", "Il-Mosta", "In-Naxxar", "San Pawl il-Baħar"],
}

POPULATION = {
    "Bormla": 4654, "Il-Fgura": 13066, "Il-Furjana": 1985, "Ħal Luqa": 7249, "Ħaż-Żabbar": 17148, "Il-Kalkara": 3105,
    "Il-Marsa": 5468, "Raħal Ġdid": 9339, "Santa Luċija": 2617, "L-Isla": 2304, "Ħal Tarxien": 9464,
    "Il-Belt Valletta": 5157, "Il-Birgu": 2261, "Ix-Xgħajra": 2192,
    "Birkirkara": 25807, "Il-Gżira": 10331, "Ħal Qormi": 18099, "Il-Ħamrun": 10514, "L-Imsida": 13587,
    "Pembroke": 3545, "San Ġwann": 14244, "Santa Venera": 8834, "San Ġiljan": 11653, "Is-Swieqi": 13044,
    "Ta' Xbiex": 2092, "Tal-Pietà": 5892, "Tas-Sliema": 19655,
    "Birżebbuġa": 11844, "Il-Gudja": 3229, "Ħal Għaxaq": 5538, "Ħal Kirkop": 2527, "Ħal Safi": 2641,
    "L-Imqabba": 3525, "Il-Qrendi": 3148, "Iż-Żejtun": 12409, "Iż-Żurrieq": 12295, "Marsaxlokk": 3988,
    "Wied il-Għajn": 16804,
    "Ħad-Dingli": 3865, "Ħal Balzan": 4774, "Ħal Lija": 3162, "Ħ'Attard": 12268, "Ħaż-Żebbuġ": 13785, "L-Iklin": 3399,
    "L-Imdina": 193, "L-Imtarfa": 2566, "Ir-Rabat": 11936, "Is-Siġġiewi": 9318,
    "Ħal Għargħur": 3741, "Il-Mellieħa": 12738, "L-Imġarr": 4840, "Il-Mosta": 23482, "In-Naxxar": 16912,
    "San Pawl il-Baħar": 32042,
}

PURPOSES = [
    "education_and_escort_education", "going_to_main_place_of_work", "shopping", "personal_errands", "escort_other",
    "medical", "recreation", "visiting", "other",
]
#: By destination region, in the order of PURPOSES.
PURPOSE_COUNTS = {
    "Southern Harbour": [9827, 43922, 6119, 7540, 4714, 2317, 6596, 4827, 4138],
    "Northern Harbour": [22182, 66821, 13770, 10470, 8075, 9213, 10447, 8551, 6814],
    "South Eastern": [3329, 18298, 3234, 3610, 2109, 1142, 4927, 3501, 2218],
    "Western": [3661, 16011, 4777, 4217, 2856, 610, 5765, 2986, 3941],
    "Northern": [6603, 19654, 8128, 5366, 3732, 1209, 6310, 3750, 2964],
}
#: By origin region, in the order of REGIONS.
REGION_COUNTS = {
    "Southern Harbour": [42182, 33186, 21460, 9829, 10524],
    "Northern Harbour": [33463, 115270, 17104, 22230, 28066],
    "South Eastern": [22855, 18215, 31355, 4808, 3079],
    "Western": [10344, 24399, 4800, 25630, 12377],
    "Northern": [11801, 30491, 3761, 13344, 45393],
}
PURPOSE_TYPES = {
    "going_to_main_place_of_work": ["bank", "work", "shop"],
    "education_and_escort_education": ["college", "language_school", "university", "child_care", "school"],
    "shopping": ["mall", "marketplace", "shop"],
    "personal_errands": ["bank", "library", "monastery", "place_of_worship", "social_facility", "veterinary"],
    "medical": ["dentist", "doctors", "hospital", "pharmacy"],
    "recreation": ["bar", "bench", "cafe", "fast_food", "food_court", "restaurant"],
    "visiting": ["residential"],
    "escort_other": ["*"],
    "other": ["other"],
}
AMENITIES = [
    "bank", "bar", "bench", "cafe", "child_care", "college", "dentist", "doctors", "fast_food", "food_court", "hospital",
    "language_school", "library", "mall", "marketplace", "monastery", "pharmacy", "place_of_worship", "restaurant",
    "school", "social_facility", "university", "veterinary",
]
DEFAULT_BETA = 0.0002
TARGET_LENGTH = 6100.0
MIN_BIKE_GAIN, MAX_CAR_HARM, PATIENCE = 0.005, 0.3, 5
UNROUTED_PENALTY = 25_000.0

# Safety classes from best to worst with their colours, and road colours.
SAFETY = {
    "very_safe": "PROTECTED", "safe": "PAINTED", "moderate": "LOW_CAR_FLOW", "caution": "CAUTION",
    "dangerous": "HIGH_CAR_FLOW", "unsuitable": "UNSUITABLE", "unclassified": "UNCLASSIFIED",
}
PROTECTED = ["very_safe", "safe"]
RISK = {"very_safe": 1.0, "safe": 1.0, "moderate": 1.5, "dangerous": 2.0, "unclassified": 2.0}
SAFETY_COLOURS = {"very_safe": "magenta", "safe": "green", "moderate": "orange", "dangerous": "darkred"}
HIGHWAY_COLOURS = {
    "trunk": "darkred", "primary": "red", "secondary": "orange", "tertiary": "gold", "residential": "skyblue",
    "service": "slategray",
}


def locality_regions(spark: SparkSession) -> DataFrame:
    """(locality, region)."""
    return spark.createDataFrame([(x, r) for r, own in LOCALITIES.items() for x in own], "locality string, region string")


def locality_populations(spark: SparkSession) -> DataFrame:
    """(locality, population)."""
    return spark.createDataFrame(list(POPULATION.items()), "locality string, population long")


def purpose_counts(spark: SparkSession) -> DataFrame:
    """(region, purpose, trips)."""
    rows = [(r, p, n) for r, own in PURPOSE_COUNTS.items() for p, n in zip(PURPOSES, own)]
    return spark.createDataFrame(rows, "region string, purpose string, trips long")


def region_counts(spark: SparkSession) -> DataFrame:
    """(origin, destination, trips)."""
    rows = [(r, d, n) for r, own in REGION_COUNTS.items() for d, n in zip(REGIONS, own)]
    return spark.createDataFrame(rows, "origin string, destination string, trips long")


def purpose_types(spark: SparkSession) -> DataFrame:
    """(purpose, types)."""
    return spark.createDataFrame(list(PURPOSE_TYPES.items()), "purpose string, types array<string>")
