"""Reference data and default parameters."""

from __future__ import annotations

# Places of the study area (degrees) and the months in which stations opened.
CITY_CENTRE = (40.3703, 49.8403)
NODES = {
    "alat": (39.9490, 49.4110), "mardakan": (40.4920, 50.1460), "sumgait": (40.5897, 49.6686), "khirdalan": (40.4489, 49.7550),
    "binagadi": (40.4653, 49.8286), "zigh_hovsan": (40.3744, 50.0400), "lokbatan": (40.3242, 49.7301), "bilgah": (40.5644, 49.9944),
}
# Centre and radius in km.
REDEVELOPMENT = {"sovetski": (40.3830, 49.8280, 0.9), "white_city": (40.3720, 49.8760, 1.2), "hovsan_coastal": (40.3650, 50.0250, 1.5)}
# Name, lat, lon, month opened, month planned.
STATIONS = [
    ("Icherisheher", 40.3660, 49.8317, "1967-11", None), ("Sahil", 40.3717, 49.8442, "1967-11", None), ("28 May", 40.3797, 49.8489, "1967-11", None),
    ("Ganjlik", 40.4005, 49.8517, "1967-11", None), ("Nariman Narimanov", 40.4028, 49.8702, "1967-11", None), ("Bakmil", 40.4189, 49.8564, "1979-01", None),
    ("Ulduz", 40.4153, 49.8925, "1970-11", None), ("Koroghlu", 40.4211, 49.9187, "1972-11", None), ("Qara Qarayev", 40.4175, 49.9333, "1972-11", None),
    ("Neftchilar", 40.4106, 49.9439, "1972-11", None), ("Khalglar Dostlugu", 40.3975, 49.9519, "1989-04", None), ("Ahmedli", 40.3853, 49.9539, "1989-04", None),
    ("Hazi Aslanov", 40.3722, 49.9542, "2002-12", None), ("Nizami", 40.3794, 49.8297, "1976-05", None), ("Elmler Akademiyasi", 40.3753, 49.8147, "1985-12", None),
    ("Inshaatchilar", 40.3908, 49.8033, "1985-12", None), ("20 Yanvar", 40.4042, 49.8078, "1985-12", None), ("Memar Ajami", 40.4108, 49.8144, "1985-12", None),
    ("Nasimi", 40.4242, 49.8250, "2008-10", None), ("Azadlig Prospekti", 40.4258, 49.8428, "2009-12", None), ("Darnagul", 40.4253, 49.8619, "2011-06", None),
    ("Jafar Jabbarli", 40.3794, 49.8480, "1993-12", None), ("Khojasan", 40.4145, 49.7825, "2021-11", None), ("Avtovagzal", 40.4211, 49.7947, "2016-04", None),
    ("Memar Ajami-2", 40.4108, 49.8155, "2016-04", None), ("8 Noyabr", 40.4000, 49.8200, "2021-05", None), ("B-04", 40.3925, 49.8090, None, "2025-06"),
]
TREATMENT = "B-04"
# Land outline, (lon, lat).
LAND = [
    (49.35, 40.65), (49.50, 40.65), (49.55, 40.65), (49.60, 40.65), (49.65, 40.65), (49.72, 40.64), (49.75, 40.62), (49.80, 40.59), (49.85, 40.58), (49.90, 40.57),
    (49.95, 40.57), (50.00, 40.56), (50.05, 40.55), (50.10, 40.55), (50.15, 40.54), (50.18, 40.52), (50.20, 40.51), (50.21, 40.50), (50.22, 40.49), (50.21, 40.48),
    (50.19, 40.47), (50.17, 40.46), (50.16, 40.45), (50.14, 40.44), (50.13, 40.43), (50.12, 40.42), (50.11, 40.41), (50.11, 40.40), (50.11, 40.39), (50.10, 40.38),
    (50.08, 40.37), (50.07, 40.36), (50.07, 40.35), (50.06, 40.34), (50.06, 40.33), (50.04, 40.32), (50.00, 40.31), (49.95, 40.30), (49.90, 40.29), (49.80, 40.28),
    (49.75, 40.27), (49.70, 40.26), (49.60, 40.25), (49.50, 40.25), (49.40, 40.25), (49.35, 40.25), (49.35, 40.40), (49.35, 40.55), (49.35, 40.68),
]
# Multiple of node gravity, and whether planned stations open.
SCENARIOS = {"baseline": (1.0, False), "polycentric": (2.0, False), "transit": (1.5, True)}
AZ_MONTHS = ["yanvar", "fevral", "mart", "aprel", "may", "iyun", "iyul", "avqust", "sentyabr", "oktyabr", "noyabr", "dekabr"]

MIN_LISTINGS = 3
MIN_TRAIN_MONTHS = 18
SPATIAL_FOLDS = 5
HORIZONS = (12, 24)
TREATMENT_RADIUS_KM, BUFFER_KM, CONTROL_MAX_KM = 1.0, 2.0, 6.0
STATION_COUNT_KM = 2.0
Z80 = 1.2815515655446004
Z95 = 1.959963984540054
