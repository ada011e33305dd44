"""Fixed values the analyses depend on.

Everything in this module is a domain constant that must equal the values the
original pipeline uses (season months, tariffs, thresholds, labels, feature
order, household profiles). They are stated plainly and in natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: calendar
# ---------------------------------------------------------------------------
# Southern-hemisphere seasons by month number.
SEASON_MONTHS = {
    "Winter": (6, 7, 8),
    "Summer": (12, 1, 2),
    "Autumn": (3, 4, 5),
    # every other month (9, 10, 11) is Spring
}
SEASONS = ("Autumn", "Spring", "Summer", "Winter")  # alphabetical: one-hot column order
SEASON_MID_MONTH = {"Winter": 7, "Summer": 1, "Spring": 10, "Autumn": 4}
SEASON_MID_MONTH_DEFAULT = 1

DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WEEKEND_DAYS = ("Saturday", "Sunday")
WEEKDAY_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")

# Time-of-use periods (dashboard): [6,9) Morning Peak, [9,17) Daytime, [17,21) Evening Peak, else Off-Peak.
PEAK_PERIODS = ("Morning Peak", "Evening Peak")

# BI calculated field: 17..21 Evening Peak, 7..10 Morning Peak (inclusive), else Off-Peak.
BI_EVENING_HOURS = (17, 21)
BI_MORNING_HOURS = (7, 10)

# ---------------------------------------------------------------------------
# FIXED VALUES: tariff model
# ---------------------------------------------------------------------------
TARIFF_PEAK = 2.85
TARIFF_OFFPEAK = 1.45
PEAK_SHIFT_FRACTION = 0.20

# ---------------------------------------------------------------------------
# FIXED VALUES: outage severity bins (right-closed): (-1,0], (0,2], (2,4], (4,6]
# ---------------------------------------------------------------------------
SEVERITY_LABELS = ("No Outage", "Low (1-2)", "Medium (3-4)", "High (5-6)")
SEVERITY_EDGES = (-1, 0, 2, 4, 6)
MAX_STAGE = 6

# ---------------------------------------------------------------------------
# FIXED VALUES: categories
# ---------------------------------------------------------------------------
# Scoring category: Low below 0.7, Normal below 1.5, else High; thresholds x1.4 in
# Winter and x1.5 for hours 18..21.
CATEGORY_LOW = 0.7
CATEGORY_NORMAL = 1.5
CATEGORY_WINTER_MULT = 1.4
CATEGORY_EVENING_MULT = 1.5
CATEGORY_EVENING_HOURS = (18, 21)
# Scenario simulator: <0.5 Low, <1.0 Normal, <1.5 Above Average, else High.
FIXED_CATEGORY_BOUNDS = ((0.5, "Low"), (1.0, "Normal"), (1.5, "Above Average"))
FIXED_CATEGORY_TOP = "High"
# BI: avg_kwh <2 Low, <2.5 Medium, else High.
BI_CATEGORY_BOUNDS = ((2.0, "Low"), (2.5, "Medium"))
BI_CATEGORY_TOP = "High"

# ---------------------------------------------------------------------------
# FIXED VALUES: anomaly, bands, histogram, data quality
# ---------------------------------------------------------------------------
ANOMALY_Z = 2.5
BAND_Z = 1.96
BAND_HOURS = 24
HISTOGRAM_BINS = 50
NORMAL_FIT_POINTS = 100
HIGH_USAGE_KWH = 6.0
PCT_ERROR_FLOOR = 0.01
EVENING_HOURS = (18, 21)  # analysis "evening peak" window, inclusive
TREND_MIN_DAYS = 10       # a trend line needs more than this many days
FORECAST_DAYS = 7

# ---------------------------------------------------------------------------
# FIXED VALUES: error-by-scenario subsets (name, description)
# ---------------------------------------------------------------------------
WINTER_PEAK_HOURS = (17, 21)
SUMMER_MIDDAY_HOURS = (11, 14)

# ---------------------------------------------------------------------------
# FIXED VALUES: households and the expected-load model
# ---------------------------------------------------------------------------
HOUSEHOLDS = ("House_1", "House_2", "House_3", "House_4", "House_5")
# household_id, base_load, peak_sensitivity, backup_power, resilience
HOUSEHOLD_PROFILES = (
    ("House_1", 0.8, 1.8, False, 0.3),
    ("House_2", 1.2, 2.5, True, 0.7),
    ("House_3", 1.0, 2.2, False, 0.4),
    ("House_4", 1.5, 3.2, True, 0.8),
    ("House_5", 0.9, 2.0, False, 0.2),
)
SIM_SEASON_FACTOR = {"Winter": 1.4, "Summer": 1.0, "other": 0.9}
# hour ranges are half-open [lo, hi)
SIM_TIME_FACTORS = (((6, 9), 1.3), ((9, 17), 0.8), ((18, 22), 1.8))
SIM_TIME_FACTOR_OTHER = 0.5
SIM_BACKUP_FLOOR = 0.2
SIM_BACKUP_SPAN = 0.3
SIM_NO_BACKUP_FACTOR = 0.05
SIM_REBOUND_WEIGHT = 0.5

# ---------------------------------------------------------------------------
# FIXED VALUES: model features, in model input order
# ---------------------------------------------------------------------------
FEATURES = (
    "hour", "day_of_week", "is_weekend", "month",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "season_Autumn", "season_Spring", "season_Summer", "season_Winter",
    "is_load_shedding", "post_load_shedding", "load_shedding_stage_normalized",
    "has_backup_power",
    "household_House_1", "household_House_2", "household_House_3",
    "household_House_4", "household_House_5",
)
LABEL = "energy_consumption"

FEATURE_DESCRIPTIONS = (
    ("hour", "Hour of the day (0-23)"),
    ("day_of_week", "Day of week (0=Monday, 6=Sunday)"),
    ("is_weekend", "1 if weekend, 0 if weekday"),
    ("month", "Month of the year (1-12)"),
    ("hour_sin", "Sine component of hour (cyclical encoding)"),
    ("hour_cos", "Cosine component of hour (cyclical encoding)"),
    ("dow_sin", "Sine component of day of week"),
    ("dow_cos", "Cosine component of day of week"),
    ("season_Winter", "1 if winter (June-August), 0 otherwise"),
    ("season_Summer", "1 if summer (Dec-Feb), 0 otherwise"),
    ("season_Autumn", "1 if autumn (Mar-May), 0 otherwise"),
    ("season_Spring", "1 if spring (Sep-Nov), 0 otherwise"),
    ("is_load_shedding", "1 if electricity outage is active, 0 otherwise"),
    ("post_load_shedding", "1 if this hour is immediately after outage ends, 0 otherwise"),
    ("load_shedding_stage_normalized", "Severity of outage (0=none, 1=stage 6)"),
    ("has_backup_power", "1 if household has generator/battery, 0 otherwise"),
    ("household_House_1", "1 if House_1, 0 otherwise"),
    ("household_House_2", "1 if House_2, 0 otherwise"),
    ("household_House_3", "1 if House_3, 0 otherwise"),
    ("household_House_4", "1 if House_4, 0 otherwise"),
    ("household_House_5", "1 if House_5, 0 otherwise"),
)

# Feature family, first matching rule wins (substring of the lower-cased name).
FEATURE_FAMILY_RULES = (
    (("hour", "day", "weekend"), "time"),
    (("season", "month"), "season"),
    (("load_shedding", "backup"), "outage"),
    (("household",), "household"),
)
FEATURE_FAMILY_OTHER = "other"

# ---------------------------------------------------------------------------
# FIXED VALUES: scoring requests
# ---------------------------------------------------------------------------
REQUEST_DEFAULTS = {
    "hour": 12,
    "day_type": "weekday",
    "season": "Summer",
    "load_shedding_stage": 0,
    "has_backup_power": False,
    "household_id": "House_1",
}
DAY_TYPES = ("weekday", "weekend")
VALIDATION_MESSAGES = (
    "hour must be 0-23",
    "day_type must be 'weekday' or 'weekend'",
    "season must be Winter, Summer, Spring, or Autumn",
    "load_shedding_stage must be 0-6",
    "household_id must be House_1 to House_5",
)
# Explanation phrases, in the order they are joined with " + ".
EXPLAIN_MORNING = "morning peak time"              # 6 <= hour < 9
EXPLAIN_EVENING = "evening peak time"              # 18 <= hour <= 21
EXPLAIN_NIGHT = "night (low consumption)"          # 0 <= hour < 5
EXPLAIN_WINTER = "winter season (higher heating demand)"
EXPLAIN_SUMMER = "summer season (lower heating, more cooling)"
EXPLAIN_BACKUP = "backup power available during outage"
EXPLAIN_WEEKEND = "weekend (different consumption pattern)"
EXPLAIN_DEFAULT = "standard conditions"
TOP_DRIVERS = 3

# Scenario simulator fixes the weekday to Wednesday and the household to House_1.
SCENARIO_DAY_OF_WEEK = 2
SCENARIO_HOUSEHOLD = "House_1"

# ---------------------------------------------------------------------------
# FIXED VALUES: model hyper-parameters of the original training script
# ---------------------------------------------------------------------------
FOREST_PARAMS = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2, "seed": 42}
BOOSTED_PARAMS = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 2, "seed": 42}
TEST_FRACTION_BUCKETS = 5  # one bucket of five is the hold-out: 80/20
MIN_SPLIT = 5  # rows that a tree node needs to be split
SEED = 42
