"""Fixed values that must equal the reference's for equal results.

Fixed values (stated as text, in their natural order):
- missing-value sentinel: -99
- "no precipitation" marker in observation data: -1
- delay class limits (minutes): 10, 50, 100
- threshold classes for probabilities: 0, 0.2, 0.4, 0.6
- text spellings of missing values in observation text: "null", "nan", "NaN", "NULL"
- latitude band lower limits (exclusive): band 1 above 59, band 2 above 61.55, band 3 above 63.41; band 0 otherwise
- band quantile pairs: 0.1 / 0.9 and 0.05 / 0.95
- neighbour imputation: at most 2 positions away in latitude order, at most 150 km
- earth radius for the equirectangular distance: 6371 km
- winter months: 11, 12, 1, 2, 3, 4; summer months: 6, 7, 8
- train type codes: K, L, T, M -> 0, 1, 2, 3
- climatology RMSE constants for the skill score: 3.3760 (averaged delay), 6.0112 (summed delay)
- delay time zone of the raw delay files: Europe/Helsinki
- gap that splits a series into periods: 30 days = 2592000 seconds
- observation station search: 5 nearest within 100 km; strikes within 30 km
- serving files: at most 100 rows per file
"""

MISSING = -99.0
NO_RAIN = -1.0
DELAY_CLASS_LIMITS = (10, 50, 100)
PROBA_THRESHOLDS = (0.0, 0.2, 0.4, 0.6)
MISSING_TEXTS = ("null", "nan", "NaN", "NULL")
LAT_BANDS = ((3, 63.41), (2, 61.55), (1, 59.0))
BAND_QUANTILES_NARROW = (0.1, 0.9)
BAND_QUANTILES_WIDE = (0.05, 0.95)
IMPUTE_MAX_POSITIONS = 2
IMPUTE_MAX_KM = 150.0
EARTH_RADIUS_KM = 6371.0
WINTER_MONTHS = (11, 12, 1, 2, 3, 4)
SUMMER_MONTHS = (6, 7, 8)
TRAIN_TYPE_CODES = {"K": 0, "L": 1, "T": 2, "M": 3}
CLIMATOLOGY_RMSE_AVERAGED = 3.3760
CLIMATOLOGY_RMSE_SUM = 6.0112
DELAY_TIMEZONE = "Europe/Helsinki"
PERIOD_GAP_SECONDS = 2592000
NEAREST_OBS_STATIONS = 5
NEAREST_OBS_MAX_KM = 100.0
STRIKE_RADIUS_KM = 30.0
SERVING_ROWS_PER_FILE = 100

# Aggregates that a parameter's name can begin with.
AGG_PREFIXES = ("min", "max", "mean", "sum", "median")
