"""stormrail: Spark-native analytics for hourly rail delays joined with weather.

Every public operator takes DataFrames (plus column names / parameters) and
returns a DataFrame; nothing is collected to the driver except tiny,
size-bounded parameter tables (class counts, fold boundaries).
"""

__version__ = "0.1.0"
