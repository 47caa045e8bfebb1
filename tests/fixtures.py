"""Hand fixtures with hand-derived answers."""
import datetime as dt

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("entity", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("start", T.TimestampNTZType()), T.StructField("end", T.TimestampNTZType())])

EVENT_ROWS = [
    (1, 1, dt.datetime(2010, 1, 1, 0, 0), dt.datetime(2010, 1, 5, 0, 0)),
    (1, 2, dt.datetime(2010, 1, 20, 12, 0), dt.datetime(2010, 1, 20, 18, 0)),
    (1, 3, dt.datetime(2010, 1, 20, 12, 0), dt.datetime(2010, 1, 25, 12, 0)),
    (1, 4, dt.datetime(2010, 2, 24, 12, 0), dt.datetime(2010, 2, 27, 11, 0)),
    (1, 5, dt.datetime(2010, 2, 28, 10, 0), dt.datetime(2010, 3, 1, 10, 0)),
    (2, 6, dt.datetime(2010, 5, 1, 0, 0), dt.datetime(2010, 5, 3, 0, 0)),
]

# id -> (gap to next, label, kept, LOS, LOS band, prior n, days since last,
#        had prior readmission, mean prior LOS, rate/yr, frequent)
EXPECTED = {
    1: (15, 1, True, 4, "Medium", 0, None, 0, None, 0.0, 0),
    2: (-1, 0, True, 0, None, 1, 15, 0, 4.0, 10.0, 0),
    3: (30, 1, True, 5, "Medium", 1, 15, 0, 4.0, 10.0, 0),
    4: (0, 0, True, 2, "Short", 3, 30, 1, 3.0, 20.2917, 1),
    5: (None, 0, False, 1, "Short", 4, 0, 1, 2.75, 25.1897, 1),
    6: (None, 0, False, 2, "Short", 0, None, 0, None, 0.0, 0),
}


def events_df(spark):
    return spark.createDataFrame(EVENT_ROWS, EVENT_SCHEMA)
