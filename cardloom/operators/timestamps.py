"""Mixed timestamp forms and zones to one UTC instant, through a dictionary of distinct written values.

Every distinct (written value, source, zone, day/month order) is parsed once; the dictionary is a table that grows: a later run parses
only what it has not seen. The normalised values are joined back to the rows. The dictionary lies at the path given, or where the session's
setting `cardloom.timestamps.dictionary` says, and is then kept for later runs; without either it lasts as long as the application.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import timeparse
from cardloom.operators.skew import hot_keys, lookup
from cardloom.session import scratch_path, written

_KEYS = ["raw_", "source_", "zone_", "month_first_"]
SETTING = "cardloom.timestamps.dictionary"


class TimestampDictionary:
    """Distinct written values and what they denote, kept as Parquet at `path` (that of the setting, or in the shared folder, if none is given).

    Runs at the same time, or a job that is tried again, may write a value twice: a dictionary that was there before is read with each
    value once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or spark.conf.get(SETTING, None) or scratch_path(spark, "timestamps")
        self.schema = "raw_ string, source_ string, zone_ string, month_first_ boolean, instant_ timestamp, date_ date"

    def read(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def extend(self, keys: DataFrame) -> DataFrame:
        """Parse the keys that are not yet known and append them; returns the whole dictionary. `keys` must be distinct."""
        known = self.read()
        new, grown = keys.select(*_KEYS), not known.isEmpty()
        if grown:
            new = new.join(known, _KEYS, "left_anti")
        parsed = timeparse.parse(new)
        parsed.write.mode("append").parquet(self.path)
        return self.read().dropDuplicates(_KEYS) if grown else self.read()


def normalise(rows: DataFrame, columns: list[str], zone: str, locale: str, dictionary: TimestampDictionary | None = None, source: str | None = None) -> DataFrame:
    """`rows` with `<column>_utc` (timestamp) and `<column>_date` (date) for each of `columns`.

    `zone` and `locale` name columns of `rows`: the IANA zone of values without one (UTC where null or blank) and the locale that
    gives the order of day and month; `source` one that tells where a value comes from, so that values of one source are kept apart from
    those of another. A value denotes an instant, or a bare date, or (null, blank, nonsense, an impossible date or
    clock time, an unknown zone) nothing: both columns are then null. Rows are kept as they are, repeated ones too; columns of the
    same names as the new ones are replaced; other columns may have any name.
    """
    dictionary = dictionary or TimestampDictionary(rows.sparkSession)
    origin = F.lit("") if source is None else F.coalesce(F.col(source).cast("string"), F.lit(""))
    keyed = rows.withColumns({"source_": origin, "zone_": timeparse.canonical_zone(F.col(zone)), "month_first_": timeparse.month_first(F.col(locale))})
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stacked = reduce(DataFrame.unionAll, [keyed.select(value(c).alias("raw_"), "source_", "zone_", "month_first_") for c in columns])
    counts = written(stacked.groupBy(*_KEYS).agg(F.count("*").alias("n")), "written-values")
    values = dictionary.extend(counts)
    hot = hot_keys(counts, _KEYS)
    for c in columns:
        named = values.select(*_KEYS, F.col("instant_").alias(f"{c}_utc"), F.col("date_").alias(f"{c}_date"))
        keyed = lookup(keyed.drop(f"{c}_utc", f"{c}_date").withColumn("raw_", value(c)), named, _KEYS, hot).drop("raw_")
    return keyed.drop("source_", "zone_", "month_first_")


def card_instants(cards: DataFrame, gardens: DataFrame, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """id with occurred_at and created_at as instants or dates, by the zone and locale of the owner's garden. One row per card id.

    A card whose owner has no garden is read in UTC, day before month.
    """
    homes = gardens.select("owner", F.col("tz").alias("garden_tz_"), F.col("locale").alias("garden_locale_")).dropDuplicates(["owner"])
    rows = cards.select("id", "owner", "source", "occurred_at", "created_at").join(homes, "owner", "left")
    out = normalise(rows, ["occurred_at", "created_at"], "garden_tz_", "garden_locale_", dictionary, "source")
    return out.select("id", "occurred_at_utc", "occurred_at_date", "created_at_utc", "created_at_date").distinct()


def written_before_it_happened(cards: DataFrame, gardens: DataFrame) -> DataFrame:
    """Ids of cards whose occurred_at and created_at are both instants, the former the later."""
    return card_instants(cards, gardens).filter(F.col("occurred_at_utc") > F.col("created_at_utc")).select("id").distinct()
