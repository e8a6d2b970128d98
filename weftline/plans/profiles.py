"""Source profiles: how the pages of a news source are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_SCHEMA = """name string, display_name string, timezone string, utc_offset string, date_patterns array<string>,
  section_labels array<string>, noise_markers array<string>, sponsored_markers array<string>, exclusive_markers array<string>,
  opinion_labels array<string>"""

# The known profile, and the generic one for all other sources.
PROFILES = (
    (
        "scmp", "South China Morning Post", "Asia/Hong_Kong", "+08:00",
        [r"\d{1,2}\s+\w+\s+\d{4}\s*-\s*\d{1,2}:\d{2}[AP]M", r"\d+\s+(minutes?|hours?)\s+ago"],
        ["Business", "Tech", "China Economy", "Banking & Finance", "Opinion", "Markets", "Companies", "Property", "China", "Asia", "World"],
        ["TRENDING TOPICS", "MOST POPULAR", "MORE LATEST NEWS", "MORE COMMENT"],
        ["In partnership with:", "Paid Post:"], ["Exclusive"], ["Opinion", "Macroscope", "As I see it"],
    ),
    (
        "generic", "Unknown Source", "UTC", "+00:00",
        [r"\d{1,2}\s+\w+\s+\d{4}\s*-\s*\d{1,2}:\d{2}[AP]M", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}", r"\w+\s+\d{1,2},?\s+\d{4}", r"\d+\s+(minutes?|hours?|days?)\s+ago"],
        [],
        ["TRENDING", "MOST POPULAR", "ADVERTISEMENT", "SPONSORED"],
        ["Sponsored:", "Paid Post:", "In partnership with:"], ["Exclusive", "EXCLUSIVE"], ["Opinion", "Editorial", "Commentary"],
    ),
)
GENERIC = "generic"


def profiles(spark: SparkSession) -> DataFrame:
    """The profile dimension; new sources are new rows."""
    return spark.createDataFrame(list(PROFILES), PROFILE_SCHEMA)


#: What a profile must have, in order.
REQUIRED = [x.split()[0] for x in PROFILE_SCHEMA.replace("\n", " ").split(", ")]


def missing_keys(profile: dict) -> list[str]:
    """Required keys that a profile given as a dict lacks, in order."""
    return [k for k in REQUIRED if k not in profile]


def with_missing_keys(texts: DataFrame, column: str = "value") -> DataFrame:
    """Profiles given as JSON objects with ``missing``, the required keys that they lack, in order; of what is no object all
    are missing."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    return texts.withColumn("missing", F.array_except(F.array(*map(F.lit, REQUIRED)), keys))
