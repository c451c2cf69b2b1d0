"""Reference data used by filters and the calibration study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S

# Excluded calibration sessions.
EXCLUDED_SESSIONS = (
    "0fdc28d4-b3f3-587d-b249-3bbd58521cdf", "1969e37b-f7e7-52eb-b37b-5d695ef88518",
    "255ab836-9dc0-56f6-87d6-dfdd53194b79", "2e8ad4c3-c179-5fdb-bbc4-08527d5eb610",
    "32b19b43-c2af-5957-8c12-b1fc8adf95a6", "353530a4-3115-5cee-9b60-2c01f7faf15e",
    "368413bd-63d3-5f33-a42f-f951b1cb5c43", "40e0108e-2b6c-5df8-8ae8-07e34d1895ab",
    "41ef39ad-6291-5f89-b2f7-4e963b7c2708", "4e9159a7-c442-5370-9eaf-2f5ddb2e57e8",
    "5efc0a25-14fa-55d2-9571-6088e19e1601", "67b6314d-c10d-5304-9186-b2d914b6f7a2",
    "68cb4c17-8285-5fdc-a1e8-37b0aaa244cc", "6dc7bc4f-2253-50d6-beaf-bb190ae188c4",
    "738fb0d5-1343-538e-8e52-a2176bd4e5fc", "88b84905-9515-5535-b329-6b48565774d6",
    "8a2f8e64-40c1-5433-892a-551f4155ce16", "98adb47e-3e18-5094-80df-405a0359b26f",
    "9e170b57-71e1-59b0-ae62-ac2c514423e8", "a0ff9f95-008c-5f2f-bec9-25eff5ed3113",
    "aa3fc614-ea39-582a-9600-f832b158ad1f", "b0a0e71c-9e8b-52a4-a959-4305e8f5e282",
    "b96671e6-3ee3-5097-8cd1-2a4ddc26b7cc", "b9e40c15-3acf-517c-864f-18fdfb83aefa",
    "bb7caf51-23a3-55fc-a722-d36dca9c4103", "c6a53d12-9e25-5dac-95e2-398a0ca57f01",
    "cab11798-3c7e-5370-ad1d-346a350ad3bd", "dc620531-6c85-56f5-b7b7-8a921bea6202",
    "f9873da1-241b-5ac7-ad26-df842216599c", "fa6be5c1-268f-5527-ae43-6d507313b387",
    "fb057641-d05a-5642-8c38-8663a9b20179",
)

# Excluded days, used only where the session id is missing.
EXCLUDED_DATES = (
    "2025-04-09", "2025-04-14", "2025-04-15", "2025-04-16", "2025-04-17", "2025-04-23", "2025-05-07",
    "2025-09-29", "2026-01-07", "2026-01-08", "2026-01-09", "2026-01-13", "2026-01-14", "2026-01-15",
    "2026-01-16", "2026-01-20", "2026-01-21", "2026-01-22", "2026-01-23", "2026-01-26", "2026-02-17",
    "2026-02-19", "2026-02-24", "2026-02-25", "2026-02-27", "2026-03-02", "2026-03-03", "2026-03-10",
    "2026-03-16", "2026-03-23",
)

# Batch, range, source line, beta absent, usable, calibrant thickness, note.
BATCH_RULES = (
    ("1", "101 - 198", "k-beta", False, False, 40.0, None),
    ("2", "199 - 213", "k-beta", False, False, 40.0, None),
    ("3", "214 - 354", "k-alpha", True, True, 40.0, None),
    ("4", "355 - 364", "k-alpha", True, True, 40.0, None),
    ("5", "365 - 399", "k-alpha", True, True, 40.0, None),
    ("6", "400 - 422", "k-beta", False, False, 40.0, None),
    ("7", "423 - 438", "k-alpha", True, True, 10.0, None),
    (None, None, "unknown", None, None, None, "separate metadata review required"),
)


def batch_rules(spark: SparkSession) -> DataFrame:
    """Eight rows, one per batch and one for rows without a batch."""
    return spark.createDataFrame(list(BATCH_RULES), S.BATCH_RULE)


def exclusion_lists(spark: SparkSession, ids=EXCLUDED_SESSIONS, dates=EXCLUDED_DATES) -> DataFrame:
    """(kind, value) rows of both exclusion lists."""
    return spark.createDataFrame(
        [("linked_agbh_session_uid", v) for v in ids] + [("started_at", v) for v in dates], "kind string, value string"
    )
