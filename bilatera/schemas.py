"""Contracts: scan schemas, ordered output columns and policy constants."""

from __future__ import annotations

from pyspark.sql import types as T

D, S, L, I, B = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


MEASUREMENTS = _struct(
    ("measurement_id", L), ("patientId", S), ("specimenId", S), ("side", S), ("position", S),
    ("specimen_status", S), ("biopsy", B), ("age", D), ("sample_thickness_mm", D),
    ("calibrant_thickness_mm", D), ("poni_q_max_nm_inv", D), ("started_on", T.DateType()),
    ("linked_agbh_session_uid", S), ("q_range", T.ArrayType(D)), ("radial_profile_data", T.ArrayType(D)),
)

PIXELS = _struct(("measurement_id", L), ("row", I), ("col", I), ("q", D), ("counts", D))

CALIBRATION_SETS = _struct(
    ("file_path", S), ("file_name", S), ("session_uid", S), ("started_at", S), ("set_name", S),
    ("measurement_type_name", S), ("measurement_type_category", S), ("metadata", S),
    ("distance", D), ("exposure_time", D), ("poni", S), ("raw_file", S),
)

BATCH_RULE = _struct(
    ("data_batch", S), ("nova_range", S), ("source_line", S), ("kbeta_absent", B),
    ("product_batch_usable_for_kalpha_only", B), ("calibrant_thickness_mm", D), ("review_note", S),
)

# Mandatory output columns, then the ordered training and prediction column lists.
MANDATORY_COLUMNS = (
    "patientId", "specimenId", "side", "product_status_group", "biopsy", "radial_profile_data", "q_range",
    "specimen_measurement_count",
)
TRAINING_COLUMNS = (
    "patientId", "specimenId", "side", "position", "started_at", "measurementDate", "specimen_status",
    "product_status_group", "product_diagnosis", "patient_product_diagnosis", "age", "biopsy",
    "sample_biopsy", "sample_biopsy_type", "sample_height_in", "sample_weight_lb", "breast_density",
    "birads", "sample_thickness_mm", "calibrant_thickness_mm", "poni_q_max_nm_inv",
    "measurement_data_source", "q_range", "radial_profile_data", "snr_db", "specimen_measurement_count",
    "radial_profile_value_at_q", "radial_profile_nearest_q_nm_inv", "radial_profile_q_delta_nm_inv",
    "radial_profile_value_pass",
)
PREDICTION_COLUMNS = (
    "patientId", "session_uid", "session_id", "specimenId", "side", "target_side", "target_breast",
    "mammography_suspicious_field", "mammography_conclusion", "scan_date_time", "operator_id",
    "hardware_version", "eoscan_version", "experimental_protocol_version", "product_protocol_version",
    "position", "started_at", "measurementDate", "specimen_status", "product_status_group",
    "product_diagnosis", "patient_product_diagnosis", "age", "biopsy", "sample_thickness_mm",
    "calibrant_thickness_mm", "poni_q_max_nm_inv", "measurement_data_source", "q_range",
    "radial_profile_data", "snr_db", "specimen_measurement_count", "radial_profile_value_at_q",
    "radial_profile_nearest_q_nm_inv", "radial_profile_q_delta_nm_inv", "radial_profile_value_pass",
)

# Metadata columns carried from target rows into reports.
REPORT_METADATA = (
    "session_uid", "session_id", "scan_date_time", "started_at", "operator_id", "hardware_version",
    "eoscan_version", "experimental_protocol_version", "product_protocol_version",
    "mammography_suspicious_field", "mammography_conclusion",
)

# The four paired features of the second stage and its three base features.
CORE4 = (
    "sk_wasserstein_distance_full_q2", "sk_weightedrms1", "sk_weightedrms2", "sk_mean_peak_value_abs_delta",
)
BASE3 = ("profile_p_cancer_logit_average", "age", "age_available")

# The full paired feature vector in contract order.
PAIR_FEATURES = (
    "sk_meanrms1", "sk_weightedrms1", "sk_sigma_target1", "sk_sigma_contralateral1", "sk_mahalanobis1",
    "sk_meanrms2", "sk_weightedrms2", "sk_sigma_target2", "sk_sigma_contralateral2", "sk_mahalanobis2",
    "sk_peak14_intensity_abs_delta", "sk_mean_peak_value_abs_delta", "sk_wasserstein_distance_mu_tc",
    "sk_cosine_distance_full_q2", "sk_wasserstein_distance_full_q2",
)

# Signal policy.
POSITIONS = ("P1", "P2", "P3")
CALIBRANT_MM = (2.0, 40.0)
REQUIRED_Q_MAX = 23.0
Q_RANGE = (2.0, 23.0)
GRID_POINTS = 100
MIN_SNR_DB = 18.0
NORM_BAND = (6.7, 7.1)
GATE_Q, GATE_MIN = 14.0, 2.0
BRIGHT_PIXEL_MIN, BEAM_RADIUS = 500.0, 0.04
STATUS_KEEP = ("BENIGN", "NORMAL", "CANCER", "ATYPICAL", "PRE_CANCEROUS")
GROUP_KEEP = ("BENIGN", "CANCER")
CANCER_VALUES = ("CANCER", "ATYPICAL", "PRE_CANCEROUS")
