"""Fixed schemas of the file inputs and stored tables."""

from __future__ import annotations

HEADERS = """
    path STRING, series_uid STRING, series_number STRING, series_description STRING, modality STRING,
    image_type ARRAY<STRING>, patient_position STRING, slice_thickness STRING, contrast_bolus_agent STRING,
    kvp STRING, study_description STRING, study_uid STRING, patient_id STRING,
    institutional_department STRING, study_date STRING, study_time STRING, error STRING
"""
LABELS = "ID STRING, Label INT"
LEDGER = """
    timestamp_utc STRING, study_id STRING, stage STRING, model STRING, input_tokens BIGINT, output_tokens BIGINT,
    cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, total_tokens BIGINT, latency_ms BIGINT,
    stop_reason STRING
"""
STUDY_RESULTS = """
    study_uid STRING, patient_id STRING, exam_date DATE, exam_datetime STRING, location STRING,
    raw_department STRING, ai_positive INT, dominant_class STRING, prob_any DOUBLE, prob_epidural DOUBLE,
    prob_intraparenchymal DOUBLE, prob_intraventricular DOUBLE, prob_subarachnoid DOUBLE, prob_subdural DOUBLE,
    series_folder STRING, checkpoint STRING, processed_datetime STRING
"""
TENSORS = "image_id STRING, h INT, w INT, image_norm ARRAY<DOUBLE>, window STRING, split STRING"
#: As stored: half-precision bytes instead of doubles.
TENSOR_STORE = "image_id STRING, h INT, w INT, image_half BINARY, window STRING, split STRING"
WORKLIST = """
    study_uid STRING, patient_id STRING, patient_name STRING, indication STRING, modality STRING,
    description STRING, physician_stat BOOLEAN, ai_positive BOOLEAN, dominant_class STRING, prob_any DOUBLE,
    report_paragraph STRING, impression_bullet STRING, sr_path STRING,
    metrics STRUCT<ppv: DOUBLE, npv: DOUBLE, pain_index: DOUBLE, tp: BIGINT, fn: BIGINT, fp: BIGINT, tn: BIGINT>,
    prevalence DOUBLE, exam_time STRING, processed_time STRING
"""
_POSITIVE = """STRUCT<study_uid: STRING, dominant_class: STRING, subtype_labels: MAP<STRING, INT>, n_slices: BIGINT,
    n_labelled: BIGINT, source: STRING, folder: STRING>"""
_NEGATIVE = "STRUCT<study_uid: STRING, n_slices: BIGINT, n_labelled: BIGINT, source: STRING, folder: STRING>"
MANIFEST = f"positive ARRAY<{_POSITIVE}>, negative ARRAY<{_NEGATIVE}>"
_METRICS = """STRUCT<auc: DOUBLE, prevalence: DOUBLE, sensitivity: DOUBLE, specificity: DOUBLE, ppv: DOUBLE,
    npv: DOUBLE, lr_positive: DOUBLE, lr_negative: DOUBLE, threshold: DOUBLE, n_positive: BIGINT, n_total: BIGINT>"""
METRICS = f"n_test BIGINT, mean_auc DOUBLE, weighted_log_loss DOUBLE, per_class MAP<STRING, {_METRICS}>"
SPLITS = "train_ids ARRAY<STRING>, val_ids ARRAY<STRING>, test_ids ARRAY<STRING>"
