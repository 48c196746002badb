"""Registered queries against their SQL twins on the smallest tables."""

import pytest

from tests.check import compare, duck
from tidemark.catalog import cases

BASE = "/root/testdata/sf0.001"
NAMES = """w1_moving_average w3_local_maxima w4_top_peaks w6_level_features w7_rise w14_gap_prev s12_frames_from_pcm
f1_drop_noise_segments f3_apply_fixes f5_parse_aligned_array f8_keep_numeric_prefix f10_safe_name f11_dedupe_names f13_format_ts
f18_cue_score f23_conversion_flags g1_limit_runs g2_merge_close_segments g3_split_text g4_resplit_segments g7_make_batches
g8_batched_apply g9_incremental_apply i2_pick_threshold i3_gaps i7_merge_truth_groups j1_nearest_text j2_best_cue j3_nearest_match
j8_match_events e1_merge_candidates e2_merge_scan_down e3_merge_nearest_rep e4_merge_chain e5_select_spaced e6_snap_to_level
a5_precision_recall a12_auc a17_prefix_optimum l1_live_marks l2_latest_verdict l4_export_truth s6_read_rules s9_parse_truth_inline
k1_timed_lines_both k1_timed_lines_translated k3_write_segments_json k7_package_manifest s1_numbered_lines s1_read_timed_lines_keep
s3_read_log s4_list_media s13_locate_transcript a2_text_compare_gated g2_merge_blank_runs g9_incremental_apply_duplicates j1_nearest_text_large_ids
f6_normalize_nfkc m5_calibrate m6_leave_one_group_out m7_in_sample_vs_logo m13_grid_weights w15_spectral_features w18_model_row st1_live_marks_stream st4_progress_batch st7_log_tail
a32_sweep_merge a32_sweep_snap a32_sweep_top e13_detect_events_cues i4_split_at_quiet e10_kde_select""".split()
BLOCKED = """g1_limit_runs g2_merge_close_segments g7_make_batches i3_gaps j1_nearest_text j2_best_cue e2_merge_scan_down e5_select_spaced
a12_auc w4_suppress g2_merge_blank_runs g6_clean_pipeline w1_moving_average w3_local_maxima g9_incremental_apply f11_dedupe_names_cross
j2_best_cue j7_distance_to_truth k2_write_srt j1_nearest_text_large_ids w18_model_row i5_fill_gaps e3_merge_nearest_weighted e10_kde_select_gauss""".split()


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


def test_every_twin_belongs_to_a_query():
    registered = cases()
    assert len(registered) > 170
    assert all(callable(c.run) for c in registered.values())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    case = cases()[name]
    assert compare(con, case.run(spark, BASE), case.sql) is None


@pytest.mark.parametrize("name", BLOCKED)
def test_query_equals_sql_when_keys_span_blocks(spark, con, name):
    spark.conf.set("spark.tidemark.blockRows", "30")
    try:
        case = cases()[name]
        assert compare(con, case.run(spark, BASE), case.sql) is None
    finally:
        spark.conf.unset("spark.tidemark.blockRows")
