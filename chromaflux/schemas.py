"""Schemas of the tables that operators exchange."""

SAMPLES = "sample_id string, channel string, seq int, x double, y double"
PROCESSED = "sample_id long, seq long, x double, original_y double, smoothed_y double, baseline_y double, corrected_y double"
APEXES = "sample_id long, seq long, x double, y double, kind string, left long, right long"
PEAKS = (
    "sample_id long, compound_id string, peak_number int, retention_time double, integrator string, width double, area double, "
    "start_time double, end_time double, start_index int, end_index int, is_shoulder boolean, is_negative boolean, "
    "is_convoluted boolean, asymmetry double, skewness double, quality_issues array<string>"
)
MS_SCANS = "sample_id string, scan int, rt double, mz int, intensity double"
RT_TABLE = "seq int, compound string, start double, apex double, end double"
RF_TABLE = "seq int, compound string, response_factor double"
BANDS = "seq int, name string, x_min double, x_max double"
COMPOUNDS = "seq int, compound string, cas string, group1 string, group2 string, group3 string, c int, h int, o int, s int, n int, anchor string"
ANCHORS = "seq int, anchor string, cas string, c int, mw double, known_wt_pct double, area double"
