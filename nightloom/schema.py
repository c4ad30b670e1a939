"""Table schemas (Spark DDL) and their value sets."""

KINDS = ("bias", "dark", "flat")

CALIBRATION_SET = (
    "id STRING, kind STRING, source_path STRING, master_path STRING, date DATE, frame_count BIGINT, temperature DOUBLE, "
    "gain BIGINT, `offset` BIGINT, binning STRING, exposure DOUBLE, filter STRING, created_at TIMESTAMP"
)
OBSERVATION_SET = (
    "id STRING, target_name STRING, target_ra DOUBLE, target_dec DOUBLE, date DATE, filter STRING, exposure DOUBLE, frame_count BIGINT, "
    "temperature DOUBLE, gain BIGINT, `offset` BIGINT, binning STRING, raw_path STRING, calibrated_path STRING, site_lat DOUBLE, site_long DOUBLE, created_at TIMESTAMP"
)
CALIBRATION_LINK = "observation_id STRING, master_id STRING, kind STRING"
LAYERS = "project STRING, framing STRING, layer STRING, panel STRING, filter STRING, extract_background BOOLEAN, feather_pixels FLOAT, paths ARRAY<STRING>"
LOCK = "project STRING, layer STRING, panel STRING, input_hash STRING, master_light STRING, registered_master_light STRING, stacked_at STRING"
FRAMES = (
    "frame_id STRING, seq STRING, idx INT, included BOOLEAN, is_ref BOOLEAN, width INT, height INT, channels INT, bitpix INT, "
    "header MAP<STRING,STRING>, data ARRAY<FLOAT>"
)
PIXELS = "frame_id STRING, channel INT, y INT, x INT, v DOUBLE"
FRAME_QUALITY = "frame_id STRING, fwhm DOUBLE, wfwhm DOUBLE, roundness DOUBLE, quality DOUBLE, nbstars INT, bkg DOUBLE, nbstack INT"
MESSAGES = "line_no BIGINT, line STRING"
LISTING = "path STRING, parent STRING, ext STRING"
