"""Schemas of the tables that readers give and writers take."""

from __future__ import annotations

SIGNAL_LONG = "session int, stream_id string, modality string, pos bigint, ts timestamp_ntz, channel string, value double, received_at timestamp_ntz"
LOG_EVENTS = "row_id bigint, log_key string, session int, marker string, category string, start_time double, end_time double, metadata string, origin string, recorded_at timestamp_ntz"
LOG_CSV = "Marker string, Start double, End double, Category string, Metadata string"
FEATURES_LONG = "sid string, session int, epoch bigint, channel string, feature string, value double"
#: Channels of a wide file by modality. Fixed values.
CHANNELS = {
    "ACC": ["X", "Y", "Z"],
    "GYRO": ["X", "Y", "Z"],
    "EEG": ["AF7", "AF8", "TP9", "TP10", "R_AUX"],
    "GSR": ["GSR"],
    "BVP": ["BVP"],
    "TEMP": ["TEMP"],
    "PPG": ["Ambient", "IR", "Red"],
}
