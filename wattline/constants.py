"""Domain constants and enumerations of the trace formats (fixed values)."""

from __future__ import annotations

MICRO = 1_000_000
HOUR_US, DAY_US = 3600 * MICRO, 86400 * MICRO
MIN_SAMPLE_US = 300 * MICRO
SAMPLES_PER_HOUR = 12
TRACE_START_US = 600 * MICRO
POWER_SHIFT_US = -600 * MICRO + 300 * MICRO

DAY, WINDOW, VOL_WINDOW = 288, 2016, 288
FLEET_SPLIT = 20 * DAY
FLEET_HORIZONS = (1, 3, 6, 12)
LIMIT_HORIZONS = (1, 3, 6, 12, 36, 72)
LIMIT_ALPHAS = (0.95, 0.99, 0.999)
VERDICTS = ((5.0, 0.15, "validated"), (2.0, 0.30, "marginal"))
FAULT_MAGNITUDES = (0.005, 0.01, 0.02, 0.03)
FAULT_STEPS, FAULT_ONSETS = 144, 20
SITE_MW, ENGINE_MW = 1000.0, 9.6
EXCLUDED_CELLS = ("i", "j")
#: Inclusive priority bands; everything else, null included, is production.
TIER_BANDS = ((0, 99, "1_free"), (100, 115, "2_beb"), (116, 119, "3_mid"))
OTHER_TIER = "4_prod"
CAPPABLE_BELOW = 120

NO_MACHINE, DEDICATED_MACHINE, NO_ALLOC, NO_ALLOC_INDEX = 0, -1, 0, -1
ENUMS = {
    "collection_type": ("JOB", "ALLOC_SET"),
    "event_type": ("SUBMIT", "QUEUE", "ENABLE", "SCHEDULE", "EVICT", "FAIL", "FINISH", "KILL", "LOST", "UPDATE_PENDING", "UPDATE_RUNNING"),
    "missing_type": ("MISSING_TYPE_NONE", "SNAPSHOT_BUT_NO_TRANSITION", "NO_SNAPSHOT_OR_TRANSITION", "EXISTS_BUT_NO_CREATION", "TRANSITION_MISSING_STEP", "TOO_MANY_EVENTS"),
    "latency_sensitivity": ("MOST_INSENSITIVE", "INSENSITIVE", "SENSITIVE", "MOST_SENSITIVE"),
    "scheduler": ("SCHEDULER_DEFAULT", "SCHEDULER_BATCH"),
    "vertical_scaling": ("VERTICAL_SCALING_SETTING_UNKNOWN", "VERTICAL_SCALING_OFF", "VERTICAL_SCALING_CONSTRAINED", "VERTICAL_SCALING_FULLY_AUTOMATED"),
    "relation": ("EQUAL", "NOT_EQUAL", "LESS_THAN", "GREATER_THAN", "LESS_THAN_EQUAL", "GREATER_THAN_EQUAL", "PRESENT", "NOT_PRESENT"),
    "machine_event": ("EVENT_TYPE_UNKNOWN", "ADD", "REMOVE", "UPDATE"),
    "missing_data_reason": ("MISSING_DATA_REASON_NONE", "SNAPSHOT_BUT_NO_TRANSITION"),
}
