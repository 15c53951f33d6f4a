"""Fixed protocol values shared by every operator.

These must be equal to the published protocol for results to match; change them
only together with a new protocol version.
"""

# -- fixed values: sampling and windows ------------------------------------
SAMPLING_RATE_HZ = 25.0
WINDOW_LENGTH = 50
STRIDE_SECONDS = 0.5
GRAVITY = 9.80665

CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz")
NORMS = ("acc_norm", "gyr_norm")
SIGNALS = CHANNELS + NORMS

# -- fixed values: annotations ---------------------------------------------
KIND_ORDER = {"activity": 0, "onset": 1, "impact": 2, "exclude": 3}
SUPERVISION_KINDS = ("temporal", "recording")

# -- fixed values: splits and sampling -------------------------------------
FOLD_COUNT = 5
TEAM_FOLD = -1
SEED = 3888
TOP_FRACTION = 0.1
NATURAL = "natural"
BALANCED = "participant_class_balanced"
NOT_APPLICABLE = "not_applicable"

# -- fixed values: published feature names (158 columns, in this order) ----
SIGNAL_NAMES = (
    "acceleration_x_mps2",
    "acceleration_y_mps2",
    "acceleration_z_mps2",
    "angular_velocity_x_rad_s",
    "angular_velocity_y_rad_s",
    "angular_velocity_z_rad_s",
    "acceleration_norm_mps2",
    "angular_velocity_norm_rad_s",
)
TIME_STATISTICS = (
    "mean",
    "std",
    "min",
    "max",
    "median",
    "iqr",
    "peak_to_peak",
    "mean_abs_first_difference",
    "skewness",
    "excess_kurtosis",
    "mean_square_energy",
)
WINDOW_FEATURES = (
    "acceleration_sma",
    "angular_velocity_sma",
    "acceleration_peak_relative_time",
    "angular_velocity_peak_relative_time",
    "acceleration_jerk_norm__mean",
    "acceleration_jerk_norm__std",
    "acceleration_jerk_norm__max",
    "acceleration_jerk_norm__rms",
    "acceleration_xy_correlation",
    "acceleration_xz_correlation",
    "acceleration_yz_correlation",
    "angular_velocity_xy_correlation",
    "angular_velocity_xz_correlation",
    "angular_velocity_yz_correlation",
)
FREQUENCY_STATISTICS = (
    "dominant_frequency_hz",
    "spectral_centroid_hz",
    "spectral_entropy",
    "relative_power_0_0p5_hz",
    "relative_power_0p5_3_hz",
    "relative_power_3_8_hz",
    "relative_power_8_12p5_hz",
)


def feature_names():
    """The published column order, built from the three name lists."""
    per_signal = [f"{s}__{t}" for s in SIGNAL_NAMES for t in TIME_STATISTICS]
    spectral = [f"{s}__{t}" for s in SIGNAL_NAMES for t in FREQUENCY_STATISTICS]
    return per_signal + list(WINDOW_FEATURES) + spectral


# -- fixed values: the eight published alarm policies ----------------------
# (id, required positive windows, lookback windows, consecutive, cooldown seconds)
POLICIES = (
    ("one_of_one_cooldown_10s", 1, 1, True, 10.0),
    ("one_of_one_cooldown_30s", 1, 1, True, 30.0),
    ("consecutive_two_cooldown_10s", 2, 2, True, 10.0),
    ("consecutive_two_cooldown_30s", 2, 2, True, 30.0),
    ("two_of_three_cooldown_10s", 2, 3, False, 10.0),
    ("two_of_three_cooldown_30s", 2, 3, False, 30.0),
    ("three_of_five_cooldown_10s", 3, 5, False, 10.0),
    ("three_of_five_cooldown_30s", 3, 5, False, 30.0),
)
REFERENCE_POLICY = "one_of_one_cooldown_10s"
# Short cooldowns that re-fire inside the ~8 s test sequences.
SHORT_POLICIES = (
    ("one_of_one_cooldown_1_5s", 1, 1, True, 1.5),
    ("two_of_three_cooldown_1_5s", 2, 3, False, 1.5),
    ("consecutive_two_cooldown_4s", 2, 2, True, 4.0),
    ("three_of_five_cooldown_4s", 3, 5, False, 4.0),
)

# -- column names used as keys ---------------------------------------------
SEQ = ("recording_id",)
JOB = ("model_id", "recipe", "fold", "seed")
