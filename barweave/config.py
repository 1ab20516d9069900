"""Defaults of the bar operators; every one is a keyword parameter where it is used."""

BAR = "1 minute"
FUTURE_STEPS = 6
WINDOW = 284
MIN_SESSION_POINTS = 60
DAY_START_HOUR = 6
GAP_MINUTES = 15.0
NMS_RADIUS = 284
MIN_SIMILARITY = 70.0
DTW_RADIUS = 10
FLAT = 0.15
VOTE_THRESHOLD = 0.00015
OUNCE_GRAMS = 31.1034768
DEFAULT_RATE = 6.7639
K_AGGRESSIVE, K_DEFENSIVE = 0.9, 1.4
INST_DRIFT = 0.04
MSE_BASE = 1e-4
