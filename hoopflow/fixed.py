"""Court geometry, thresholds, weights and word lists.

Everything here is a plain value that results depend on; no logic.
"""

# Court, feet.
LENGTH, WIDTH = 94.0, 50.0
HALF_X, MID_Y = 47.0, 25.0
RIM = (5.25, 25.0)
RIM_FAR = (88.75, 25.0)
PAINT_Y_LO, PAINT_Y_HI, PAINT_X = 17.0, 33.0, 19.0
ARC_R = 23.75
CORNER_Y_LO, CORNER_Y_HI, CORNER_X = 3.0, 47.0, 14.0
RESTRICTED_R = 4.0
TOP_OF_KEY = (29.25, 25.0)

# Ball id in tracking rows.
BALL_ID = -1

# Handler and segmentation.
HANDLER_DIST, HANDLER_BALL_Z, HANDLER_VEL_DIFF, HANDLER_HOLD = 4.0, 9.0, 6.0, 5
VOTE_DIST = 6.0
RESET_JUMP = 3.0
SHOT_Z = 10.0
FRAME_DT, MIN_DT = 1.0 / 25.0, 1e-4

# State.
PRESSURE_LEN, HEADING_SPEED, SCREEN_DIST, MAN_MEDIAN = 4.0, 0.5, 3.5, 7.0

# Actions.
SHOT_MAX, HEAVE_CLOCK, SIDELINE, SCREEN_MAX, RIM_ZONE = 32.0, 2.0, 3.0, 25.0, 4.0
DRIVE_STEP, DRIVE_LATERAL, DRIVE_SPEED, GUARD_RECOVERY = 8.0, 4.0, 6.0, 0.7
TURNOVER_VALUE = -0.10

# Feature defaults.
DEF_DIST, DEF_ANGLE, DEF_SHOT_CLOCK, DEF_PRIOR, CATCH_SECONDS = 30.0, 90.0, 12.0, 0.45, 0.4
LANE_WIDTH, HELP_MIDDLE = 3.0, 8.0
DRIVE_DROP, DRIVE_SUCCESS, DRIVE_FRAMES = 6.0, 8.0, 50
STEP_SECONDS, FIRST_STEP_WEIGHT = 2.0, 0.4
PRIOR_STRENGTH = 200.0

# Video.
CONF_PLAYERS, CONF_HOMOGRAPHY, CONF_IDENTITY, CONF_BALL = 0.35, 0.35, 0.15, 0.15
SHOW_CONF, SHOW_PLAYERS = 0.6, 8
INSET, PRESENCE = 1.5, 0.25
TRACK_GATE_PX, TRACK_MISSED = 90.0, 2
CUT_DIST, SNAP_SECONDS, DRIFT_FT = 0.5, 2.0, 2.5
BALL_GATE_PX, BALL_REACQUIRE = 280.0, 2

# Regret margins.
RIGHT_EPS, DEFENSIBLE, WRONG = 1e-6, 0.15, 0.30

# Play-by-play event codes.
MADE, MISSED, FREE_THROW, REBOUND, TURNOVER = 1, 2, 3, 4, 5
PERIOD_SECONDS = 720.0

SHOT_FEATURES = ["dist_to_rim", "angle_to_rim_deg", "closest_defender_dist", "defender_angle_deg",
                 "defender_pressure", "shot_clock", "is_three", "catch_and_shoot", "player_shot_prior"]
PASS_FEATURES = ["pass_distance", "defenders_in_lane", "receiver_separation",
                 "passer_facing_receiver", "receiver_pressure", "receiver_dist_to_rim"]
DRIVE_FEATURES = ["help_defenders_on_side", "primary_defender_lateral", "primary_defender_dist",
                  "driver_speed", "driver_dist_to_rim", "direction_sign"]

# Landmark name -> court feet.
LANDMARKS = {
    "corner_bl": (0.0, 0.0), "corner_tl": (0.0, 50.0),
    "corner_br": (94.0, 0.0), "corner_tr": (94.0, 50.0),
    "mid_bottom": (47.0, 0.0), "mid_top": (47.0, 50.0),
    "center_top": (47.0, 31.0), "center_bottom": (47.0, 19.0),
    "lpaint_bl": (0.0, 17.0), "lpaint_tl": (0.0, 33.0),
    "lpaint_br": (19.0, 17.0), "lpaint_tr": (19.0, 33.0),
    "rpaint_br": (94.0, 17.0), "rpaint_tr": (94.0, 33.0),
    "rpaint_bl": (75.0, 17.0), "rpaint_tl": (75.0, 33.0),
    "lft_top": (19.0, 31.0), "lft_bottom": (19.0, 19.0),
    "rft_top": (75.0, 31.0), "rft_bottom": (75.0, 19.0),
    "l3_break_bottom": (14.0, 3.0), "l3_break_top": (14.0, 47.0),
    "r3_break_bottom": (80.0, 3.0), "r3_break_top": (80.0, 47.0),
    "l3_apex": (29.0, 25.0), "r3_apex": (65.0, 25.0),
}

# Detector class needle -> our class, most specific first; a needle with a space matches
# anywhere in the name, the others match whole words.
CLASS_NEEDLES = [
    ("referee", "referee"), ("ref", "referee"),
    ("rim", "rim"), ("hoop", "rim"), ("basket", "rim"), ("net", "rim"),
    ("basketball", "ball"), ("ball", "ball"), ("sports ball", "ball"),
    ("player", "player"), ("person", "player"),
]
