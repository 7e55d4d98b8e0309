"""Numbers and names that define the semantics of the engine.

Fixed values: results depend on every one of them, so they are stated once, here.
"""

# Elo
ELO_START = 1500.0
ELO_SCALE = 400.0
K_FLOOR = 16.0
K_START = 48.0
K_HALF_LIFE = 20.0

# Pair selection
RECENT_PAIRS = 100
POOL_SIZE = 96
COVERAGE_SLOTS = POOL_SIZE * 2 // 3
EXPLORATION_RATE = 0.12
ANCHOR_QUANTILES = 7
ANCHOR_MIN_MATCHES = 8
ANCHOR_MIN_OPPONENTS = 4
UNDER_COMPARED_MATCHES = 4
UNDER_CONNECTED_OPPONENTS = 3
ANCHOR_MIX_RATE = 0.4

# Issuances
TOKEN_TTL_HOURS = 24
USED_RETENTION_DAYS = 7
PURGE_BATCH = 128
TOKEN_PATTERN = "^[A-Za-z0-9_-]{43}$"
DIGEST_PATTERN = "^[0-9a-f]{64}$"
MAX_SAFE_INTEGER = 9007199254740991

# Wake-ups: seconds of the first and the longest wait, deliveries before giving up
WAKEUP_WAIT = 5
WAKEUP_MAX_WAIT = 300
WAKEUP_DELIVERIES = 64

# Training
MIN_COMPARISONS = 20
MIN_RATINGS = 5
RATING_LEVELS = 5
L2 = 0.01
MIN_THRESHOLD_GAP = 1e-3
INITIAL_CUTPOINT_GAP = 0.05
ENSEMBLE_MEMBERS = 8
MIN_FRESH_VALIDATION = 5
GATE_MIN_ACCURACY = 0.50
GATE_ACCURACY_REGRESSION = 0.02
GATE_LOG_LOSS_REGRESSION = 0.02
GATE_MAE_REGRESSION = 0.05
TRAINING_EVENTS = 10_000
TRAINING_IMAGES = 384
PARTICIPANT_SHARE = 0.75
PROBABILITY_CLIP = 1e-7

# Training cadence: (first, early increment, early limit, mature increment)
COMPARISON_CADENCE = (20, 20, 100, 50)
RATING_CADENCE = (5, 5, 50, 10)
TRAIN_ATTEMPT_CAP = 3
CRAWL_ATTEMPT_CAP = 3
RETRY_WINDOW_DAYS = 7
STALE_MINUTES = 20

# Single-machine jobs
LOCAL_MINIMUM = 20
LOCAL_BATCH = 50
LOCAL_UNRANKED = 20
LOCAL_POOL_FACTOR = 3
LOCAL_SCAN_FACTOR = 10
LOCAL_SCAN_FLOOR = 100

# Replenishment
CRAWL_BATCH = 10
CRAWL_DAILY_CAP = 100
CRAWL_BACKLOG = 50
CURATED_OVERFETCH = 20

# Source policy
POLICY_VERSION = "direct-rating-exp3-ix-v2"
POLICY_DISCOUNT = 0.995
POLICY_EXPLORATION = 0.20
POLICY_HISTORY = 4096
TASTE_MIN_FEEDBACK = 40
MAX_LEARNING_RATE = 0.25

# Candidate gates
NEAR_DUPLICATE_COSINE = 0.995
CANDIDATE_EXPLORATION = 0.20
MIN_EDGE = 1200
MIN_PIXELS = 2_500_000
MAX_EDGE = 30_000
MAX_PIXELS = 150_000_000
THUMBNAIL_EDGE = 512
ASPECT_TOLERANCE = 0.02
MIN_EDGE_ENERGY = 0.75
FILE_HOST = "upload.wikimedia.org"
PAGE_HOST = "commons.wikimedia.org"
ALLOWED_MIME = ("image/jpeg", "image/png", "image/webp")

# Licences that may enter a library.
FREE_LICENSES = (
    "Public domain",
    "CC0",
    "CC0 1.0",
    "PDM 1.0",
    "FAL",
    "Free Art License",
    "GFDL",
    "GFDL 1.2",
    "GFDL 1.3",
    "CC BY 1.0",
    "CC BY 2.0",
    "CC BY 2.5",
    "CC BY 3.0",
    "CC BY 4.0",
    "CC BY-SA 1.0",
    "CC BY-SA 2.0",
    "CC BY-SA 2.5",
    "CC BY-SA 3.0",
    "CC BY-SA 4.0",
    "CC BY-SA 3.0 at",
    "CC BY-SA 3.0 de",
)
# Hosts whose licence links are upgraded from http to https.
UPGRADED_HOSTS = ("creativecommons.org", "www.gnu.org", "artlibre.org", "www.artlibre.org")

# Rejection reasons, in the order the rules are tried.
REASON_DIMENSIONS = "invalid dimensions"
REASON_RESOLUTION = "insufficient resolution"
REASON_MIME = "unsupported media type"
REASON_ORIGIN = "invalid original-file provenance"
REASON_PAGE = "missing Commons description page"
REASON_IDENTIFIERS = "missing Commons identifiers"
REASON_ATTRIBUTION = "missing title or creator attribution"
REASON_NON_FREE = "non-free work"
REASON_LICENSE = "license is not allowlisted"
REASON_LICENSE_URL = "license URL does not match license"
REASON_THUMB_HOST = "invalid thumbnail provenance"
REASON_THUMB_SIZE = "invalid thumbnail dimensions"
REASON_METADATA = "invalid source metadata"
REASON_BYTES = "invalid file size"
REASON_BYTE_CAP = "file exceeds byte cap"
REASON_PIXEL_CAP = "source dimensions exceed decode safety cap"
REASON_DUPLICATE = "already in user library or run"
REASON_POOL = "thumbnail scoring pool filled"

# Rating reward
REWARD_STEPS = 4.0

# Hot keys are split on ranges of 2**20 consecutive ids, so one window frame never
# holds more rows than that, whatever share of the table its key owns.
CHUNK_BITS = 20
