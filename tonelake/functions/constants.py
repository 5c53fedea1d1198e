"""Fixed values of the domain."""

# --- fixed values: pipeline stages, in running order ---
STAGES = ("normalize", "separate", "transcribe", "quantize", "notation", "tab")
ML_STAGES = ("separate", "transcribe")

# --- fixed values: plans ---
PLAN_RANK = {"free": 0, "pro": 1, "unlimited": 2}
MIB = 1024 * 1024
# plan -> jobs per month (None: no limit), longest clip in seconds, largest upload, priority
PLAN_LIMITS = {
    "free": (10, 300, 64 * MIB, "normal"),
    "pro": (100, 900, 192 * MIB, "high"),
    "unlimited": (None, 900, 192 * MIB, "high"),
}
JOB_CREATES_PER_MINUTE = 10
ENTITLEMENT = "pro_access"
PROMOTIONAL = "promotional"
ANONYMOUS_PREFIX = "$RCAnonymousID:"
TERMS_VERSION = "2026-01"

# --- fixed values: upload types and the extension each is stored with ---
AUDIO_TYPES = {
    "audio/mp4": "m4a",
    "audio/x-m4a": "m4a",
    "audio/aac": "aac",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/x-wav": "wav",
    "audio/wave": "wav",
    "audio/flac": "flac",
    "audio/ogg": "ogg",
}
TYPE_BY_EXTENSION = {
    "m4a": "audio/mp4",
    "mp4": "audio/mp4",
    "aac": "audio/aac",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "flac": "audio/flac",
    "ogg": "audio/ogg",
}

# --- fixed values: queue ---
MAX_ATTEMPTS = 3
RETRY_BASE_DELAY_S = 10.0
VISIBILITY_TIMEOUT_S = 300
STAGE_SECONDS_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
MAX_DEVICES = 100
BACKUP_KEEP_DAYS = 14

# --- fixed values: rhythm (seconds unless said) ---
BEATS_PER_BAR = 4
SNAP_TOLERANCE_S = 0.045
MAX_TOLERANCE_BEATS = 0.125
ROLL_GAP_S = 0.035
ROLL_MAX_SPAN_S = 0.1
TRIPLET_ERROR_RATIO = 0.5
STRUM_GAP_S = 0.12
STRUM_SPAN_S = 0.2
STRUM_MIN_RING_S = 0.1
STRUM_MIN_SPREAD_S = 0.02
STRUM_JITTER_S = 0.008

# --- fixed values: Krumhansl-Kessler probe-tone profiles, from C ---
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
# Sharps (+) or flats (-) of each major key, by tonic pitch class.
MAJOR_FIFTHS = (0, -5, 2, -3, 4, -1, 6, 1, -4, 3, -2, 5)
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")

# --- fixed values: chords ---
CHORD_INTERVALS = {
    "maj": (0, 4, 7),
    "min": (0, 3, 7),
    "7": (0, 4, 7, 10),
    "maj7": (0, 4, 7, 11),
    "min7": (0, 3, 7, 10),
}
CHORD_SUBDIVISIONS = 2
BASS_MAX_PITCH = 52
CHROMA_POWER = 3.0
BASS_WEIGHT = 0.3
STAY_PROBABILITY = 0.95
MIN_ENERGY = 0.02
CHORD_SCALE = 10.0

# --- fixed values: fretboard ---
STANDARD_TUNING = (40, 45, 50, 55, 59, 64)  # lowest string first
DROP_D_TUNING = (38, 45, 50, 55, 59, 64)
MAX_FRET = 24
BEAM = 64
COMFORT_SPAN = 4
PITCH_RANGE = {"guitar": (38, 88), "piano": (21, 108)}

# --- fixed values: note decoding from frames ---
FRAMES_PER_SECOND = 100
ONSET_THRESHOLD = 0.3
OFFSET_THRESHOLD = 0.3
FRAME_THRESHOLD = 0.2
MAX_NOTE_FRAMES = 600
CHUNK_FRAMES = 1000
BORDER_FRAMES = 50

# --- fixed values: loudness ---
ABSOLUTE_GATE_LUFS = -70.0
RELATIVE_GATE_LU = -10.0
TARGET_LUFS = -20.0
PEAK_CEILING = 0.99
SILENCE_FLOOR_DB = -60.0
EDGE_RANGE_DB = 40.0

# --- fixed values: scoring ---
ONSET_TOLERANCE_S = 0.05
OFFSET_RATIO = 0.2
OFFSET_MIN_TOLERANCE_S = 0.05
TEMPO_TOLERANCE = 0.04
BEAT_TOLERANCE_S = 0.07
TRUTH_STRUM_GAP_S = 0.1
TRUTH_STRUM_SPAN_S = 0.25
STRUM_MIN_NOTES = 3
SEPARATE_S = 0.1
POSITION_TOLERANCE_BEATS = 0.125
METRIC_TOLERANCE = 0.025

# --- fixed values: edits ---
DIVISIONS = 12
MAX_NOTE_BEATS = 64
#: States of a job and of a stage, platforms of devices, and what a push token looks like (fixed values).
JOB_STATES = ("pending_upload", "queued", "running", "succeeded", "failed")
STAGE_STATES = ("pending", "running", "succeeded", "failed", "skipped", "cached")
PLATFORMS = ("ios", "android")
PUSH_TOKEN = r"^Expo(nent)?PushToken\[[A-Za-z0-9_-]+\]\z"
MAX_CAPO = 12
DEFAULT_VELOCITY = 80
#: Pace of the grid for clips in which too few beats were found.
FALLBACK_BPM = 120.0
