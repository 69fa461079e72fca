"""Fixed values of the data model: they set results and must stay as they are."""

SAMPLE_RATE_HZ = 16000
WINDOW_SECONDS, HOP_SECONDS = 0.975, 0.4875
WINDOW_SAMPLES, HOP_SAMPLES = 15600, 7800
STFT_WINDOW_MS, STFT_HOP_MS = 25, 10
STFT_WINDOW_SAMPLES, STFT_HOP_SAMPLES, FFT_SIZE = 400, 160, 512
MEL_BANDS, MEL_MIN_HZ, MEL_MAX_HZ = 64, 125.0, 7500.0
PITCH_MIN_HZ, PITCH_MAX_HZ, PITCH_FRAME_MS, PITCH_HOP_MS = 80.0, 1200.0, 25, 10
ENVELOPE_HOP_MS = 10
SILENCE_EPSILON, DBFS_FLOOR = 1e-7, -120.0
EMBEDDING_DIMENSIONS = 1024
OCTAVE_BAND_EDGES_HZ = [62.5 * 2**i for i in range(8)]
PROFILE_SCHEMA_VERSION = COMPACT_PROFILE_SCHEMA_VERSION = KNN_SCHEMA_VERSION = 1
