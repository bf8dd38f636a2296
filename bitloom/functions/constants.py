"""Fixed values of the archive format, its labels and the parameter domains."""

MAGIC = b"ARCH"

# fixed values: wire identifiers
PICTURE, BINARY_FILE, AUDIO = 1, 2, 3
HUFFMAN, LZ78, CHAINED, RLE_QUANT, PCM, DM, ADM, DPCM = 1, 2, 3, 4, 5, 6, 7, 8

# fixed values: labels
FILE_TYPE_LABELS = {PICTURE: "Picture", BINARY_FILE: "Binary File / PDF", AUDIO: "Audio Waveform"}
ALGORITHM_LABELS = {
    HUFFMAN: "Huffman",
    LZ78: "LZ78",
    CHAINED: "Chained (LZ78 + Huffman)",
    RLE_QUANT: "RLE + Spatial Quantization",
    PCM: "PCM (Uniform Quantization)",
    DM: "Delta Modulation (DM)",
    ADM: "Adaptive Delta Modulation (ADM)",
    DPCM: "Differential PCM (DPCM)",
}
SHORT_AUDIO_LABELS = {PCM: "PCM", DM: "DM", ADM: "ADM", DPCM: "DPCM"}
BYTE_ALGORITHMS = (HUFFMAN, LZ78, CHAINED)
AUDIO_ALGORITHMS = (PCM, DM, ADM, DPCM)

# fixed values: extensions
IMAGE_EXTENSIONS = ("avif", "bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
AUDIO_EXTENSIONS = ("flac", "m4a", "mp3", "ogg", "wav")

HEADER_BYTES, AUDIO_BLOCK_BYTES = 8, 16
MAX_RUN = 65_535
SAMPLING_FACTORS, CHANNEL_COUNTS = (1, 2, 4), (1, 2)
ADM_STEP_MIN, ADM_STEP_MAX, ADM_MULTIPLIER = 1e-5, 1.0, 1.5
DPCM_LOW, DPCM_HIGH = -2.0, 2.0

#: Parameter domains: name -> (least, greatest, step).
PARAMETERS = {"bits": (1.0, 8.0, 1.0), "delta_step": (0.001, 0.2, 0.001), "alpha": (0.5, 0.99, 0.01), "quantize_bits": (1.0, 8.0, 1.0)}
