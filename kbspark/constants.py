"""Fixed values that decide results. They must keep these values."""

# retrieval
K_BM25 = 5
K_EMB = 5
K_RERANK = 5
RRF_C = 60
BM25_K1 = 1.2
BM25_B = 0.75

# chunking
FILE_CHUNK_SIZE, FILE_CHUNK_OVERLAP = 2000, 200
FILE_SEPARATORS = ["\n\n", "\n", " ", ""]
L0_SIZE, L0_OVERLAP = 1200, 300
L1_SIZE, L1_OVERLAP = 700, 175
SPAN_SEPARATORS = ["\n\n", "\n", ". ", ", ", " "]
MD_MAX_CHARS = 1200
BATCH_TOKENS, BATCH_ITEMS, BATCH_DOCS = 240_000, 512, 50

# highlight spans
L0_POOL, L1_MIN_K, L1_FLOOR, VOTE_CAP = 5, 20, 0.05, 5
L0_TEXT_WEIGHT, L0_VECTOR_WEIGHT = 0.4, 0.6
PHRASE_BOOST = 1.5
SPAN_L0_WEIGHT, SPAN_AVG_WEIGHT, SPAN_VOTE_WEIGHT = 0.5, 0.3, 0.2

# analytics
TIMELINE_SHIFT_HOURS = 2

# misc
CONTEXT_TURNS = 5
UPLOAD_RETRIES = 3
CRAWL_MAX_PAGES = 1000

LANGUAGE_NAMES = {"cs": "Czech", "cs-CZ": "Czech", "en": "English", "en-US": "English"}
DEFAULT_LANGUAGE = "en-US"

SOURCE_MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html",
    "md": "text/markdown",
    "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
MIME_SOURCE = {mime: source for source, mime in SOURCE_MIME.items()}
