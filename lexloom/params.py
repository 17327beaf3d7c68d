"""Job parameters and the fixed values that results depend on."""

from __future__ import annotations

# Site, seed and object layout.
SITE_HOST = "www.revisor.mn.gov"
SITE_PATH = "/statutes"
SEED_URL = "https://www.revisor.mn.gov/statutes/"
RAW_PREFIX = "raw"
CHUNK_PREFIX = "chunk"

# Page wording.
TOC_HEADING = "Table of Chapters"
SHORT_TOC_HEADING_PREFIX = "Table of Chapters, "
SUBDIVISION_PREFIXES = ("Subdivision ", "Subd. ", "Subd ")
REPEALED_MARK = "[Repealed"

# Page kinds.
KIND_ERROR = -1
KIND_CHAPTERS = 1
KIND_SHORT_CHAPTERS = 2
KIND_SECTIONS = 3
KIND_STATUTE = 4
KIND_NAMES = {
    KIND_ERROR: "error",
    KIND_CHAPTERS: "chapters_table",
    KIND_SHORT_CHAPTERS: "chapters_short_table",
    KIND_SECTIONS: "sections_table",
    KIND_STATUTE: "statute",
}

# Search and vectors.
TOP_K = 10
VECTOR_DIM = 1024
GRAPH_M = 16
GRAPH_EF_CONSTRUCTION = 200
GRAPH_EF_SEARCH = 100

# Prompt layout and model request.
SYSTEM_TEXT = (
    "You are an expert on Minnesota statutes. Answer the Human's question with references to the statutes. "
    "When a subdivision references another subdivision, include the text of the referenced subdivision as well. "
    "Reference the statute using standard notation (e.g., § 337.10, subd. 1). "
    "At the end of the message, provide the entire relevant subdivision. "
    "Be careful to accurately cite the statute without merging the subdivision number into the statute number. "
    "Note that some statutes do not have a subdivision and are labeled simply as chapter.section (e.g., § 86B.33). "
    "Verify each citation to ensure it is correct and clearly distinguishes between the statute number "
    "and the subdivision number.\n"
)
SYSTEM_OPEN = "\n\nSystem: "
HUMAN_OPEN = "\n\nHuman: "
ASSISTANT_OPEN = "\n\nAssistant:\n"
MODEL_MAX_TOKENS = 300
MODEL_TEMPERATURE = 0.5
MODEL_TOP_K = 250
MODEL_TOP_P = 1
MODEL_STOP = "\n\nHuman:"
MODEL_API_VERSION = "bedrock-2023-05-31"

# Queue and retention settings.
PAGE_RETENTION_DAYS = 20
DEAD_LETTER_RETENTION_DAYS = 14
MESSAGE_RETENTION_DAYS = 7
MESSAGE_MAX_BYTES = 10 * 1024
MAX_RECEIVES = 2
HIDDEN_MS = 3 * 60 * 1000
MAX_CRAWL_WORKERS = 6
SCALE_IN_UPPER = 0.99
SCALE_OUT_LOWER = 1.0

# Object-created events.
EVENT_SOURCE = "aws.s3"
EVENT_DETAIL_TYPE = "Object Created"
