"""Fixed values that results depend on. Kept together, as plain text, in natural order."""

# --- fixed values: defaults of the retrieval and answering behaviour -------------------
DEFAULT_SUMMARY_TYPE = "finding"       # evidence type when none is given
DEFAULT_PROMPT = ""
SEARCH_TOP_K = 3                       # plain search
ANSWER_TOP_K = 4                       # search feeding an answer
MIN_SIMILARITY = 0.6                   # hits below this never reach a context
MAX_HISTORY = 10                       # messages kept per conversation
FUZZY_THRESHOLD = 0.85                 # file-name similarity for near duplicates
PAGE_MIN_WORDS = 20                    # a page chunk needs MORE than this many words
ANSWER_MIN_WORDS = 10                  # an answer line needs MORE than this many words

# --- fixed values: source-file size gate (bytes) --------------------------------------
# Valid iff 0.001 MB <= size <= 100 MB with MB = 1024 * 1024 bytes.
MAX_FILE_BYTES = 100 * 1024 * 1024     # 104857600
MIN_FILE_BYTES = 1049                  # smallest integer size >= 0.001 MB (1048.576 bytes)

# --- fixed values: file names ----------------------------------------------------------
EXTRACTION_SUFFIX = "_gemini.jsonl"    # per-source extraction output suffix
SOURCE_GLOB = "*.pdf"
EXTRACTION_GLOB = "*_gemini.jsonl"
CODE_FENCE_OPEN = "```json"
CODE_FENCE_CLOSE = "```"

# --- fixed values: file-name cleaning stop words (in this order) -----------------------
NAME_STOP_WORDS = ["and", "or", "the", "in", "on", "at", "to", "for", "of", "with"]

# --- fixed values: evidence types and context sections ---------------------------------
EVIDENCE_TYPES = ["finding", "methodology", "relationship"]
# section title -> evidence type, in the order the sections are written
CONTEXT_SECTIONS = [("FINDINGS", "finding"), ("RELATIONSHIPS", "relationship"), ("METHODOLOGY", "methodology")]
CONTEXT_START = "[CONTEXT START]"
CONTEXT_END = "[CONTEXT END]"
RULE_WIDTH = 80
NO_CONTEXT_TEXT = "No specific sources available for this query."
NO_ANSWER_TEXT = "Based on the available sources, I cannot provide information about this topic. <STOP>"
STOP_MARK = " <STOP>"
PROMPT_QUERY_LABEL = "CURRENT QUERY: "
PROMPT_INFO_LABEL = "AVAILABLE INFORMATION:"
PROMPT_RESPONSE_LABEL = "RESPONSE: "
PANEL_TITLE = "📋 Metadata"

# --- fixed values: extractive (cited) answers --------------------------------------------
ANSWER_PREFIX = "Based on the available sources, "
FOLLOW_UP = "\nWould you like to know more about any specific aspect?"
QUESTION_WORDS = ["what", "how", "why"]
NO_CONTENT_APOLOGY = ("I apologize, but I couldn't find specific information about that in my sources. "
                      "Could you try rephrasing your question or ask about a related topic?")
NO_CONTEXT_APOLOGY = ("I apologize, but I don't have access to relevant sources to answer that question. "
                      "Please try asking about something covered in the available documents.")
SOURCE_LINE_PREFIX = "From "
SIMILARITY_MARK = "(similarity:"
NONE_CITATION = "(Source: None)"

# --- fixed values: enum vocabularies of the extraction schema ---------------------------
SCALES = ["local", "regional", "global"]
METHOD_TYPES = ["field", "remote_sensing", "model", "lab"]
FINDING_TYPES = ["observation", "measurement", "interpretation"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]
RELATIONSHIP_TYPES = ["causal", "correlation", "spatial"]
STRENGTHS = ["strong", "moderate", "weak"]

# --- fixed values: report text ------------------------------------------------------------
MISSING = "N/A"
REPORT_RULE = "=" * 100
