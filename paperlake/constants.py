"""Fixed values. Results depend on them exactly, so they are stated as plain text."""

# --- fixed values: similarity ------------------------------------------------
STOPWORDS = (
    "a an and are as at be but by for from has have in is it its of on or "
    "that the this to was were will with we they not can do"
).split()
TOKEN_PATTERN = "[a-z0-9]+"
MIN_TOKEN_LENGTH = 2
SCORE_DECIMALS = 4
RELATED_TOP_K = 5

# --- fixed values: library ---------------------------------------------------
STATUSES = ("to-read", "reading", "done")
DEFAULT_STATUS = "to-read"
NOTE_MIN_LENGTH = 1
NOTE_MAX_LENGTH = 500
TOP_CATEGORIES = 5
SUGGESTIONS = 25
PAPERS_PER_PAGE = 5
COLLECTIONS_PER_PAGE = 10
COLLECTION_VIEW_ROWS = 15

# --- fixed values: search ----------------------------------------------------
SEARCH_MAX_RESULTS = 25
SEARCH_DEFAULT_RESULTS = 5
SORT_BY = ("relevance", "submittedDate", "lastUpdatedDate")
SORT_ORDER = ("descending", "ascending")
LISTING_TEXT_BUDGET = 5900

# --- fixed values: texts and formats -----------------------------------------
NO_ABSTRACT = "No abstract available."
UNKNOWN = "Unknown"
NO_CATEGORY = "N/A"
PAGE_LABEL = "\U0001F4C4 arXiv"
PDF_LABEL = "\U0001F4E5 PDF"
LINK_GAP = "  •  "
QUICK_SUMMARY_LIMIT = 500
INLINE_LIMIT = 2000
CITATION_FORMATS = ("bibtex", "plain", "markdown")
FENCE_TAGS = {"bibtex": "bibtex", "plain": "", "markdown": "md"}
FILE_EXTENSIONS = {"bibtex": "bib", "plain": "txt", "markdown": "md"}

# --- fixed values: keys ------------------------------------------------------
TENANT = ["user_id", "guild_id"]
PAPER_KEY = ["user_id", "guild_id", "paper_id"]
COLLECTION_KEY = ["user_id", "guild_id", "name"]
MEMBERSHIP_KEY = ["collection_id", "paper_id"]
