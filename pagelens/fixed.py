"""Fixed values.

Everything in this module must equal the behaviour being reproduced
(keyword lists, regular expressions, weights, thresholds, limits).  The
values are stated plainly and in their natural order; logic lives in the
operator modules.
"""

# ---------------------------------------------------------------------------
# URLs
# ---------------------------------------------------------------------------

# Format check, case-insensitive, anchored at both ends.  `\S` is spelled as
# an explicit class so Java regex and RE2 agree.
URL_FORMAT_RE = (
    r"(?i)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|"
    r"localhost|"
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
    r"(?::[0-9]+)?"
    r"(?:/?|[/?][^ \t\n\r\f\x0B]+)$"
)

# Blocked host patterns, searched anywhere in the network location,
# case-insensitive, reported in this order.
BLOCKED_HOST_PATTERNS = [
    r"localhost",
    r"127\.0\.0\.1",
    r"0\.0\.0\.0",
    r"192\.168\.",
    r"10\.",
    r"172\.(1[6-9]|2[0-9]|3[01])\.",
]

ALLOWED_SCHEMES = ["http", "https"]

# Characters left unescaped when a path is re-quoted (besides letters,
# digits and `_.-~`).
PATH_SAFE_CHARS = "/:@!$&'()*+,;="

# Site type by host substring, first match wins.
SITE_TYPES = [
    ("ecommerce", ["shop", "store", "buy", "cart"]),
    ("content", ["blog", "news", "article"]),
    ("api", ["api", "rest", "graphql"]),
]
SITE_TYPE_DEFAULT = "general"

# ---------------------------------------------------------------------------
# HTML cleaning
# ---------------------------------------------------------------------------

# Elements removed together with their content.
CLEAN_DROP_WITH_CONTENT = ["script", "style", "noscript"]
# Void elements removed.
CLEAN_DROP_VOID = ["meta", "link", "base"]
# Text under these keeps its whitespace.
WHITESPACE_KEEP_PARENTS = ["pre", "code", "textarea"]

# Void elements for the tree builder.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "meta", "param", "source", "track", "wbr",
]

# A start tag of one of these closes an open <p>.
CLOSES_P = [
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
]

# ---------------------------------------------------------------------------
# Page profile
# ---------------------------------------------------------------------------

ELEMENT_DISTRIBUTION_TOP = 15
CLASS_TOP = 10
REPEATED_CLASS_MIN = 3
REPEATED_CLASS_TOP = 5
PATTERN_TOP = 10

# Semantic class categories: category -> case-insensitive substring regex.
SEMANTIC_CLASSES = [
    ("product", "product|item|card|listing"),
    ("price", "price|cost|amount|money"),
    ("title", "title|heading|name|label"),
    ("content", "content|text|body|description"),
]

# Content patterns.  Character class of the price pattern (a class, so
# `s 5` and `.5` match too).  Word boundaries are ASCII.
PRICE_RE = r"[\$€£¥₹Rs\.][ \t\n\r\f\x0B]*[0-9]+[.,]?[0-9]*"
EMAIL_RE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL_RE = r"https?://[^ \t\n\r\f\x0B<>\"]+"
DATE_RE = r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b"
CONTENT_KINDS = ["prices", "emails", "urls", "dates"]

# Task pattern tags (structure analysis for a task).
TASK_PATTERN_WORDS = [
    ("price_pattern", ["price", "cost", "amount"]),
    ("title_pattern", ["title", "heading", "name"]),
    ("link_pattern", ["link", "url", "href"]),
]

# Dynamic-page markers.
DYNAMIC_MIN_HTML = 100
DYNAMIC_MIN_BODY_TEXT = 50
DYNAMIC_SCRIPT_RATIO = 3
DYNAMIC_FRAMEWORK_MARKERS = ["ng-app", "data-reactroot", "v-app", "__next_data__", "nuxt"]
DYNAMIC_CONTENT_TAGS = ["p", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6"]
DYNAMIC_MIN_CONTENT_ELEMENTS = 3
DYNAMIC_CONTENT_MIN_TEXT = 10
DYNAMIC_LOADING_MARKERS = [
    "loading", "please wait", "javascript is required", "enable javascript", "js-disabled",
]

# ---------------------------------------------------------------------------
# Execution
# ---------------------------------------------------------------------------

MAX_RESULTS_PER_STEP = 1000
ACTION_TEXT = "xpath_extract"
ACTION_ATTRIBUTE = "xpath_attribute"
ACTION_HTML = "xpath_html"
DEFAULT_ATTRIBUTE = "href"
MSG_NO_XPATH = "No XPath expression provided"
MSG_NO_DATA = "No data extracted"
MSG_BAD_XPATH = "XPath execution failed: Invalid expression"
MSG_TRUNCATED = "Results truncated to {n} items"

# ---------------------------------------------------------------------------
# Record structuring
# ---------------------------------------------------------------------------

CURRENCY_MARKS = ["Rs.", "$", "€", "£", "₹"]
BRANDS = ["New Balance", "Nike", "Adidas", "Puma", "Reebok"]
TITLE_BRANDS = ["New Balance", "Nike", "Adidas"]
PRODUCT_TERMS = ["shoe", "sneaker", "boot", "sandal", "trainer", "running", "walking"]
# class substring -> field, first match wins
CLASS_FIELDS = [
    ("title", ["title", "heading", "name", "product-name", "product-title"]),
    ("brand", ["author", "by", "writer", "brand"]),
    ("description", ["text", "content", "body", "description", "desc"]),
    ("price", ["price", "cost", "amount", "money"]),
    ("date", ["date", "time", "when"]),
    ("category", ["tag", "category", "label"]),
    ("rating", ["rating", "star", "review"]),
]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_TEXT_TAGS = ["p", "div", "span"]
NAV_TERMS = [
    "home", "about", "contact", "login", "register", "cart", "checkout",
    "menu", "search", "instagram", "facebook", "twitter", "youtube",
    "subscribe", "newsletter", "follow", "share", "like", "view all",
    "more", "less", "show", "hide", "toggle", "close", "open",
    "add to cart", "buy now", "quick view", "compare", "wishlist",
]
NAV_SHORT_ALLOWED = ["nike", "puma", "new", "balance"]
NAV_UPPER_ALLOWED = "NEW BALANCE"
CATEGORY_TERMS = ["perfumes", "shoes", "clothing", "accessories", "men", "women", "kids"]
# Sources by text: characters looked up, first elements of a text result; first
# values (longer than so many characters), their first elements; characters of a price.
LOOKUP_CHARS, LOOKUP_ELEMENTS = 30, 5
LOOKUP_VALUES, LOOKUP_MIN_LEN, LOOKUP_VALUE_ELEMENTS = 10, 3, 3
LOOKUP_PRICE_CHARS = 20
CONTAINER_MAX_LEVELS = 5
CONTAINER_SOURCE_LIMIT = 5
# class substrings, and the element name "article", in this order
CONTAINER_PRODUCT_CLASSES = ["product", "item", "card", "article", "listing"]
CONTAINER_PRODUCT_MARKS = ["Rs.", "$", "New Balance"]
CONTAINER_TOP = 10
PAIR_TITLE_MARK = "New Balance"
RELATED_MAX_DISTANCE = 5
# With fewer records than this share of the values, pairing is tried.
STRUCTURED_SHARE = 0.3

# ---------------------------------------------------------------------------
# Rule learning
# ---------------------------------------------------------------------------

MAX_ITERATIONS = 5
MIN_CONFIDENCE = 0.7
ACCEPT_BEST_MIN = 0.3
INITIAL_CONFIDENCE = 0.7

# Candidate routing, first match wins; branch name, words.  Branch 1 needs
# a word of each of its two lists.
ROUTE_NAME_PRICE = (["name", "title", "product"], ["price", "cost"])
ROUTES = [
    ("price", ["price", "cost", "amount", "money"]),
    ("quote", ["quote", "quotes", "author", "text"]),
    ("title", ["title", "heading", "name", "product"]),
    ("link", ["link", "url", "href"]),
    ("item", ["shoe", "shoes", "product", "item", "new balance"]),
]
ROUTE_GENERIC = "generic"
# What prompt routing reads of a page.
PROMPT_SAMPLE_CHARS = 2000
PROMPT_SAMPLE_TAGS = 10

MULTI_ITEM_WORDS = [
    "quote", "quotes", "items", "products", "articles", "posts", "comments",
    "reviews", "listings", "entries", "records", "results",
    "books", "movies", "songs", "videos", "images", "photos",
    "users", "profiles", "contacts", "messages", "emails",
    "prices", "titles", "names", "descriptions", "summaries",
    "links", "urls", "addresses", "locations", "dates",
    "tags", "categories", "labels", "keywords", "topics",
    "text", "content", "author", "writers",
]
PLURAL_PHRASES = [
    "all ", "list of", "extract all", "get all", "find all",
    "collect", "gather", "scrape all", "multiple", "several",
    "extract quote", "quote text", "author name",
]
PLURAL_EXCEPTIONS = ["this", "class", "css"]

TASK_PRICE_WORDS = ["price", "cost", "amount", "money"]
TASK_URL_WORDS = ["url", "link", "href"]
TASK_PRICE_RE = r"[\$€£¥]?[0-9]+[.,]?[0-9]*"
TASK_URL_RE = r"https?://[^ \t\n\r\f\x0B]+"

ISSUE_NO_DATA = "No data extracted"
ISSUE_SHORT = "Many results are very short"
ISSUE_WEAK = "Single element returned for task implying multiple items - needs refinement"

# Suggestions: (words, confidence, reasoning)
SUGGESTIONS = [
    ("price", ["price", "cost", "amount"], 0.7, "Targeting price-related elements"),
    ("title", ["title", "name", "heading"], 0.8, "Targeting heading and title elements"),
    ("product", ["product", "item"], 0.75, "Targeting product/item containers"),
]
ADVICE_SLOW_MS = 1000
ADVICE_MANY = 100
ADVICE_CONFIDENCE = 0.6
ADVICE_SLOW = "Consider adding more specific selectors to reduce search scope"
ADVICE_LIMIT = "Add position filters to limit results: [position() <= 20]"
ADVICE_BROADEN = "Try broadening the selector or checking for dynamic content"
DIAG_FAILED = ("Extraction failed", "Check if the target elements exist in the HTML")
DIAG_EMPTY = ("No data extracted", "Verify XPath expression matches target elements")
DIAG_SINGLE = ("Only single item extracted", "Check if XPath should target multiple similar elements")

# ---------------------------------------------------------------------------
# Cross-page validation
# ---------------------------------------------------------------------------

MIN_SUCCESS_THRESHOLD = 0.6
SUCCESS_WEIGHT = 0.4
CONSISTENCY_WEIGHT = 0.4
COVERAGE_WEIGHT = 0.3
QUALITY_WEIGHT = 0.3
SELECT_MIN_QUALITY = 0.3
MEANINGFUL_MIN_LEN = 3
MEANINGFUL_MAX_LEN = 200
UNIQUE_BONUS = 1.2
LENGTH_VAR_NORM = 10000.0
COUNT_VAR_NORM = 100.0
MEAN_LENGTH_VAR_NORM = 1000.0
COVERAGE_NORM = 10.0
MSG_SELECTED = ("Selected sequence '%s' based on highest robustness score (%.3f). Success rate: %.1f%%, "
                "Quality score: %.3f, Consistency: %.3f. Sequence succeeded on %d/%d pages.")
RELEVANCE_CURRENCY = ["$", "€", "£", "¥"]
RELEVANCE_PRICE_WORDS = ["price", "cost", "amount", "money"]
RELEVANCE_TITLE_WORDS = ["title", "heading", "name"]
RELEVANCE_LINK_WORDS = ["link", "url", "href"]

# ---------------------------------------------------------------------------
# Rule table
# ---------------------------------------------------------------------------

RULE_ID_PREFIX = "seq_"
RULE_ID_HEX = 12
FETCH_BY_DOMAIN_LIMIT = 10
FETCH_BY_TASK_LIMIT = 10
FETCH_BY_DOMAIN_TASK_LIMIT = 5
SCRAPE_RULE_LIMIT = 3
LIST_ALL_LIMIT = 50
LIST_ORDER_FIELDS = ["robustness_score", "created_at", "updated_at", "success_rate"]
STATS_TOP_DOMAINS = 5
MSG_NO_RULE_RESULTS = "No existing rules produced results"
MSG_NO_RULE = "Failed to generate extraction rule"

# Run log: a line for each scrape.
LOG_SUCCESS, LOG_FAILED = "SUCCESS", "FAILED"
LOG_LINE = "Scraping %s | URL: %s | Task: %s | Time: %.2fs"
LOG_ITEMS = " | Items: %d"
