"""Fixed values. They decide results, so they are stated as plain text."""

# Words too common in catalog descriptions to carry meaning.
CATALOG_STOPWORDS = (
    "app", "apps", "apple", "best", "com", "download", "facebook", "free", "fun", "game",
    "games", "gaming", "google", "http", "https", "iphone", "ipad", "mobile", "new", "online",
    "play", "player", "players", "playing", "privacy", "support", "terms", "today", "website",
    "www",
)

# Words too common in reviews to carry meaning.
REVIEW_STOPWORDS = (
    "app", "apps", "game", "games", "gaming", "play", "played", "playing", "player", "players",
    "iphone", "ipad", "apple", "phone", "really", "just", "like", "love", "good", "great", "bad",
    "thing", "things", "time", "times", "want", "wanted", "make", "makes", "making", "got", "get",
    "gets", "getting",
)

# Keywords too generic to name a segment.
GENERIC_KEYWORDS = (
    "action", "adventure", "app", "best", "casual", "experience", "features", "friends", "game",
    "games", "great", "items", "make", "mode", "new", "play", "players", "playing", "story",
    "use", "world",
)

# English function words, the default of the `stopwords` parameter of TF-IDF.
ENGLISH_STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "cannot", "could", "did", "do", "does", "doing", "down", "during", "each",
    "else", "ever", "every", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "hence", "her", "here", "hers", "herself", "him", "himself", "his", "how", "however",
    "i", "if", "in", "into", "is", "it", "its", "itself", "may", "me", "might", "more", "most",
    "much", "must", "my", "myself", "never", "no", "nor", "not", "now", "of", "off", "often",
    "on", "once", "only", "or", "other", "others", "our", "ours", "ourselves", "out", "over",
    "own", "per", "rather", "same", "she", "should", "since", "so", "some", "still", "such",
    "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "thus", "to", "too", "under", "until", "up", "upon", "us",
    "very", "was", "we", "well", "were", "what", "when", "where", "whether", "which", "while",
    "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you",
    "your", "yours", "yourself", "yourselves",
)

# Theme -> words that vote for it.
THEMES = {
    "Merge": ("merge", "combine", "merging"),
    "Decoration": ("decorate", "decoration", "renovate", "renovation", "design", "mansion", "home"),
    "Block Puzzle": ("block", "blocks"),
    "Sorting": ("sort", "sorting", "color", "colors"),
    "Word": ("word", "words", "crossword", "clue", "spelling"),
    "Brain Puzzle": ("brain", "logic", "trivia"),
    "Match": ("match", "matching", "match3", "match-3"),
    "RPG": ("rpg", "roleplaying", "role-playing", "hero", "heroes", "quest"),
    "Combat": ("combat", "battle", "boss", "fight", "fighting"),
    "Fantasy": ("fantasy", "magic", "dragon", "kingdom"),
    "Strategy": ("strategy", "strategic", "tactical", "tactics"),
    "Management": ("management", "manager", "tycoon", "business"),
    "Simulation": ("simulation", "simulator", "simulate", "life"),
    "Idle": ("idle", "incremental"),
    "Casino": ("casino", "slots", "slot", "poker", "blackjack", "cash"),
    "Sports": ("sport", "sports", "football", "soccer", "basketball", "baseball", "golf"),
    "Racing": ("race", "racing", "car", "cars", "driving"),
    "Cooking": ("cook", "cooking", "restaurant", "chef", "food"),
    "Adventure": ("adventure", "explore", "exploration", "journey"),
    "Survival": ("survival", "survive", "zombie", "zombies"),
}

# Themes that together decide a name, first match wins.
THEME_NAMES = (
    (("Casino",), "Casino & Real-Money Games"),
    (("Merge", "Decoration"), "Merge & Decoration Games"),
    (("Block Puzzle", "Sorting"), "Block & Sorting Puzzle"),
    (("Word", "Brain Puzzle"), "Word & Brain Games"),
    (("RPG", "Combat", "Fantasy"), "Fantasy RPG & Combat"),
    (("RPG", "Idle"), "Idle RPG & Progression"),
    (("Strategy", "Management"), "Strategy & Management"),
    (("Simulation", "Management"), "Simulation & Management"),
    (("Sports", "Management"), "Sports Management Games"),
)

# Franchise label, substrings of the whole text, substrings of the developer.
FRANCHISES = (
    ("Five Nights at Freddy's Franchise", ("freddy", "fazbear", "five nights"), ()),
    ("Papa's Cooking & Time Management", ("papa's", "papas"), ("flipline",)),
)

# Score components with their weights (sum 100).
SCORE_WEIGHTS = {
    "market_strength": 25,
    "player_validation": 20,
    "competition_gap": 15,
    "developer_diversity": 15,
    "semantic_coherence": 15,
    "confidence": 10,
}

# Names of segment types.
FRANCHISE_TYPE = "Franchise cluster"
MIXED_TYPE = "Mixed / low-confidence cluster"
ESTABLISHED_TYPE = "Established competitive segment"
CANDIDATE_TYPE = "Opportunity candidate"

# Signal clauses with the component and its threshold.
SIGNALS = (
    ("market_strength_score", 17, "strong current chart visibility"),
    ("player_validation_score", 14, "strong player validation"),
    ("competition_gap_score", 9, "relatively limited representation"),
    ("developer_diversity_score", 10, "diverse developer landscape"),
    ("semantic_coherence_score", 10, "coherent game segment"),
)
NO_SIGNAL = "Mixed market signals; further validation recommended."

# Warning clauses.
CONCENTRATION_WARNING = "High developer/franchise concentration"
COHERENCE_WARNING = "Low semantic coherence"
SIZE_WARNING = "Very small cluster"

# Patterns of the text cleaners.
URL = r"(?:https?://|www\.)[^\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
HTML_TAG = r"<[^>]+>"
NON_LETTER = r"[^a-zA-Z\s-]"
NON_LETTER_KEEP_APOSTROPHE = r"[^a-zA-Z\s'-]"

# Token patterns of the TF-IDF profiles.
WORD_TOKEN = r"\b[a-zA-Z][a-zA-Z-]{2,}\b"
REVIEW_TOKEN = r"\b[a-zA-Z][a-zA-Z'-]{2,}\b"
DEFAULT_TOKEN = r"\b\w\w+\b"
