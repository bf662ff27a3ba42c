"""Fixed values that must equal the behaviour we reproduce.

Everything in this module is data, stated plainly and in natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: rule-classifier phrase lists (matched as lower-case substrings)
# ---------------------------------------------------------------------------
URGENT_PHRASES = (
    "urgent",
    "immediately",
    "verify your account",
    "password expiry",
    "final notice",
    "suspend",
    "limited time",
    "unauthorized",
    "confirm your identity",
)
CREDENTIAL_PHRASES = ("update your password", "login now", "re-enter your details")
MARKETING_PHRASES = ("free trial", "special offer", "unsubscribe", "act now", "win a")

# FIXED VALUES: rule-classifier weights, decision cut-offs and reason texts
RULE_WEIGHTS = {"urgent": 0.35, "ip_url": 0.35, "punycode": 0.2, "credential": 0.25}
PHISHING_CUTOFF = 0.6
MARKETING_REASON_BELOW = 0.5
PHISHING_CONF_CAP = 0.99
SPAM_CONFIDENCE = 0.6
SAFE_CONFIDENCE_CLEAN = 0.7
SAFE_CONFIDENCE_SIGNALS = 0.5
REASON_TEXT = {
    "urgent": "urgent language",
    "ip_url": "url uses raw ip",
    "punycode": "punycode url",
    "credential": "credential lure",
    "marketing": "marketing language",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: label vocabulary
# ---------------------------------------------------------------------------
CLASSES = ("phishing", "safe", "spam")  # alphabetical = label-encoder order
LABEL_ALIASES = {
    "ham": "safe",
    "ok": "safe",
    "legit": "safe",
    "safe": "safe",
    "spam": "spam",
    "phish": "phishing",
    "phishing": "phishing",
    "fraud": "phishing",
}
BINARY_MAP = {"safe": "safe", "spam": "not_safe", "phishing": "not_safe"}

# FIXED VALUES: corpus folder -> label
FOLDER_LABELS = {
    "easy_ham": "safe",
    "easy_ham_2": "safe",
    "hard_ham": "safe",
    "spam": "spam",
    "spam_2": "spam",
}
ARCHIVE_SUFFIXES = ("tar", "gz", "bz2", "xz", "zip", "7z")
DEFAULT_MAX_BYTES = 2_000_000

# FIXED VALUES: explanation / display sizes
TOP_K_REASONS = 6
REASON_STRING_TOKENS = 8
PREVIEW_CHARS = 500
EXPORT_COLUMNS = ("id", "created_at", "subject", "sender", "label", "confidence", "reasons")
EXCEL_RISKY_PREFIXES = ("=", "+", "-", "@")


# ---------------------------------------------------------------------------
# FIXED VALUES: English stop-word list of the word analyzer (318 words)
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = (
    "a", "about", "above", "across", "after", "afterwards", "again", "against",
    "all", "almost", "alone", "along", "already", "also", "although", "always",
    "am", "among", "amongst", "amoungst", "amount", "an", "and", "another",
    "any", "anyhow", "anyone", "anything", "anyway", "anywhere", "are",
    "around", "as", "at", "back", "be", "became", "because", "become",
    "becomes", "becoming", "been", "before", "beforehand", "behind", "being",
    "below", "beside", "besides", "between", "beyond", "bill", "both",
    "bottom", "but", "by", "call", "can", "cannot", "cant", "co", "con",
    "could", "couldnt", "cry", "de", "describe", "detail", "do", "done",
    "down", "due", "during", "each", "eg", "eight", "either", "eleven", "else",
    "elsewhere", "empty", "enough", "etc", "even", "ever", "every", "everyone",
    "everything", "everywhere", "except", "few", "fifteen", "fifty", "fill",
    "find", "fire", "first", "five", "for", "former", "formerly", "forty",
    "found", "four", "from", "front", "full", "further", "get", "give", "go",
    "had", "has", "hasnt", "have", "he", "hence", "her", "here", "hereafter",
    "hereby", "herein", "hereupon", "hers", "herself", "him", "himself", "his",
    "how", "however", "hundred", "i", "ie", "if", "in", "inc", "indeed",
    "interest", "into", "is", "it", "its", "itself", "keep", "last", "latter",
    "latterly", "least", "less", "ltd", "made", "many", "may", "me",
    "meanwhile", "might", "mill", "mine", "more", "moreover", "most", "mostly",
    "move", "much", "must", "my", "myself", "name", "namely", "neither",
    "never", "nevertheless", "next", "nine", "no", "nobody", "none", "noone",
    "nor", "not", "nothing", "now", "nowhere", "of", "off", "often", "on",
    "once", "one", "only", "onto", "or", "other", "others", "otherwise", "our",
    "ours", "ourselves", "out", "over", "own", "part", "per", "perhaps",
    "please", "put", "rather", "re", "same", "see", "seem", "seemed",
    "seeming", "seems", "serious", "several", "she", "should", "show", "side",
    "since", "sincere", "six", "sixty", "so", "some", "somehow", "someone",
    "something", "sometime", "sometimes", "somewhere", "still", "such",
    "system", "take", "ten", "than", "that", "the", "their", "them",
    "themselves", "then", "thence", "there", "thereafter", "thereby",
    "therefore", "therein", "thereupon", "these", "they", "thick", "thin",
    "third", "this", "those", "though", "three", "through", "throughout",
    "thru", "thus", "to", "together", "too", "top", "toward", "towards",
    "twelve", "twenty", "two", "un", "under", "until", "up", "upon", "us",
    "very", "via", "was", "we", "well", "were", "what", "whatever", "when",
    "whence", "whenever", "where", "whereafter", "whereas", "whereby",
    "wherein", "whereupon", "wherever", "whether", "which", "while", "whither",
    "who", "whoever", "whole", "whom", "whose", "why", "will", "with",
    "within", "without", "would", "yet", "you", "your", "yours", "yourself",
    "yourselves",
)

# FIXED VALUES: TF-IDF defaults of the trainer
MAX_FEATURES_WORD = 20000
MAX_FEATURES_CHAR = 10000
CHAR_NGRAM_RANGE = (3, 5)
WORD_NGRAM_RANGE = (1, 2)
VAL_SIZE = 0.2
SPLIT_SEED = 42
PRECISION_TARGET = 0.90
