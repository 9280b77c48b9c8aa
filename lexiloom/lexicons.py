"""Fixed word lists, patterns and limits that define the results."""

# Fixed values.
FUNCTION_WORDS = (
    "the a an and or but if then of to in on at by for with about as into than that this these those "
    "i you he she it we they me him her us them my your his its our their is are was were be been being "
    "have has had do does did will would can could should may might must not no so very just please kindly"
).split()

# Fixed values.
URGENCY_WORDS = (
    "urgent immediately verify suspended account password click confirm update security alert expire expired "
    "limited action required now important warning unusual"
).split()

# Fixed values.
STOPWORDS = "the to and of a in you your is for we this that on with be have are if please or not will it as our by from".split()

# Plain substrings of the screen match text, "tap " with its blank.
ACCOUNT_TERMS = [
    "account", "password", "passcode", "credential", "login", "log in", "log-in", "sign in", "sign-in", "signed-in",
    "verif", "validat", "confirm your", "confirmation", "authentic", "security", "suspend", "deactivat", "expir",
    "locked", "unusual activity", "unauthorized", "unauthorised", "update your", "billing", "payment", "invoice",
    "mailbox", "webmail", "identity", "reset", "restricted", "limited access",
]
ACTION_TERMS = [
    "click", "tap ", "follow the link", "follow this link", "visit", "go to", "open the attachment", "use the link",
    "link below", "button below", "reply with", "reply to this", "respond with", "submit", "fill", "provide your",
    "enter your", "send us your", "log on", "download",
]
CTA_TERMS = [
    "verif", "update your", "update my", "confirm", "activat", "renew", "restore", "release", "retrieve", "recover",
    "resolve", "review", "unlock", "proceed", "log in", "login", "sign in", "keep the same", "cancel request",
    "validat", "continue", "view account", "repair", "authenticat", "reinput", "re-enter",
]
URL_HINT = r"https?://|www\.|hxxp"

# Soft hyphen, zero-width characters, byte order mark.
INVISIBLE = "­​‌‍﻿"
# Look-alike letters and the Latin letters they stand for.
LOOKALIKE_FROM = (
    "аеорсухіѕԁᴏАЕОРСУХ"
    "ΙΑΕΟΡΤΝΜΚΒ"
)
LOOKALIKE_TO = "aeopcyxisdoAEOPCYXIAEOPTNMKB"
#: Ranges that hold all of them, cheap to test: a text without any of these characters needs no folding.
FOLD_HINT = "[\\u00ad\\u0391-\\u0501\\u1d0f\\u200b-\\u200d\\ufeff]"

# Fixed values.
WORD = "[A-Za-z']+"
SENTENCE_END = "[.!?]+"
URL = r"(?i)https?://\S+|www\.\S+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
VOWELS = "[aeiouy]+"
PUNCTUATION = ",.;:!?'\"-()"

# Fixed values.
MIN_CHARS, MAX_CHARS = 150, 8000
MIN_WORDS, STOPWORD_SHARE = 20, 0.12
SEED = 42
TEST_SHARE = VAL_SHARE = 0.15
SHINGLE, JACCARD = 5, 0.5
AUDIT_PER_STRATUM, SNIPPET = 25, 420
N_BOOT, ALPHA = 2000, 0.05
