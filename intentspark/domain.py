"""Dimension data of the intent pipeline and DataFrame builders for it.

Everything under "FIXED VALUES" must equal the behaviour being matched
(label order, keyword rules, prompt text, special tokens); it is data, not
logic, and is kept together, in its natural order, in this one module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from intentspark.session import local_table

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the behaviour being reproduced)
# ---------------------------------------------------------------------------

# The seven intents. Order matters: every resolver stage takes the first hit
# in this order.
CATEGORIES: tuple[str, ...] = (
    "PlayMusic",
    "RateBook",
    "SearchCreativeWork",
    "GetWeather",
    "BookRestaurant",
    "AddToPlaylist",
    "SearchScreeningEvent",
)

# Label used when no resolver stage decides (batch path).
DEFAULT_CATEGORY = "SearchCreativeWork"

# Label used when the request path finds no category name.
API_FALLBACK = "Unknown"

# Keyword rules of the batch resolver, in category order; a category wins when
# any of its keywords is contained in the cleaned, lower-cased generation.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "PlayMusic": ("play", "music", "song", "album", "track", "hear", "listen",
                  "on deezer", "on spotify", "on pandora", "on groove shark",
                  "on last fm", "by artist", "singing", "playing"),
    "RateBook": ("rate", "rating", "stars", "out of", "points", "give", "star",
                 "book", "novel", "textbook", "essay", "series", "chronicle"),
    "SearchCreativeWork": ("find", "search", "show", "locate", "see", "watch",
                           "game", "painting", "photograph", "novel",
                           "tv series", "trailer", "discography", "movie",
                           "film", "picture", "journal"),
    "GetWeather": ("weather", "forecast", "temperature", "humid", "cloudy",
                   "sunny", "rainy", "snowy", "freezing", "warm", "cold",
                   "chillier", "hotter", "degrees", "humidity", "snowfall",
                   "windy"),
    "BookRestaurant": ("book", "reservation", "table", "spot", "restaurant",
                       "cafe", "bar", "gastropub", "reserve", "seating",
                       "dinner", "lunch", "breakfast", "eat", "food",
                       "cuisine"),
    "AddToPlaylist": ("add", "to my playlist", "include", "put", "incorporate",
                      "playlist", "mix", "collection", "tracks", "songs"),
    "SearchScreeningEvent": ("movie", "theatre", "theater", "showing",
                             "showtimes", "schedule", "time", "playing",
                             "films", "cinema", "animated", "screening",
                             "matinee", "showtime"),
}

# Instruction prompt; the label list and the sentence are substituted verbatim.
PROMPT_TEMPLATE = (
    "<|user|>\n"
    "Classify the following sentence into exactly one of these categories: "
    "{categories}. "
    "You must respond with only the category name, nothing else.\n\n"
    "Sentence: {sentence}\n\n"
    "Category: "
)

# Text that a missing sentence is formatted as.
NULL_SENTENCE = "None"

# Special tokens: (token, id, special, rstrip). Tokens flagged special are
# dropped from generated text; "</s>" is not flagged and stays.
SPECIAL_TOKENS: tuple[tuple[str, int, bool, bool], ...] = (
    ("<unk>", 0, True, False),
    ("<s>", 1, True, False),
    ("</s>", 2, False, True),
    ("<|endoftext|>", 32000, True, False),
    ("<|assistant|>", 32001, True, True),
    ("<|placeholder1|>", 32002, True, True),
    ("<|placeholder2|>", 32003, True, True),
    ("<|placeholder3|>", 32004, True, True),
    ("<|placeholder4|>", 32005, True, True),
    ("<|system|>", 32006, True, True),
    ("<|end|>", 32007, True, True),
    ("<|placeholder5|>", 32008, True, True),
    ("<|placeholder6|>", 32009, True, True),
    ("<|user|>", 32010, True, True),
)
UNK_TOKEN = "<unk>"
PAD_TOKEN = "<|endoftext|>"   # padding re-uses the end-of-text token
EOS_TOKEN = "<|endoftext|>"
PADDING_SIDE = "left"

# Chat rendering: each known role is "<|role|>\n" + content + "<|end|>\n";
# the tail is the assistant header (generation) or the end-of-text token.
CHAT_ROLES: tuple[str, ...] = ("system", "user", "assistant")
CHAT_TURN_END = "<|end|>\n"
CHAT_GENERATION_TAIL = "<|assistant|>\n"

# Shape of encoded examples and of scoring.
MAX_LENGTH = 256
IGNORE_INDEX = -100
MAX_NEW_TOKENS = 15

# Train/validation split.
SPLIT_TEST_FRACTION = 0.1
SPLIT_SEED = 42

# Cell values pandas' CSV reader turns into missing values by default.
PANDAS_NA_STRINGS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Column types of the intents table; types with limits are an option of the writers.
INTENTS_TABLE_DDL = "Id BIGINT, Sentence STRING, Category STRING"

# ---------------------------------------------------------------------------
# Derived values
# ---------------------------------------------------------------------------

CATEGORIES_STRING = ", ".join(CATEGORIES)
PROMPT_PREFIX, PROMPT_SUFFIX = PROMPT_TEMPLATE.replace(
    "{categories}", CATEGORIES_STRING).split("{sentence}")

SPECIAL_TOKEN_IDS = {tok: tid for tok, tid, _, _ in SPECIAL_TOKENS}
PAD_ID = SPECIAL_TOKEN_IDS[PAD_TOKEN]
UNK_ID = SPECIAL_TOKEN_IDS[UNK_TOKEN]
# Word ids are assigned after the highest reserved id.
FIRST_WORD_ID = max(SPECIAL_TOKEN_IDS.values()) + 1

KEYWORD_RULES: tuple[tuple[int, str, str], ...] = tuple(
    (CATEGORIES.index(cat), cat, kw) for cat, kws in KEYWORDS.items() for kw in kws
)


# ---------------------------------------------------------------------------
# Dimension tables
# ---------------------------------------------------------------------------

LABEL_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
])
RULE_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
])
SPECIAL_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("id", T.IntegerType(), False),
    T.StructField("special", T.BooleanType(), False),
    T.StructField("rstrip", T.BooleanType(), False),
])


def label_table(spark: SparkSession) -> DataFrame:
    """The ordered label domain ``(ord, category)``."""
    return local_table(spark, enumerate(CATEGORIES), LABEL_SCHEMA)


def keyword_table(spark: SparkSession) -> DataFrame:
    """Keyword rules ``(ord, category, keyword)``; ``ord`` is the category order."""
    return local_table(spark, KEYWORD_RULES, RULE_SCHEMA)


def special_token_table(spark: SparkSession) -> DataFrame:
    """Reserved tokens ``(token, id, special, rstrip)``."""
    return local_table(spark, SPECIAL_TOKENS, SPECIAL_SCHEMA)
