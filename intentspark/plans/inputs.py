"""Inputs of the registered queries, derived from the provided tables.

The provided tables are not intent data, so they are mapped:

* user turns   - ``conversations`` rows with role ``user`` are sentences,
                 ``Id = conv_id * 2^32 + turn`` (no turn reaches 2^32);
* generations  - every ``events`` row carries one of the 26 generation
                 fixture strings below (row ``event_id % 26``), standing in for
                 model output so that every resolver stage is reached;
* documents    - ``text`` is resolved as if it were generated text, and
                 ``lang`` is the label of the count model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.sources.tables import read_table

# Generation fixture (our own strings): what a model might emit, chosen so
# that each resolver stage and each category is reached at least once.
GENERATION_FIXTURE: tuple[str, ...] = (
    "PlayMusic",
    "playmusic",
    "  GetWeather\nSentence: x",
    "RateBook. Because",
    "Category BookRestaurant",
    "I think AddToPlaylist or PlayMusic",
    "SearchScreeningEvent",
    "",
    ".PlayMusic",
    "\n\nPlayMusic",
    "weather in rome",
    "book a table",
    "playlist please",
    "theatre near me",
    "schedule of cinema",
    "a novel",
    "show times",
    "xyz",
    "SearchCreativeWorkRateBook",
    "incorporate it",
    "include this",
    "PLAYMUSIC!",
    "\u3000\u00a0PlayMusic\u001f",
    "dinner. GetWeather",
    "Search Creative Work",
    "AddToPlaylist",
)
N_FIXTURE = len(GENERATION_FIXTURE)

# Turn ids are packed as conv_id * TURN_BASE + turn.
TURN_BASE = 1 << 32


def fixture_pick(key: F.Column) -> F.Column:
    """The fixture string for a row key (``key mod 26``)."""
    arr = F.array(*[F.lit(s) for s in GENERATION_FIXTURE])
    return F.element_at(arr, (F.pmod(key, F.lit(N_FIXTURE)) + 1).cast("int"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, generated)`` over the whole ``events`` table."""
    ev = read_table(spark, sf_dir, "events").select("event_id")
    return ev.withColumn("generated", fixture_pick(F.col("event_id")))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(Id, conv_id, turn, Sentence)`` for every user turn."""
    conv = read_table(spark, sf_dir, "conversations")
    return (conv.filter(F.col("role") == "user")
            .select((F.col("conv_id").cast("long") * F.lit(TURN_BASE) + F.col("turn")).alias("Id"),
                    "conv_id", "turn", F.col("text").alias("Sentence")))


def labelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a label: ``categories[conv_id % 7]``."""
    cats = F.array(*[F.lit(c) for c in domain.CATEGORIES])
    return user_turns(spark, sf_dir).withColumn(
        "Category",
        F.element_at(cats, (F.pmod(F.col("conv_id"), F.lit(len(domain.CATEGORIES))) + 1).cast("int")))


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table ``(ord, category, keyword)`` that grows with the data: every
    distinct word of four letters or more of the user turns, ``ord`` (and with
    it the category) being its length modulo 7."""
    words = F.regexp_extract_all(F.lower("Sentence"), F.lit("[a-zà-ÿ]{4,}"), F.lit(0))
    ord_ = (F.length("keyword") % len(domain.CATEGORIES)).cast("int")
    cats = F.array(*[F.lit(c) for c in domain.CATEGORIES])
    return (user_turns(spark, sf_dir).select(F.explode(words).alias("keyword")).distinct()
            .select(ord_.alias("ord"), F.element_at(cats, ord_ + 1).alias("category"), "keyword"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


class FixtureGenerator:
    """Stands in for a model: row ``key`` generates fixture string
    ``key mod 26``. With ``fail_on`` set, a batch holding a row whose
    ``key mod 26`` equals it raises (to exercise MOD-7)."""

    def __init__(self, key: str = "Id", fail_on: int | None = None):
        self.key, self.fail_on = key, fail_on

    def __call__(self, batch):
        keys = [int(k) for k in batch[self.key]]
        if self.fail_on is not None and any(k % N_FIXTURE == self.fail_on for k in keys):
            raise RuntimeError("generation failed")
        return [GENERATION_FIXTURE[k % N_FIXTURE] for k in keys]


class FixtureGeneratorFactory:
    """Picklable factory for :class:`FixtureGenerator`."""

    def __init__(self, key: str = "Id", fail_on: int | None = None):
        self.key, self.fail_on = key, fail_on

    def __call__(self):
        return FixtureGenerator(self.key, self.fail_on)


class PromptFixtureGenerator:
    """Stands in for a model that sees only the prompt: fixture string
    ``len(prompt) mod 26`` (deterministic, so distinct prompts can be
    generated once)."""

    def __call__(self, batch):
        return [GENERATION_FIXTURE[len(p) % N_FIXTURE] for p in batch["prompt"]]


class PromptFixtureGeneratorFactory:
    """Picklable factory for :class:`PromptFixtureGenerator`."""

    def __call__(self):
        return PromptFixtureGenerator()
