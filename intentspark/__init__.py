"""intentspark: a Spark-native intent-classification data pipeline.

Ingest sentences, check their contract, split, build prompts and encoded
features, score through a pluggable generator, resolve generated text to
one of seven intents, fit and evaluate a count model, and report - as
DataFrame / SQL / Structured Streaming jobs.
"""

__version__ = "0.1.0"
