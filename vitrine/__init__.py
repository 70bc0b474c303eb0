"""Vitrine: a Spark-first engine for building, cleaning and querying a catalogue of venues."""
