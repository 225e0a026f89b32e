"""Lectern: Spark jobs that turn corpora of timed speech and slide text into readable books."""
