"""Queries of the engine's own operators: importing this registers them all."""

from ridgeline.plans import corpora, decisions, features, flagship, models, spans, text  # noqa: F401
