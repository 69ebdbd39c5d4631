"""The registered queries."""

from . import diagnostic_queries, phonetic_queries, sequence_queries, speech_queries, table_queries, text_queries  # noqa: F401
