"""Removal of private spans and of previously injected context from text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.text import strip

CONTEXT_TAG = "memory-context"


def _without_tag(text: Column, tag: str) -> Column:
    return F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")


def privacy_clean(text: Column, context_tag: str = CONTEXT_TAG) -> Column:
    return strip(_without_tag(_without_tag(text, "private"), context_tag))


def is_private(text: Column) -> Column:
    """True when nothing but white space is left outside private spans."""
    return strip(_without_tag(text, "private")) == ""
