"""Prompt templates for imagined documents, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts; {q} is replaced by the query.
TEMPLATES = {
    "sentence": (
        "In ONE sentence, describe the skill an agent would need to solve the task "
        "below: give the skill a short name, then state what it does. "
        "Output only that sentence.\n\nTask: {q}"
    ),
    "passage": (
        "Write a short passage that solves or answers the task below. "
        "Factual precision is not required.\n\nTask: {q}"
    ),
    "skill": (
        "You are writing a SKILL.md that an agent would use to solve the task below. "
        "Output: (1) frontmatter with `name` and a one-line `description`; "
        "(2) numbered procedure steps; (3) a minimal code skeleton in a fenced block. "
        "Be concise, at most 300 tokens. Factual precision is not required — capture "
        "what the right skill would look like.\n\nTask: {q}"
    ),
}
TAG_PREFIX_CHARS = 20


def template_rows(templates: dict[str, str] | None = None) -> Column:
    """ARRAY<STRUCT<template, template_text>> to explode next to a query."""
    items = (templates or TEMPLATES).items()
    return F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("template_text"))
                     for n, t in items])


def render(template_text: Column, query: Column) -> Column:
    return F.replace(template_text, F.lit("{q}"), query)


def model_tag(model: Column, template_text: Column) -> Column:
    return F.concat(model, F.lit("|"), F.substring(template_text, 1, TAG_PREFIX_CHARS))
