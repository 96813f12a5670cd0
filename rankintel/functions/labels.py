"""Label vocabulary and the default rule set of the batch classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label vocabulary.
METAL_TYPES = ("solid_gold", "vermeil", "gold_plated", "gold_filled", "sterling_silver", "unknown")
KARATS = ("9k", "10k", "14k", "18k", "24k", "unknown")
BASE_METALS = ("sterling_silver", "brass", "copper", "gold", "unknown")
AVAILABILITIES = ("in_stock", "out_of_stock", "unknown")
CONFIDENCES = ("high", "medium", "low")

Rule = tuple[str, str]

# Ordered (label, pattern) rules; the first pattern found in the text decides.
METAL_RULES: tuple[Rule, ...] = (
    ("gold_filled", r"(?i)\bgold[\s-]*filled\b"),
    ("vermeil", r"(?i)\bvermeil\b"),
    ("gold_plated", r"(?i)\bgold[\s-]*plated?\b|\bgold[\s-]*plating\b|\belectroplat"),
    ("solid_gold", r"(?i)\bsolid\s+(?:(?:9|10|14|18|24)\s*k(?:t|arat)?\s+)?(?:yellow\s+|white\s+|rose\s+)?gold\b"
                   r"|\b(?:9|10|14|18|24)\s*k(?:t|arat)?\s+solid\b"),
    ("sterling_silver", r"(?i)\bsterling\s+silver\b|\b925\s+silver\b"),
)
KARAT_RULES: tuple[Rule, ...] = tuple(
    (k, rf"(?i)\b{k[:-1]}\s*-?\s*k(?:t|arat)?\b") for k in KARATS if k != "unknown"
)
BASE_METAL_RULES: tuple[Rule, ...] = (
    ("sterling_silver", r"(?i)\bsterling\s+silver\b|\b925\b"),
    ("brass", r"(?i)\bbrass\b"),
    ("copper", r"(?i)\bcopper\b"),
    ("gold", r"(?i)\bgold\b"),
)
AVAILABILITY_RULES: tuple[Rule, ...] = (
    ("out_of_stock", r"(?i)out[\s_-]*of[\s_-]*stock|sold out"),
    ("in_stock", r"(?i)in[\s_-]*stock|add to (?:cart|bag|basket)"),
)

# Fixed value: how a dollar price is written in visible text.
DOLLAR_PRICE = r"\$\s*(\d+(?:\.\d{2})?)"


def first_rule(text: Column, rules: tuple[Rule, ...] | list[Rule], default: str = "unknown") -> Column:
    """Label of the first rule whose pattern occurs in the text."""
    chain = None
    for label, pattern in rules:
        found = text.rlike(pattern)
        chain = F.when(found, F.lit(label)) if chain is None else chain.when(found, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def rule_quote(text: Column, rules: tuple[Rule, ...] | list[Rule], width: int = 100) -> Column:
    """The words that made the first matching rule fire, '' when none did."""
    quotes = [F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")) for _, pattern in rules]
    return F.substring(F.coalesce(*quotes, F.lit("")), 1, width)
