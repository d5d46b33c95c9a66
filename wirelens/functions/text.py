"""String expressions used by alert triage and alert analytics."""

from pyspark.sql import Column, functions as F

from wirelens import constants as K

# fixed values: the two verdict lines a classifier model writes (flags: Unix lines, Unicode classes)
SEVERITY_LINE = r"(?imdU)^\s*SEVERITY\s*:\s*(.+?)(?:\n|$|\|)"
ACTION_LINE = r"(?imdU)^\s*ACTION\s*:\s*(.+?)(?:\n|$|\|)"


def normalize_ws(x: Column) -> Column:
    """Runs of (Unicode) whitespace become one space, ends are cut, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def matching_text(x: Column) -> Column:
    """Form in which logs and keywords are compared."""
    return F.lower(normalize_ws(x))


def vocabulary_word(x: Column, words: list[str]) -> Column:
    """First word of the vocabulary that the text contains, in vocabulary order; else null."""
    lowered = F.lower(x)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words])


def normalize_severity(x: Column) -> Column:
    return vocabulary_word(x, K.SEVERITIES)


def normalize_action(x: Column) -> Column:
    return vocabulary_word(x, K.ACTIONS)


def contains_any(x: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(x, F.lit(needle))
    return hit


def or_default(x: Column, default: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(default))
