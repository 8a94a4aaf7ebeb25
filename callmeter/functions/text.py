"""Text expressions over prompts: words, features, families. Everything stays in the JVM.

Patterns carry (?U) because word characters and boundaries are Unicode here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: patterns that tell a family from a lower-case prompt, tried in this order
FAMILY_PATTERNS = {
    "review": r"\b(review|relis|relecture|relire|audit|vérifie|verifie|check the code|code review)\w*",
    "refactor": r"\b(refactor|refonte|réécri|reecri|rewrite|rename|renomme|migrate|migre|implement|implémente|ajoute|add|fix|corrige)\w*",
    "measure": r"\b(measure|mesure|bench\w*|profil\w*|how (fast|slow|many)|combien|count|compte|perf)\b",
}
# fixed values: prompts that only carry the previous task on
FOLLOWUPS = (
    "continue", "continues", "vas-y", "vas y", "go", "ok", "okay", "oui", "yes", "y", "d'accord", "daccord", "parfait",
    "merci", "thanks", "next", "suite", "la suite", "et ensuite", "on continue", "continue please", "please continue",
    "keep going", "do it", "fais-le", "fais le", "go ahead", "proceed", "lance",
)
# fixed values: patterns that read a prompt's shape
ERROR_PATTERN = (r"Traceback \(most recent call last\)|\b\w*(Error|Exception)\b:|\bFAILED\b|panicked at|^\s+at .+:\d+|error\[E\d+\]|npm ERR!|"
                 r"fatal:")
ITEM_PATTERN = r"^\s*(?:[-*•]|\d+[.)])\s+\S"
PATH_PATTERN = r"(?:^|\s)@?[\w./-]+\.[A-Za-z0-9]{1,6}\b"
COMMAND_PATTERN = r"<command-name>/?([\w:.-]+)</command-name>"
WORD_PATTERN = r"[\p{L}\p{Nl}\p{No}]{3,}"


def words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)))


def normalized(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the end."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.regexp_replace(flat, r"(?U)[\s.!?,;:…]+$", "")


def load_followups(lines: list[str]) -> list[str]:
    """Phrases from the lines of a list: blanks and # comments skipped, the rest normalized like prompts."""
    kept = [ln.strip() for ln in lines]
    return [" ".join(ln.lower().split()).rstrip(" .!?,;:…") for ln in kept if ln and not ln.startswith("#")]


def is_followup(text: Column, phrases=FOLLOWUPS) -> Column:
    return normalized(text).isin(*phrases)


def command_of(text: Column) -> Column:
    found = F.regexp_extract(text, "(?U)" + COMMAND_PATTERN, 1)
    return F.when(found != "", found)


def family_from_text(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for family, pattern in FAMILY_PATTERNS.items():
        hit = low.rlike("(?U)" + pattern)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.when(F.trim(F.regexp_replace(low, r"(?U)\s+", " ")) != "", "question")


def features(text: Column) -> dict[str, Column]:
    """What the shape of a prompt tells before it is sent."""
    return {
        "chars": F.length(text).cast("bigint"),
        "followup": is_followup(text),
        "error": text.rlike("(?mU)" + ERROR_PATTERN),
        "n_files": F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + PATH_PATTERN), F.lit(0)))).cast("bigint"),
        "n_items": F.regexp_count(text, F.lit("(?mU)" + ITEM_PATTERN)).cast("bigint"),
        "question": F.regexp_replace(text, r"(?U)\s+$", "").endswith("?"),
        "command": command_of(text),
    }
