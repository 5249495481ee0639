"""Column functions on text: folding, keys, names, lines, sizes. Patterns carry (?U) where words and blanks are Unicode's."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
GENERIC_NAMES = [
    "memory_json", "project_context", "current_tasks", "completed_tasks", "open_questions", "last_updated",
    "history_txt", "main_py", "agents_md", "decisions_md", "tasks_md", "needs_review",
]
RESERVED_NAMES = ["aux", "con", "nul", "prn", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]
TECHNOLOGIES = {
    "python": "Python", "sqlite": "SQLite", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "fastapi": "FastAPI",
    "django": "Django", "flask": "Flask", "docker": "Docker", "redis": "Redis", "react": "React", "typescript": "TypeScript",
    "javascript": "JavaScript", "telegram": "Telegram", "pytest": "pytest", "git": "Git",
}
COMPLETED = "готово|сделано|реализован[оаы]?|исправлен[оаы]?|completed|done|implemented"
BUG = "баг|ошибк|не работает|bug|broken"
TODO = "надо|нужно|осталось|todo|сделать|добавить|реализовать"
IDEA = "идея|когда-нибудь|потом|в будущем|idea|later"
DECISION = "решили|решено|выбрали|переходим|перешли|отказались|decided|migrated"
CONSTRAINT = "нельзя|не должен|ограничени|только локально|must not|constraint"
QUESTION = "или|неясно|не уверен|which|whether"
STOP = "готово|сделано|реализовано|добавить|добавлены|надо|нужно|todo|done|completed"
TERMINATORS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
NEEDS_REVIEW = "[NEEDS_REVIEW]"


def fold(c: Column) -> Column:
    """Case folding: lower case, and the two letters it leaves."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def bound(value: Column, f) -> Column:
    """f of a value that is made once: the optimizer copies a column into each place where it is named, but not into a lambda."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    """Without blanks at both ends; the pattern runs only where an end is one (line ends are blanks, so $ asks for no more)."""
    ends = lambda v: F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1)).rlike(r"(?U)[\s\x1c-\x1f]")
    return bound(c, lambda v: F.when(ends(v), F.regexp_replace(v, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(v))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(fold(c), F.lit("ё"), F.lit("е")), r"(?U)[\s\x1c-\x1f]+", " "))


def has_word(c: Column, words: str) -> Column:
    """One of the alternatives stands as whole words in folded text; the pattern runs only where the letters of one are found."""
    some = [F.contains(c, F.lit(re.sub(r"\[\w+\]\?$", "", w))) for w in words.split("|")]
    return reduce(Column.__or__, some) & c.rlike(rf"(?U)\b({words})\b")


def stable_id(kind: Column, text: Column) -> Column:
    """First 20 hex digits of the SHA-256 of kind, a zero byte and the collapsed text."""
    return F.substring(F.sha2(F.concat(kind, F.lit("\0"), collapse(text)), 256), 1, 20)


def match_key(text: Column) -> Column:
    """The key on which stored items meet: folded, status words blanked, word tokens joined by a blank. Can be empty."""
    blanked = F.regexp_replace(F.replace(fold(text), F.lit("ё"), F.lit("е")), rf"(?U)\b({STOP})\b", " ")
    return F.array_join(F.regexp_extract_all(blanked, F.lit(r"(?U)[\w+#.]+"), 0), " ")


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def similar(a: Column, b: Column) -> Column:
    """Two keys name one thing, but for the arm that needs edit similarity (see operators.fold)."""
    ta, tb = tokens(a), tokens(b)
    shared, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    near = (shared / union >= 0.75) | ((shared == F.least(F.size(ta), F.size(tb))) & (F.abs(F.size(ta) - F.size(tb)) <= 1))
    return (a != "") & (b != "") & ((a == b) | ((shared >= 2) & near))


def spelled(a: str, b: str) -> Column:
    """Two key columns have nearly the same letters: SequenceMatcher's ratio of at least 0.9, a being the text that was there before."""
    @F.pandas_udf("boolean")
    def own(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        of = (SequenceMatcher(None, p, q) for p, q in zip(x, y))
        return pd.Series([m.quick_ratio() >= 0.9 and m.ratio() >= 0.9 for m in of], dtype=bool)

    return own(a, b)


def refers(text_key: Column, reference_key: Column) -> Column:
    """The reference's tokens all occur in the text, or the two are similar."""
    subset = F.size(F.array_except(tokens(reference_key), tokens(text_key))) == 0
    return (text_key != "") & (reference_key != "") & (similar(text_key, reference_key) | subset)


def useful_lines(text: Column) -> Column:
    """array<string>: lines without leading bullets and numbers, stripped, of 8 to 500 characters."""
    # split() compiles its pattern for every row; the guard's is compiled once, and its characters begin all terminators
    raw = F.when(~text.rlike(TERMINATORS.partition("|")[2]), F.array(text)).otherwise(F.split(text, TERMINATORS))
    bare = F.transform(raw, lambda x: strip(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]*[-*\d.)]+[\s\x1c-\x1f]*", "")))
    return F.filter(bare, lambda x: F.length(x).between(8, 500))


def message_size(text: Column, role: Column, date: Column) -> Column:
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return n(text) + n(role) + n(date) + 64


def confidence_rank(c: Column) -> Column:
    return F.when(c == "LOW", 0).when(c == "HIGH", 2).otherwise(1)


def clean_confidence(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.isin("LOW", "MEDIUM", "HIGH"), up).otherwise("MEDIUM")


def _nfkc(c: Column) -> Column:
    """Compatibility composition, which Spark lacks; made on call, as workers import this module too."""

    @F.pandas_udf("string")
    def own(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return own(c)


def safe_name(c: Column, ascii_only: bool = False) -> Column:
    """A project's file-safe name; null if nothing is left. ascii_only: the caller knows that NFKC changes nothing."""
    plain = F.length(c) == F.octet_length(c)  # ASCII is its own composition: workers get nulls in its place
    x = F.lower(strip(c if ascii_only else F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))))
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)[\s-]+", "_"), r"(?U)[^\w.]", "")
    x = F.regexp_replace(x, r"^[._]+|[._]+$", "")
    x = bound(x, lambda v: F.when(fold(v).isin(RESERVED_NAMES), F.concat(F.lit("project_"), v)).otherwise(v))
    return bound(F.regexp_replace(F.substring(x, 1, 80), r"[. ]+$", ""), lambda v: F.when(v != "", v))


def title(c: Column) -> Column:
    """Upper case for each letter after a non-letter, lower case for others; underscores become blanks."""
    runs = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def role_of(c: Column) -> Column:
    """user, assistant or system; null for other names."""
    x = strip(fold(c))
    return F.when(x.isin("user", "пользователь", "human"), "user").when(x.isin("assistant", "ассистент", "codex", "model", "bot"), "assistant").when(x.isin("system", "developer", "tool"), "system")
