"""Intent-aware ranking of chunks for a query, as Columns over precomputed token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import coverage, signals, tokenize

TYPE_ALIASES = {
    "csharp": "csharp", "cs": "csharp", "cpp": "cpp", "hpp": "cpp", "js": "javascript", "jsx": "javascript",
    "md": "markdown", "mdx": "markdown", "php": "php", "py": "python", "rb": "ruby", "sh": "shell",
    "ts": "typescript", "tsx": "typescript", "yml": "yaml",
}
SOURCE_TYPES = "c cpp csharp go java javascript php python ruby rust typescript".split()
TEST_MARKS = ("_test.", ".test.", ".spec.", "/test/", "/tests/", "tests/", "__tests__/", "spec/")
TEST_WORDS = ("assert", "fixture", "spec", "test", "testing")
GUIDE_WORDS = ("config", "configuration", "install", "onboard", "quickstart", "setup", "start", "usage")
LOCALE_WORDS = ("i18n", "lang", "language", "locale", "localization", "translation")
LOCALE_TYPES = ("json", "markdown", "text", "toml", "yaml")
LOCALE_DIRS = "(^|/)(locale|locales|lang|i18n|translations)/"
MIN_SCORE = 0.18

EXTENSIONS = {
    ext: kind for kind, exts in {
        "typescript": "ts tsx", "javascript": "js jsx mjs", "python": "py", "go": "go", "rust": "rs", "java": "java",
        "c": "c h", "cpp": "cpp hpp", "markdown": "md mdx", "json": "json", "yaml": "yaml yml", "toml": "toml", "html": "html",
        "css": "css scss", "shell": "sh bash zsh", "sql": "sql", "graphql": "graphql", "text": "txt csv log",
    }.items() for ext in exts.split()
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def file_type(path: Column) -> Column:
    """From the extension of the last path part; text if unknown."""
    ext = F.lower(F.regexp_extract(path, "[^/]\\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(_map(EXTENSIONS), ext), F.lit("text"))


def normalize_type(kind: Column) -> Column:
    low = F.lower(F.trim(kind))
    return F.coalesce(F.try_element_at(_map(TYPE_ALIASES), low), low)


def _any(words: tuple[str, ...], query_signals: Column) -> Column:
    return F.arrays_overlap(query_signals, F.array(*map(F.lit, words)))


def asks_for_tests(query_signals: Column) -> Column:
    return _any(TEST_WORDS, query_signals)


def asks_for_guide(query_signals: Column) -> Column:
    return _any(GUIDE_WORDS, query_signals)


def asks_for_locale(query_signals: Column) -> Column:
    return _any(LOCALE_WORDS, query_signals)


def is_test(path: Column) -> Column:
    low, out = F.lower(path), F.lit(False)
    for mark in TEST_MARKS:
        out = out | low.contains(mark)
    return out


def is_locale(path: Column, kind: Column) -> Column:
    return kind.isin(*LOCALE_TYPES) & F.lower(path).rlike(LOCALE_DIRS)


def path_signals(path: Column) -> Column:
    return signals(tokenize(F.regexp_replace(path, "[./_-]", " ")))


def base_signals(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(F.regexp_replace(base, "\\.[^.]+$", ""), "(?i)_test$|\\.test$|\\.spec$", "")
    return signals(tokenize(F.regexp_replace(stem, "[._-]", " ")))


def path_boost(paths: Column, query_signals: Column) -> Column:
    hits = F.size(F.array_intersect(query_signals, paths))
    return F.when(hits == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.45), F.lit(0.18) * hits))


def source_boost(kind: Column, paths: Column, bases: Column, query_signals: Column) -> Column:
    path = path_boost(paths, query_signals)
    base = F.when(F.arrays_overlap(bases, query_signals), F.lit(0.32)).otherwise(F.lit(0.0))
    return (
        F.when(~kind.isin(*SOURCE_TYPES), F.lit(0.0))
        .when(asks_for_guide(query_signals), F.least(F.lit(0.05), path))
        .when(base > 0, base)
        .otherwise(F.least(F.lit(0.22), path))
    )


def guide_boost(path: Column, kind: Column, query_signals: Column) -> Column:
    low = F.lower(path)
    named = low.contains("install") | low.contains("readme") | low.contains("getting-started") | low.contains("quickstart")
    return (
        F.when(~asks_for_guide(query_signals) | (kind != "markdown"), F.lit(0.0))
        .when(named, F.lit(0.85)).when(low.startswith("docs/"), F.lit(0.35)).otherwise(F.lit(0.0))
    )


def rank(base: Column, path: Column, kind: Column, text_signals: Column, query_signals: Column) -> Column:
    """Struct of diagnostics with adjusted_score; text_signals are of the prefixed text of the chunk."""
    paths, bases = path_signals(path), base_signals(path)
    guide, tests = asks_for_guide(query_signals), asks_for_tests(query_signals)
    p = path_boost(paths, query_signals)
    p = F.when(guide & kind.isin(*SOURCE_TYPES), F.least(F.lit(0.08), p)).otherwise(p)
    s, d = source_boost(kind, paths, bases, query_signals), guide_boost(path, kind, query_signals)
    test, locale = is_test(path), is_locale(path, kind)
    penalty = F.when(locale & ~asks_for_locale(query_signals), F.lit(0.2)).otherwise(F.lit(1.0))
    factor = F.when(test & ~tests, F.lit(0.48)).when(~test & tests, F.lit(0.88)).otherwise(F.lit(1.0))
    return F.struct(
        ((base + p + s + d) * factor * penalty).alias("adjusted_score"), base.alias("base_score"),
        coverage(text_signals, query_signals).alias("coverage"), d.alias("documentation_boost"), locale.alias("is_localization"),
        test.alias("is_test"), penalty.alias("localization_penalty"), p.alias("path_boost"), s.alias("source_boost"),
        tests.alias("test_intent"), guide.alias("user_guide_intent"),
    )


def enough_evidence(ranking: Column, query_signals: Column) -> Column:
    n = F.size(query_signals)
    return (
        F.when(n <= 1, True).when(ranking.source_boost >= 0.22, True)
        .when(n <= 3, ranking.coverage >= 1.0 / n).otherwise(ranking.coverage >= 0.34)
    )
