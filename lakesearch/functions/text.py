"""Text functions as Columns: splitting of identifiers, query tokens, stems, index tokens, similarity.

All of them stay in the JVM. Tokens keep their first order (``array_distinct``); a null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf"
# Words, spellings, signs and letters that decide which tokens there are.
STOP_WORDS = (
    "the", "and", "or", "to", "of", "in", "on", "for", "with", "how", "does", "what", "when", "where", "why", "this",
    "that", "from",
)
TYPOS = {
    "ho": "how", "setpup": "setup", "setpu": "setup", "seting": "setting", "configuraiton": "configuration",
    "permisson": "permission", "permisions": "permissions",
}
#: Signs that a query token loses; commas, quotes and the like stay.
SIGNS = r"""[-_*"(){}\[\]^~:+.#@!\\/<>|&$%?]"""
#: Letters with marks and what the index makes of them.
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncaaaaaaeeeeiiiiooooouuuuyync"
CHARS_PER_TOKEN = 3


def split_words(col: Column) -> Column:
    """Split camel case, acronyms, letters from digits and CJK characters."""
    for pattern, to in (  # where the first sign is rare, few places are tried
        ("[A-Z](?<=[a-z][A-Z])", " $0"), ("([A-Z]+)([A-Z][a-z])", "$1 $2"), ("[0-9](?<=[a-zA-Z][0-9])", " $0"),
        ("([0-9])([a-zA-Z])", "$1 $2"), (f"([{CJK}])", " $1 "),
    ):
        col = F.regexp_replace(col, pattern, to)
    return col


def pretokenize(col: Column) -> Column:
    """Split words; collapse white space."""
    return F.trim(F.regexp_replace(split_words(col), "(?U)\\s+", " "))


def tokenize(col: Column) -> Column:
    """Distinct query tokens, in order."""
    plain = F.regexp_replace(F.lower(pretokenize(F.coalesce(col, F.lit("")))), SIGNS, " ")
    typos = F.create_map(*(F.lit(x) for pair in TYPOS.items() for x in pair))
    words = F.transform(F.split(plain, "(?U)\\s+"), lambda t: F.coalesce(F.try_element_at(typos, t), t))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 1) | t.rlike(f"[{CJK}]")))


def stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .when((n > 3) & t.endswith("s"), cut(1))
        .otherwise(t)
    )


def signals(tokens: Column) -> Column:
    """Tokens without stop words, stemmed."""
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)), stem))


def query_text(col: Column) -> Column:
    return F.array_join(tokenize(col), " ")


def index_tokens(col: Column) -> Column:
    """Tokens of the inverted index: runs of letters and digits, lower-cased, without marks."""
    return F.regexp_extract_all(F.lower(F.translate(col, MARKED, PLAIN)), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0))


def query_terms(col: Column) -> Column:
    """Terms of a query, each the array of its index tokens (a phrase, if several)."""
    words = F.filter(F.split(F.coalesce(col, F.lit("")), "(?U)\\s+"), lambda t: t != "")
    return F.transform(words, index_tokens)


def coverage(text_signals: Column, query_signals: Column) -> Column:
    """Share of the query's signals that the text has; 0 without signals."""
    n = F.size(query_signals)
    return F.when(n > 0, F.size(F.array_intersect(query_signals, text_signals)) / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def estimate_tokens(col: Column) -> Column:
    return F.ceil(F.length(col) / CHARS_PER_TOKEN)


def strip_html(html: Column) -> Column:
    """Text of a page: no script and style bodies, tags and named entities as blanks."""
    for pattern in ("(?i)<script[^>]*>[\\s\\S]*?</script>", "(?i)<style[^>]*>[\\s\\S]*?</style>"):
        html = F.regexp_replace(html, pattern, "")
    for pattern in ("<[^>]+>", "(?i)&[a-z]+;", "(?U)\\s+"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(html)


def trim_all(col: Column) -> Column:
    return F.regexp_replace(col, "(?U)^\\s+|\\s+$", "")


def snippet(content: Column, query: Column, size: int = 240) -> Column:
    """A window around the first place of the longest query token that the text holds."""
    terms = F.array_sort(tokenize(query), lambda a, b: F.length(b) - F.length(a))
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(content), t)), lambda p: p > 0)
    at = F.get(places, F.lit(0)) - 1
    begin = F.greatest(F.lit(0), at - size // 2)
    end = F.least(F.length(content), begin + size)
    return F.when(at.isNull(), F.substring(content, 1, size)).otherwise(
        F.concat(
            F.when(begin > 0, "...").otherwise(""), F.substring(content, begin + 1, end - begin),
            F.when(end < F.length(content), "...").otherwise(""),
        )
    )


def exact_lookup(query: Column) -> Column:
    """Quotes, paths, CamelCase, acronyms, file names or ticket numbers ask for an exact look-up."""
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"  # Java's own knows more letters
    q, out = trim_all(query), F.lit(False)
    for pattern in (
        "[\"'`]", r"[./\\][\w.-]+", r"\b[A-Z][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*\b", r"\b[A-Z]{2,}[_-]?[A-Z0-9]*\b",
        r"\b[a-zA-Z_][\w-]*\.(ts|tsx|js|jsx|go|rs|py|java|md|json|ya?ml|toml)\b", r"\b[A-Z]+-\d+\b",
    ):
        out = out | q.rlike(pattern.replace(r"\b", edge))
    return out


CONCEPT = "(?i)how|why|explain|concept|architecture|design|流程|架構|概念|為什麼|如何"


def auto_mode(query: Column) -> Column:
    words = F.size(F.filter(F.split(trim_all(query), "(?U)\\s+"), lambda t: t != ""))
    return (
        F.when(exact_lookup(query), "fast").when((words >= 10) | query.rlike(CONCEPT), "semantic").otherwise("hybrid")
    )
