"""Text functions and intent-aware ranking on written examples."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lakesearch.functions import rank, text


def values(spark, texts, column, schema="x string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i long, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_pretokenize(spark):
    cases = {
        "getUserName": "get User Name", "XMLHttpRequest": "XML Http Request", "utf8Decoder2": "utf 8 Decoder 2", "知識庫": "知 識 庫",
        "搜尋engine": "搜 尋 engine", "  plain  words ": "plain words", "": "", "a　b\tc": "a b c",
    }
    assert values(spark, cases, text.pretokenize(F.col("x"))) == list(cases.values())


def test_query_tokens(spark):
    cases = {
        "ho setpup permisson": ["how", "setup", "permission"], "parseJSON parse": ["parse", "json"], "a x 庫": ["庫"], "": [], None: [],
        "constructor": ["constructor"], "foo,bar (baz)": ["foo,bar", "baz"],
    }
    assert values(spark, cases, text.tokenize(F.col("x"))) == list(cases.values())


def test_stems_and_stop_words(spark):
    words = ["the policies running tested is tables as", "ing ted bus ies"]
    assert values(spark, words, text.signals(text.tokenize(F.col("x")))) == [["policy", "runn", "test", "is", "table", "as"], ["ing", "ted", "bus", "ies"]]


def test_index_tokens_agree_with_fts5(spark):
    """The index splits and folds as the default tokeniser of SQLite's full-text index does."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
        db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    texts = ["Don't stop: naïve Äpfel_2 straße", "foo.bar-baz x1 42", "", "ÇA ÑANDÚ, Été", "知 識"]
    for i, x in enumerate(texts):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i + 1, x))
    want = [[r[0] for r in db.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (i + 1,))] for i in range(len(texts))]
    assert values(spark, texts, text.index_tokens(F.col("x"))) == want


def test_html(spark):
    page = "<html><STYLE a>b{}</style><script>var x = '<p>';\n</SCRIPT ><p>Tom &amp; Jerry&#33;<br/>\n\n end</p></html>"
    assert values(spark, [page.replace("</SCRIPT >", "</script>")], text.strip_html(F.col("x"))) == ["Tom Jerry&#33; end"]


def test_auto_mode(spark):
    cases = {
        'find "exact"': "fast", "src/engine.py": "fast", "UserService": "fast", "HTTP": "fast", "TICKET-12": "fast", "engine.py": "fast",
        "how to deploy": "semantic", "show tables": "semantic", "one two three four five six seven eight nine ten": "semantic",
        "架構": "semantic", "user login": "hybrid", "": "hybrid",
    }
    assert values(spark, cases, text.auto_mode(F.col("x"))) == list(cases.values())


def test_snippet(spark):
    long = "x" * 300 + " needle " + "y" * 300
    rows = spark.createDataFrame([(0, long, "a needle"), (1, "short text", "absent"), (2, long, "absent"), (3, "Needle first", "needle")], "i long, c string, q string")
    got = [r.s for r in rows.orderBy("i").select(text.snippet(F.col("c"), F.col("q")).alias("s")).collect()]
    assert got[0] == "..." + long[301 - 120 : 301 - 120 + 240] + "..."
    assert got[1:] == ["short text", long[:240], "Needle first"]


def score(spark, query, path, content="", base=0.5):
    kind = rank.file_type(F.lit(path))
    q = text.signals(text.tokenize(F.lit(query)))
    r = rank.rank(F.lit(base), F.lit(path), kind, text.signals(text.tokenize(F.lit(content))), q)
    return spark.range(1).select(r.alias("r"), rank.enough_evidence(r, q).alias("e")).first()


def test_tests_and_locales_are_demoted_unless_asked_for(spark):
    at = lambda q, p: score(spark, q, p).r.adjusted_score
    assert at("parse errors", "src/errors.go") > at("parse errors", "src/errors_test.go")
    assert at("test parse errors", "src/errors_test.go") > at("test parse errors", "src/errors.go")
    assert at("greeting", "locales/en.json") == pytest.approx(0.2 * at("greeting", "data/en.json"))
    assert at("locale greeting", "data/x/locales/en.json") > 0.5
    assert not score(spark, "x", "src/locale.go").r.is_localization and score(spark, "x", "lang/a.md").r.is_localization


def test_boosts(spark):
    assert score(spark, "install guide", "README.md").r.documentation_boost == 0.85
    assert score(spark, "setup", "docs/usage.md").r.documentation_boost == 0.35
    assert score(spark, "errors", "src/errors.go").r.source_boost == 0.32
    assert score(spark, "setup errors", "src/errors.go").r.source_boost == 0.05
    assert score(spark, "alpha beta gamma", "alpha/beta/gamma/x.txt").r.path_boost == 0.45
    assert score(spark, "src helper", "src/errors.go").r.source_boost == pytest.approx(0.18)
    assert score(spark, "setup src", "src/x.go").r.path_boost == 0.08


def test_evidence(spark):
    ok = lambda q, c, p="notes/x.txt": score(spark, q, p, c).e
    assert ok("alpha", "nothing") and ok("alpha beta", "beta") and not ok("alpha beta", "gamma")
    assert not ok("alpha beta gamma delta", "alpha") and ok("alpha beta gamma delta", "alpha beta")
    assert ok("alpha errors gamma delta", "", "src/errors.go")


def test_file_types(spark):
    paths = {"a/b.TS": "typescript", "x.tsx": "typescript", "Makefile": "text", ".env": "text", "a.cs": "text", "x/y.mdx": "markdown", "q.yml": "yaml", "a.b/c": "text"}
    assert values(spark, paths, rank.file_type(F.col("x"))) == list(paths.values())
    assert values(spark, [" TS ", "yml", "go", "cs"], rank.normalize_type(F.col("x"))) == ["typescript", "yaml", "go", "csharp"]
