"""Chat formatting, URL rules and sharding: the operators that are Spark expressions only."""

import hashlib
import random
import zlib
from collections import Counter

from lakesearch.llm import chat_format as cf, queries as q, sharding as sh, url_filter as uf


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = [*cf.CONTROLS, "\\", "\\\\", "<", "[", "a", "\n", "é", "|turn|>", "/s>", "$1", "", "中"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "<|body|>\\"]), text()) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(100, 0, None, None), (100, None, "assistant", "x\\"), (100, 0, "user", "b"), (100, 0, "user", "a"), (None, 1, "assistant", "<" * 9), (101, 0, "assistant", "long " * 100_000), (101, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    made = cf.format_conversations(df)
    got = made.select("conv_id", "formatted", "loss_runs", cf.parse(made.formatted).alias("turns"), cf.under_mask(made.formatted, made.loss_runs).alias("loss"))
    seen = {r.conv_id: r for r in got.collect()}
    want = {}
    for c, t, role, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    assert set(seen) == set(want)
    for c, turns in want.items():
        turns = sorted(turns)
        r = seen[c]
        assert [(x.role, x.text) for x in r.turns] == [(a, b) for *_, a, b in turns]
        assert r.loss == [b for *_, a, b in turns if a == "assistant"]
        assert sum(x.length for x in r.loss_runs) == len(r.formatted)
        marks = cf.control_pattern().findall(r.formatted)
        assert set(marks) <= {cf.TURN, cf.BODY, cf.PART, cf.END}
        blocks = sum(1 for i, t in enumerate(turns) if not i or turns[i - 1][2] != t[2])
        assert Counter(marks) == Counter({cf.TURN: blocks, cf.BODY: blocks, cf.END: blocks, cf.PART: len(turns) - blocks}) or len(turns) == blocks
    assert cf.format_conversations(df.limit(0)).count() == 0


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "nothing", "://", "http://", "http://com/en/", "HTTP://A.Example.COM/en/7x?q", "https://example.com/en/6", "http://notexample.com/en/71", "http://x.net/de/8", "http://example.net/de/8#a", "http://example.net?/de/8", "http://org/es", "http://b.org/es/", "ftp://É.com/en/É", "http://a.com/en/\n", "x://y://com/en/", "http://com./en/", "http://.com/en/1", "http://a\nb.com/en/"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")

    def want(u):
        host, path = plain(u)
        fit = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.key), default=None)
        return host, path, best and best.key, best.verdict if best else "allow"

    for args in ({}, {"bits": 64}, {"shard_keys": 2}):
        got = uf.judge(df, **args).collect()
        assert len(got) == len(URLS) * 2
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == want(r.url), (r.url, args)
    assert uf.judge(df.limit(0)).count() == 0
    assert all(r.verdict == "allow" for r in uf.judge(df, []).collect())


def test_rules_of_the_contract(spark):
    """The contract's list, written out once more: a host with /de/ under net is allowed by its rule, 8 under example.net is not."""
    listed = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(r.host, r.path): r.verdict for r in uf.RULES} == listed
    urls = [("http://a.net/de/1", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"), ("http://x.example.net/de/80", "example.net/de/8", "block")]
    got = uf.judge(spark.createDataFrame([(u,) for u, *_ in urls], "url string")).collect()
    assert sorted((r.url, r.rule, r.verdict) for r in got) == sorted(urls)


def test_a_long_list_of_rules(spark):
    """A table of rules, in one shard and in several: the same as by looking each key up."""
    pages = spark.range(800).selectExpr("id page_id", "concat('http://h', id % 97, '.com/p', id % 53, '/x') url", "1 url_keys", "2 blocks")
    rules = spark.range(300).selectExpr("if(id % 3 = 0, 'allow', 'block') verdict", "concat('h', id % 60, '.com') host", "concat('/p', id % 10) path")
    known = {}
    for r in rules.collect():
        known[r.host, r.path] = "block" if "block" in (r.verdict, known.get((r.host, r.path))) else r.verdict
    for size in (uf.SHARD_KEYS, 40):
        got = uf.judge(pages, rules, shard_keys=size)
        assert got.columns == ["page_id", "url", "url_keys", "blocks", "host", "path", "rule", "verdict"]
        for r in got.collect():
            fit = [p for h, p in known if h == r.host and r.path.startswith(p)]
            best = max(fit, key=len, default=None)
            assert (r.rule, r.verdict) == (best and r.host + best, known[r.host, best] if best else "allow")


def test_cascade_is_exact(spark):
    keys = [f"key{i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = universe.filter("int(substring(key, 4)) % 10 = 3")
    made = uf.build(universe, listed)
    assert len(made.levels) > 1  # false positives were met and encoded
    got = {r.key for r in universe.filter(made.contains(universe.key)).collect()}
    assert got == {k for k in keys if int(k[3:]) % 10 == 3}


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice(["x", "é" * 50, None, ""])) for i in range(2003)]
    rows += [(2, "a", "x")] * 3 + [(None, "z", "q")] + [(5000 + i, f"only{i}", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for size in (100, 10**6):
        got = sh.shard(df, 40, bucket_rows=size).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        count = Counter(r.shard for r in got)
        assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
        for s in range(40):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
            share = Counter(r.source for r in got if r.shard == s)
            for src, n in Counter(r[1] for r in rows).items():
                assert abs(share[src] - n / 40) <= 2.5, (s, src)
        want = Counter((i, s, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, s, t in rows)
        assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == want
    assert sh.shard(df.limit(0)).count() == 0
    assert sh.shard(df.limit(3), 40).count() == 3


def test_shards_equal_brute_force(spark):
    """Shard and slot of each row by the definition: sort each source by its hash, spread it, sort all, cut."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, rng.choice(["a"] * 9 + ["b", "c", None]), f"t{rng.randrange(90)}") for i in range(700)] + [(5, "a", "same")] * 4
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    crc = lambda t: zlib.crc32(t.encode())
    hashed = [(r.h, r.u, r.doc_id, r.source, r.text) for r in df.select("*", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"), F.xxhash64(F.lit(18), "source").alias("u")).collect()]
    sources = {}
    for x in sorted(hashed, key=lambda x: (x[0], x[2], crc(x[4]), len(x[4]))):
        sources.setdefault(x[3], []).append(x)
    spread = [((n + x[1] % (1 << 20) / (1 << 20)) / len(xs), x) for xs in sources.values() for n, x in enumerate(xs)]
    spread.sort(key=lambda y: (y[0], y[1][0], y[1][2], crc(y[1][4]), len(y[1][4]), y[1][3] is not None, y[1][3] or ""))
    total, want = len(rows), Counter()
    for at, (_, (_, _, i, s, t)) in enumerate(spread):
        shard = at * 40 // total
        want[i, s, crc(t), shard, at - (shard * total + 39) // 40] += 1
    for size in (50, 10**6):
        got = sh.shard(df, 40, bucket_rows=size).collect()
        assert Counter((r.doc_id, r.source, r.text_crc32, r.shard, r.slot) for r in got) == want


def test_conversation_digest(spark, tmp_path):
    spark.createDataFrame([(7, 1, "assistant", None), (7, 0, "user", "hé")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in q.op5_chat_format(spark, str(tmp_path)).collect()}
    p = q.PROBE
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[-1].turns_sha256 == sha(f"user\n{p}\nassistant\n{p}\n") and got[-1].loss_sha256 == sha(p)
    assert got[7].turns_sha256 == sha("user\nhé\nassistant\n\n") and got[7].loss_chars == 0 and got[7].n_turns == 2


def test_long_conversations_take_linear_time(spark):
    """Work on the mask is linear: four times the turns may take a few times as long, not sixteen times."""
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('word ', 40) text")
        made = cf.format_conversations(rows)
        began = time.perf_counter()
        got = made.select(cf.under_mask(made.formatted, made.loss_runs).alias("loss")).first()
        assert len(got.loss) == n // 2 and set(got.loss) == {"word " * 40}
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 8 * seconds(4_000) + 2
