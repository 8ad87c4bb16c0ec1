import hashlib
import random

import pytest
import sentencepiece

from lakesearch.llm import sentencepiece_codec as sc


@pytest.fixture(scope="module")
def both():
    return sc.PieceCodec(sc.public_model()), sentencepiece.SentencePieceProcessor(model_file=sc.public_model())


def texts():
    rng = random.Random(5)
    signs = list(" \n\t\r  ▁aeinotrsthXYZ.,-=*#<>/\\é𝒳中ß01_(){}\x00")
    yield from ["", " ", "\n", "a" * 3000, " " * 99, "=" * 500, "x" * 5000 + "é" * 5000, "<s>[INST] hi", "a▁b", "Ab.Cd, ef!!"]
    for _ in range(3000):
        yield "".join(rng.choices(signs, k=rng.randint(0, 50)))
    for _ in range(500):
        yield "".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0x250, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20))


def test_equals_the_library(both):
    own, sp = both
    for x in texts():
        want = sp.encode(x)
        assert own.encode(x) == want, x
        assert own.decode(want) == sp.decode(want), x
        n, ids, back = own.digest(x)
        assert (n, ids.decode(), back) == (len(want), ",".join(map(str, want)), sp.decode(want)), x


def test_decodes_any_ids(both):
    own, sp = both
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == sp.decode(ids), ids


def test_columns(spark, both):
    _, sp = both
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Hello  world\n", 7), (3, "Hello  world\n", 7), (None, "x", 8)], "doc_id long, text string, n_tokens long")
    got = sc.digests(docs).select("doc_id", "text", "coded.*").collect()
    assert len(got) == 5
    for r in got:
        ids = sp.encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = sc.decode(sc.encode(docs), out="again").collect()
    assert all(r.again == sp.decode(sp.encode(r.text or "")) for r in back)
    assert sc.digests(docs.limit(0)).count() == 0
