import random

import pytest

from vistaframe.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    return lib, bpe.Encoder(bpe.Vocabulary(bpe.default_path()))


def same(pair, texts):
    lib, own = pair
    for text, (n, ids, decoded), e in zip(texts, own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == " ".join(map(str, e.ids)), repr(text)
        assert n == len(e.ids)
        assert decoded == lib.decode(e.ids, skip_special_tokens=False), repr(text)


def test_edge_texts(pair):
    same(pair, ["", " ", "a", "aaaaaaaaa", "I'll they've 'S don't", "x" * 3000, "\x1c a\x1db", "<|endoftext|>a<|startoftext|>", "<|x|> <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "été e\n\t  b", "İstanbul", "日本語 123", "a\u0000b", "😀😀 !!??", "\x85x"])


def test_every_code_point(pair):
    lib, own = pair
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x34000), *range(0x3D000, 0x40000), *range(0xE0000, 0xE1000))]
    bad = []
    for at in range(0, len(points), 20_000):
        some = points[at : at + 20_000]
        texts = [f"a{c}b {c}" for c in some]
        bad += [hex(ord(c)) for c, g, e in zip(some, own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True) if g[1] != " ".join(map(str, e.ids))]
    assert len(bad) == 0, bad[:50]


def test_long_words(pair):
    """Words beyond LONG go by the heap, with the same ids."""
    rng = random.Random(8)
    same(pair, ["".join(rng.choice("abcdeilnorst") for _ in range(n)) for n in (bpe.LONG, bpe.LONG + 1, 5000, 20_000)] + ["ab" * 4000 + " a b", "a" * 30_001])


def test_random_words(pair):
    rng = random.Random(3)
    alphabet = "aaabcdehilnorst   'éß1.!"
    same(pair, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)])


def test_restore(pair):
    _, own = pair
    ids = list(map(int, own.encode(["Grüße an die Welt"])[0][1].split()))
    assert own.restore(ids) == "grüße an die welt"


def test_query_frame(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, None), (2, None, None), (None, "", "y")], "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, digests=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert len(rows) == 4 and sorted(r.n_tokens for r in rows) == [0, 0, 0, 2]
    assert bpe.encode(df.limit(0)).count() == 0
