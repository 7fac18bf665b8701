import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe  # noqa: E402
from tessera.llm._text import utf8  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=0):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", "l", "hello", " World", "é", "日本", "123", "٣", "!", "...", " ", " ", "ᲀ", "𝒳", "\x1c", "\x85", "S", "'S", "<|endoftext|>", "aaaaaaaaaaaaaaaaa", "‍", "👩‍🚀", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_matches_the_library(vocabulary, reference):
    texts = ["", "a", " ", "\n", "  \n ", "it's", " 's", "\n's", "''s", "x''s", "'s's'll'lx", "a" * 5000, "ab" * 3000 + " " * 4000 + "x"] + random_texts(3000)
    ids, offsets = bpe.encode_texts(vocabulary, bpe.class_table(vocabulary), *utf8(pa.array(texts)))
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == reference.encode_ordinary(t), repr(t)
        assert bpe._decoded(vocabulary.tokens, ids[a:b]) == t.encode()


def test_long_piece_equals_matrix(vocabulary):
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 105, 900).astype(np.uint8)
    ids, n = bpe.merge_rows(vocabulary, vocabulary.byte_ids[piece][None, :].copy(), np.array([900]))
    assert bpe._merge_long(vocabulary, piece).tolist() == ids.tolist() and len(ids) == n[0]


@pytest.mark.parametrize("seed", range(4))
def test_long_pieces_match_the_library(vocabulary, reference, seed):
    rng = random.Random(seed)
    letters = ["ab", "the and of", "etaoinshrdlu", "etaoinéß日本語"][seed].replace(" ", "")
    for n in (2049, 30_000):
        t = "".join(rng.choice(letters) for _ in range(n))
        t = t if seed != 1 else "".join(rng.choice(["the", "and", "of", "ing", "aaaaaaa"]) for _ in range(n // 3))
        assert bpe._merge_long(vocabulary, np.frombuffer(t.encode(), np.uint8)).tolist() == reference.encode_ordinary(t)


def test_a_piece_of_five_megabytes(vocabulary):
    rng = np.random.default_rng(5)
    piece = rng.choice(np.frombuffer(b"etaoinshrdlucmfwypvbgkjqxz", np.uint8), 5 << 20)
    ids = bpe._merge_long(vocabulary, piece)
    assert bpe._decoded(vocabulary.tokens, ids) == piece.tobytes() and len(ids) < len(piece) // 1.5
    # No pair is left that could still merge.
    assert (bpe._lookup(vocabulary, ids[:-1].astype(np.int64), ids[1:].astype(np.int64)) == bpe.NONE).all()


def test_query_rows(spark, reference):
    rows = [(1, "Hello world's end", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "tie", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        e = reference.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(e), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
