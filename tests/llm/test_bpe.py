import base64
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from scoreloom.llm.byte_bpe import ByteBpe, coder, read_ranks, with_ids

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = read_ranks(RANKS)
    return ByteBpe(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_of_all_kinds(both):
    bpe, want = both
    rng = random.Random(3)
    tokens = list(bpe.ranks)
    texts = ["".join(rng.choice("abcdetionth") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["a" * n for n in (1, 2, 3, 7, 63, 64, 65, 1000, 20000)] + [" " * n for n in (2, 5, 17, 999)] + ["é" * 500, "🙂" * 50, "…", "<|endoftext|>", "\x00\xff"]
    for piece in [t.encode() for t in texts] + [rng.choice(tokens) + rng.choice(tokens) for _ in range(4000)]:
        assert bpe.encode_piece(piece) == want._core_bpe.encode_single_piece(piece) if piece else True
        assert bpe.decode(bpe.encode_piece(piece)) == piece


def test_whole_documents(both, spark):
    _, want = both
    encode, decode = coder(RANKS, P.PATTERN)
    import numpy as np
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        if row.text is not None:
            ids = encode(row.text)
            assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(row.text) and decode(ids) == row.text.encode()


def test_nulls_repeats_and_clashes(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "ab  c\n\n d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = with_ids(docs, RANKS, P.PATTERN, digests_only=True).collect()
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0] and len(got) == 4 and set(got[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    full = with_ids(docs, RANKS, P.PATTERN).where("doc_id is null").first()
    assert len(full.ids) == full.n_tokens and full.text == "ab  c\n\n d"
    assert with_ids(docs.limit(0), RANKS, P.PATTERN).count() == 0
