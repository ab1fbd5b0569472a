"""Encoders and candidate search do the whole job, whatever their caches and estimates say."""

import numpy as np
import pytest

from tarnvol.llm import chunks, minhash


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_a_text_have_the_ids_of_the_library(file):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    tok, enc = Tokenizer.from_file(path), chunks.library_encoder(path)
    texts = ["a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", "x <|startoftext|> <|ENDOFTEXT|> y", "<|endoftext|> 中文 \x1c x 😀é́", "<|endof text|> z", "a  b <|endoftext|><|endoftext|>", "plain words only"]
    for _ in range(2):  # the second time from the caches
        for t in texts:
            assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_pairs_with_a_band_in_common_are_counted_whatever_the_estimate(spark):
    one, other = np.arange(100, dtype="<u8"), np.arange(5, 105, dtype="<u8")  # 95 of 105 shared
    rows = [(1, False, 3, bytes([k]), bytes([k]), 100, [sig] * 8, [7, *range(40 * k, 40 * k + 31)], s.tobytes()) for k, sig, s in ((1, 0, one), (2, -1, other), (3, 0, np.arange(50, 150, dtype="<u8")))]
    df = spark.createDataFrame(rows, "unit long, by_bucket boolean, m long, node binary, root binary, n long, sig array<long>, bands array<long>, shingles binary")
    got = minhash._between(df, 85).collect()
    assert [sorted((bytes(r.a), bytes(r.b))) for r in got] == [[b"\x01", b"\x02"]]
