"""The encoder of chunks against the tokenizer over whole texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stampline.llm.packing import Encoder

PARTS = (
    [*"abcdefgzABCIZ0159", *"İıßẞſÅéÉñΣσςДдЯ中文字가각힣กשǅªº²½①٣", *"̧̣̇́⃝‍‌️​", *".,;:!?)|('\"-_<>", *" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　᠎﻿\x00"]
    + ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "İ,", "TARİHİ. ", "\U0001f600", "\U00010400", "don't "]
)


def wanted(tokenizer, texts):
    return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_whole_texts():
    file = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer, rng = Encoder(file), Tokenizer.from_file(file), random.Random(11)
    assert encoder.by_chunk
    for _ in range(200):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(300)]
        assert encoder.encode(texts) == wanted(tokenizer, texts)


def test_encoder_of_another_tokenizer():
    file = public_tokenizers.path("byte_bpe_50k.json")
    encoder, texts = Encoder(file), ["Two words,  and İ. spaces", "", " a\n\nb <|endoftext|>"]
    assert not encoder.by_chunk and encoder.encode(texts) == wanted(Tokenizer.from_file(file), texts)
