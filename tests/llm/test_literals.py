"""Literals of added tokens have the ids that the library gives by default."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weft.llm import tokenize


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_literals_are_ids_as_in_the_library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    enc = tokenize.encoder(public_tokenizers.path(name))
    texts = ["<|endoftext|> x", "a<|endoftext|>b c", "plain words <|startoftext|>", "<|ENDOFTEXT|> y", "<|endoftext|", "no literal here", ""]
    assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
