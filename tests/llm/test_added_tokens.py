"""Texts that quote added tokens, against the tokenizer as its file has it."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from evalmill.llm import packing

P = pytest.importorskip("public_tokenizers")


def test_added_tokens_are_those_of_the_file(spark):
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a <|ENDOFTEXT|> b", "<|endoftext |>", "日本 <|endoftext|>", "plain words"]
    tokenizer = Tokenizer.from_file(file)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.token_pieces(docs, file).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert found[i] == (len(ids), zlib.crc32(ids.tobytes())), text
    assert len(tokenizer.encode(texts[0], add_special_tokens=False).ids) == 3
