"""SentencePiece coding against the library, packing against brute force and round trips."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256

import pytest
import sentencepiece

from evalmill.llm import packing, sentencepiece_codec

P = pytest.importorskip("public_tokenizers")
HARD = [
    None, "", " ", "   ", "a", " a", "  a  b   ", "\n", "a\n\nb", "\t x", "é", "日本語のテキスト", "😀 emoji 👩‍👩‍👧", "\x00\x01", "▁", "a▁b", "<s>", "</s>",
    "<unk>", "<0x41>", "１２３", "ＡＢＣ", "ﬁ", " x", "x​y", "𝔘", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "    " * 30, "=" * 99, "1234567890" * 9, "don't x-y_z",
    "́e", "é", "Straße über", "\r\n", "a b", "�", "word " * 40_000,
]


def test_ids_and_texts_equal_the_library(spark):
    file = P.path("piece_bpe_32k.model")
    texts = HARD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r["doc_id"]: r for r in sentencepiece_codec.encoded_digests(docs, file).collect()}
    import numpy as np

    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        said = library.decode(ids)
        got = (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"])
        assert got == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(said.encode()).hexdigest()), repr(text)[:80]
    assert sentencepiece_codec.encoded_digests(spark.createDataFrame([], docs.schema), file).count() == 0


def least_bins(lengths, capacity):
    order = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def best(at, rooms):
        if at == len(order):
            return 0
        n, out = order[at], 1 + best(at + 1, tuple(sorted((*rooms, capacity - order[at]))))
        for k, room in enumerate(rooms):
            if room >= n and (not k or rooms[k - 1] != room):
                out = min(out, best(at + 1, tuple(sorted((*rooms[:k], room - n, *rooms[k + 1 :])))))
        return out

    return best(0, ())


def test_reduction_keeps_an_optimum():
    draw = random.Random(4)
    for _ in range(60):
        lengths = [draw.randint(1, 30) for _ in range(draw.randint(1, 9))]
        fixed, rest = packing.reduce_dominated(dict(Counter(lengths)), 30)
        assert all(sum(p.lengths) <= 30 for p in fixed)
        back = Counter(rest)
        for p in fixed:
            back.update({n: c * p.count for n, c in Counter(p.lengths).items()})
        assert back == Counter(lengths)
        assert sum(p.count for p in fixed) + least_bins(Counter(rest).elements(), 30) == least_bins(lengths, 30)


def test_packing_is_gapless_and_close_to_the_bound(spark):
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    texts = [*HARD, "tie tie", "tie tie"] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    rows = packing.pack(packing.token_pieces(docs, file)).collect()
    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    lengths = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in lengths.items():
        assert sorted(by_doc[i]) == [(k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096))]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(lengths.values()) // 4096) + 3
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], docs.schema), file)).count() == 0
