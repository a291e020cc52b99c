import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sandpiper.llm import bpe
from sandpiper.llm.queries import op5_bpe

from .helpers import docs, odd_docs, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def code():
    return bpe.Coder(bpe.read_vocabulary(PATH))


def test_whole_table_as_the_tokenizers_library_does(spark, sf_dir, tok):
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in op5_bpe(spark, sf_dir).collect()} == want


def test_random_texts_and_random_cuts(tok, code):
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "a", "the", "I'll", "don't", "'s", "'", "Ünï", "你好", "🙂", "é", "12", "3", "!!", "<|endoftext|>", "<|endof", "text|>", "\x00", "_", "ﬁ", "word"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        raw = text.encode()
        want = tok.encode(text, add_special_tokens=False).ids
        places = sorted({c for c in (rng.randrange(len(raw) + 1) for _ in range(rng.randrange(5))) if 0 < c < len(raw) and raw[c] & 0xC0 != 0x80})
        for got in (code.encode(text), code.encode_chunks(raw, np.array(places, np.int64))):
            assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert code.decode(got).decode() == tok.decode(want, skip_special_tokens=False)


def test_chunks_are_reused(code):
    passage = " ".join(f"word{k * k % 977}" for k in range(4000)).encode()
    texts = [b"one start " + passage, b"another, longer start " + passage]
    before = code.reused
    for text, cuts in zip(texts, bpe.content_cuts(texts), strict=True):
        assert len(cuts) > 3
        assert code.encode_chunks(text, cuts) == code.encode(text.decode())
    assert code.reused - before > 3


def test_odd_rows(spark, tok):
    rows = odd_docs(spark)
    got = bpe.encode_decode(with_clashes(rows), PATH).collect()
    want = sorted(r.text or "" for r in rows.collect())
    assert sorted(r.decoded for r in got) == want
    assert sorted(len(r.ids) // 4 for r in got) == sorted(len(tok.encode(t, add_special_tokens=False).ids) for t in want)
    assert bpe.encode_decode(docs(spark, []), PATH).count() == 0
