import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessellon.llm import bpe, queries
from tests.llm.fixtures import SF, awkward, table

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec():
    return bpe.PrefixBPE(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: np.array(t.encode_ordinary(s), "<u4").tobytes()


def test_random_texts(codec, library):
    rnd = random.Random(1)
    for _ in range(1500):
        s = "".join(rnd.choice(" \n\t\r  abcdeE'sté漢🙂ß09.,!-\x00") for _ in range(rnd.randint(0, 40)))
        assert codec.encode(s) == library(s)
        assert codec.decode(codec.encode(s)) == s.encode()
        s = " ".join(rnd.choice(["Wörter", "tion,", "'s.", "a1!", "é?", "x", "", "thing."]) for _ in range(20))
        assert codec.encode(s) == library(s)


def test_appends_and_edits(codec):
    rnd = random.Random(2)
    for _ in range(200):
        data = "".join(rnd.choice("abcdet") for _ in range(rnd.randint(100, 600))).encode()
        last = codec.fill(data, [-1])
        assert last == codec.table(data)
        more, table_ = codec.append(data, list(last), b"ther")
        assert table_ == codec.fill(more, [-1])
        i = rnd.randrange(len(data))
        edited, table_, filled = codec.edit(data, last, i, min(len(data), i + 5), b"the")
        assert table_ == codec.fill(edited, [-1]) and filled <= len(edited)
        assert codec.read(table_) == codec.merge(edited)


def test_query(spark, library):
    texts = dict(table(columns="doc_id, text"))
    rows = queries.op10_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward(spark, library):
    df = awkward(spark)
    out = bpe.encode(df, RANKS, P.PATTERN, decoded=True)
    want = sorted((r.doc_id, library(r.text or "")) for r in df.collect())
    assert sorted((r.doc_id, bytes(r.ids)) for r in out.collect()) == want
    back = bpe.decode(out, RANKS, P.PATTERN)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in df.collect())
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
