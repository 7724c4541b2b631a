import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tessellon.llm import bpe, packing, queries
from tests.llm.fixtures import SF, awkward, table

SPEC = bpe.read_ranks(P.path("word_bpe_49k.json"))


def used(runs):
    out = defaultdict(int)
    for n, members in runs:
        for w, k in members:
            out[w] += n * k
    return dict(out)


def exact(sizes, capacity):
    """Fewest bins by exhaustive search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_plan_is_valid_and_the_reduction_keeps_the_optimum():
    rnd = random.Random(4)
    for _ in range(250):
        cap = rnd.choice([10, 17, 30])
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        counts = {w: sizes.count(w) for w in sizes}
        runs = packing.plan(counts, cap)
        assert used(runs) == counts
        assert all(sum(w * k for w, k in m) <= cap for _, m in runs)
        fixed, left = packing.reduce_instance(counts, cap)
        rest = [w for w, n in left.items() for _ in range(n)]
        best = exact(sizes, cap)
        assert sum(n for n, _ in fixed) + exact(rest, cap) == best
        assert packing.lower_bound(counts, cap) <= best <= sum(n for n, _ in runs)


def test_large_plan_is_near_the_bound():
    rnd = np.random.default_rng(1)
    counts = {int(w): int(rnd.integers(1, 10**6)) for w in rnd.choice(np.arange(1, 2049), 700, replace=False)}
    runs = packing.plan(counts)
    assert used(runs) == counts
    assert sum(n for n, _ in runs) <= 1.01 * packing.lower_bound(counts, 2048) + 1


def check(rows, texts):
    t = Tokenizer.from_str(SPEC.decode())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    seqs, by = defaultdict(list), defaultdict(dict)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.start == 2048 * r.piece
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id][r.piece] = r.length
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert {i: sum(p.values()) for i, p in by.items()} == {i: len(x) for i, x in ids.items()}
    return len(seqs), -(-sum(len(x) for x in ids.values()) // 2048)


def test_query(spark):
    n, least = check(queries.op5_best_fit_packing(spark, SF).collect(), dict(table(columns="doc_id, text")))
    assert n <= 1.05 * least + 1


def test_awkward(spark):
    df = awkward(spark)
    rows = packing.pack_documents(df, SPEC).collect()
    check(rows, {r.doc_id: r.text for r in df.collect()})
    assert sum(r.doc_id == 8 for r in rows) == 2
    assert packing.pack_documents(df.limit(0), SPEC).count() == 0
