"""Best fit equals a plain search; every document comes back; ids equal the library's."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from jobsignal.llm import packing as K


def plain_best_fit(sizes, length):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            best = min(fits)
            k = max(j for j, r in enumerate(room) if r == best)
        else:
            k = len(bins)
            bins.append([])
            room.append(length)
        bins[k].append(i)
        room[k] -= sizes[i]
    return sorted(room), bins


@pytest.mark.parametrize("length", [1, 7, 8, 100, 2048])
def test_best_fit(length):
    r = random.Random(length)
    for n in (0, 1, 5, 400):
        sizes = [r.randint(1, length) for _ in range(n)]
        bins = K.best_fit(sizes, length)
        assert sorted(i for b in bins for i in b) == list(range(n))
        used = [sum(sizes[i] for i in b) for b in bins]
        assert all(u <= length for u in used)
        assert sorted(length - u for u in used) == plain_best_fit(sizes, length)[0]


@pytest.fixture(scope="module")
def tokens():
    return K.Tokens(open(K.RANKS, "rb").read(), public_tokenizers.PATTERN)


TEXTS = ["", None, "a b c", "  two  spaces ", "Line one.\nLine two 123!", "tab\tand \n space", "don't we'll é ü 漢字 🙂", "x" * 5000, "the same", "the same", "word " * 3000, "a b c", "a 　 b"]


def test_ids_equal_library(tokens, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 2)
    for _ in range(2):
        for t, ids in zip(TEXTS, tokens.encode(pa.array(TEXTS))):
            assert ids.tolist() == tokens.encoding.encode_ordinary(t or "")


def test_round_trip(spark, tokens):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(f"w{r.random():.3f}" for _ in range(r.choice([3, 50, 900])))) for i in range(40)] + [(None, "no id"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    packed = K.pack(docs, length=256, group=5000).persist()
    got = packed.collect()
    assert len({x.pack for x in got}) == len(got)
    for x in got:
        assert len(x.ids) == len(x.position_ids) == 512 and x.cu_seqlens[0] == 0 and x.cu_seqlens[-1] == x.n_tokens <= 256
        want = np.concatenate([np.arange(b - a) for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:])])
        assert np.frombuffer(x.position_ids, "<u2")[: x.n_tokens].tolist() == want.tolist()
        assert len(x.doc_ids) == len(x.offsets) == len(x.cu_seqlens) - 1
    back = defaultdict(list)
    for x in K.unpack(packed).collect():
        back[x.doc_id].append((x.offset, np.frombuffer(x.ids, "<u2").tolist()))
    for i, t in dict(rows).items():
        copies = [k for k, _ in rows].count(i)
        assert [y for _, ids in sorted(back[i])[::copies] for y in ids] == tokens.encoding.encode_ordinary(t or "")
    filled = sum(x.n_tokens for x in got) / (256 * len(got))
    assert filled > 0.85
    assert K.pack(docs.limit(0)).count() == 0
