"""Encoding equals the SentencePiece library's; decoding gives the text back."""

import itertools

import pyarrow as pa
import pytest
import sentencepiece

from jobsignal.llm import sentencepiece_codec as S

TEXTS = ["", " ", "\n", "  a  b\n\tc ﬁ é ＡＢ 　x 🙂", "the\r\nfoo   bar    ", "a" * 400 + "the" * 90, " " * 100 + "x", "naïve çà Ünïcode", "The same", "The same",
         "internationalisation " * 300, "x" * 47, "y" * 48, "z" * 49, "\x00a", "a▁b"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_equals_library(spark, lib):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, None, None), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = S.decode(S.encode(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.text is None:
            assert r.ids is None and r.n_tokens == 0 and r.decoded is None
        else:
            assert r.ids == lib.encode(r.text) and r.n_tokens == len(r.ids)
            if "▁" not in r.text:
                assert r.decoded == r.text


def test_empty_table(spark):
    assert S.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_remembered_chunks_do_not_change_ids(lib, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 3)
    enc = S.Encoder(S.Vocabulary.load(open(S.MODEL, "rb").read()))
    for t in TEXTS * 2:
        ids, n = enc.encode(pa.array([t, None]))
        assert ids.tolist() == lib.encode(t) and n.tolist() == [len(ids), 0]


def test_unigram_takes_the_best_path():
    pieces = {p: (i + 1, s) for i, (p, s) in enumerate({"a": -1.0, "b": -1.5, "ab": -1.9, "ba": -2.0, "aba": -3.1, "▁": -0.5, "▁a": -1.2}.items())}
    v = S.Vocabulary(pieces, [], kind="unigram")
    for text in map("".join, itertools.chain.from_iterable(itertools.product("ab ", repeat=k) for k in range(1, 6))):
        ids, _ = S.Encoder(v).encode(pa.array([text]))
        score = {i: s for i, s in pieces.values()}
        full = v.normalise(text)

        def best(at):
            if at == len(full):
                return 0.0
            return max(pieces[full[at:j]][1] + best(j) for j in range(at + 1, min(len(full), at + 3) + 1) if full[at:j] in pieces)

        assert sum(score[i] for i in ids.tolist()) == pytest.approx(best(0))
        assert "".join(v.text_of[i] for i in ids.tolist()) == full


def test_gaps_of_spaces_in_one_batch(lib):
    texts = ["".join(t) for k in range(6) for t in itertools.product("a b", repeat=k)] + ["é  ", "  é", "▁  a"]
    ids, n = S.Encoder(S.Vocabulary.load(open(S.MODEL, "rb").read())).encode(pa.array(texts))
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at:at + k].tolist() == lib.encode(t), t
        at += k


def test_one_text_of_many_blocks(lib, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2_000)
    text = " ".join(f"word{i * 7919} naïve{i}  Ünï🙂{i % 977}" for i in range(6_000)) + "tail" * 1_500
    sizes = []
    chunks = S.Vocabulary.encode_chunks
    monkeypatch.setattr(S.Vocabulary, "encode_chunks", lambda self, c: sizes.append(sum(map(len, c))) or chunks(self, c))
    ids, n = S.Encoder(S.Vocabulary.load(open(S.MODEL, "rb").read())).encode(pa.array([text]))
    assert ids.tolist() == lib.encode(text) and len(sizes) > 50
    assert max(sizes[:-1]) <= 500 and sizes[-1] > 6_000
