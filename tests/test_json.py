"""JSON bytes equal those of Python's ``json`` for accents, CJK, emoji, quotes and control characters."""

import hashlib
import json

from pyspark.sql import functions as F

from jobsignal.functions import text as X

TEXTS = ["", "plain", 'say "hi"', "back\\slash", "line\nbreak\ttab\r", "Développeur", "東京 – 日本", "emoji 😀👩‍💻 end", "\x01\x02\x1f\x7f", "\\u00e9", "a\\", '\\"', "é", "\U0010ffff", "x" * 50_000 + "ü" + '\\"\n' * 20_000]


def test_json_string(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", X.json_string(F.col("t")).alias("j")).collect():
        assert r.j == json.dumps(r.t)


def test_content_hash_by_hand(spark):
    row = {"company": "Café", "description": "東京 😀", "location": "Zürich", "title": 'Dev "I"', "url": "https://x/é"}
    blob = (r'{"company":"Caf\u00e9","description":"\u6771\u4eac \ud83d\ude00","location":"Z\u00fcrich",'
            r'"title":"Dev \"I\"","url":"https://x/\u00e9"}')
    assert json.dumps(row, sort_keys=True, separators=(",", ":")) == blob
    got = spark.createDataFrame([row]).select(X.content_hash(*[F.col(c) for c in ("company", "title", "location", "url", "description")])).first()[0]
    assert got == hashlib.sha256(blob.encode()).hexdigest()


def test_canonical_json_at_any_depth(spark):
    values = [{"b": [1, {"z": None, "a": True}], "a": {"x": ", : {}", "k\"q": "é:,"}}, [], {}, [[], {}, ""], "text", {"t": TEXTS, "😀": {"deep": [[[{"q": "\\"}]]]}},
              {"n": [1, -2, 3.5, 12345678901]}]
    raw = [json.dumps(v, ensure_ascii=bool(i % 2)) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(raw)) + [(99, None)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.canonical_json(F.to_json(F.parse_json("t"))).alias("c")).collect()}
    assert got.pop(99) is None
    assert got == {i: json.dumps(v, sort_keys=True) for i, v in enumerate(values)}
