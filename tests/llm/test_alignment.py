"""Token alignment against a plain version that encodes whole texts and compares byte ranges pair by pair."""

import collections
import hashlib
import json

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from memspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    symbols = alignment._byte_of_symbol()
    entry = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}

    def spans(ids, bytes_of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(bytes_of(i))))
            at = out[-1][2]
        return out

    a_bytes = lambda i: bytes(symbols[c] for c in entry[i])
    b_bytes = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], collections.Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a = spans(tokenizer.encode(want.decode(), add_special_tokens=False).ids, a_bytes)
        b = spans(model.encode(text or ""), b_bytes)
        if not text or b"".join(a_bytes(i) for i, *_ in a) != want or b"".join(b_bytes(i) for i, *_ in b) != want:
            docs.append(None)
            continue
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(x[0]) for x in side if low <= x[1] < high) for side in (a, b)))
            low = high
        docs.append((len(a), len(b), groups, links))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == top[x[1]] for x in d[3]), sum(counts[x] for x in d[3]),
             hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


TEXTS = [None, "", " ", "   ", "a", "a  b", " lead", "tail ", "it's  a\t b\n\nc ", "x\x85y  z　 q", "é è à ö naïve", "日本 語です", "<|endoftext|> <s> <unk>",
         "The quick brown fox jumps over the lazy dog. " * 30, "1234 5678 12.5", "a\x1c b\x00c", "emoji 😀👍 here", "x" * 500, "under▁score here",
         "Ünïcödé wörds ünd mehr", "tab\tand\nline", "don't can't won't", "hello hello hello", "ﬁne ﬂow", "a b", "﻿bom", "é combining"]


def columns(r):
    return tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_like_the_plain_version(spark, monkeypatch):
    texts = TEXTS + TEXTS[10:15]
    rows = [(i if i % 9 else None, t, "c", 1, 2, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, key string, slice int, n int, place int").repartition(3)
    want = sorted(zip((r[0] for r in rows), plain(texts), strict=True), key=str)
    assert sorted(((r["id"], columns(r)) for r in alignment.align(df, "id", "text", A, B).collect()), key=str) == want
    monkeypatch.setattr(alignment.slices, "__defaults__", (40,))  # many slices
    assert sorted(((r["id"], columns(r)) for r in alignment.align(df, "id", "text", A, B).collect()), key=str) == want


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    got = {r["doc_id"]: columns(r) for r in alignment.align(df, "doc_id", "text", A, B).collect()}
    rows = df.collect()
    assert got == dict(zip((r["doc_id"] for r in rows), plain([r["text"] for r in rows]), strict=True))


def test_edges(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert alignment.align(empty, "id", "text", A, B).collect() == []
    none = spark.createDataFrame([("a", None), ("a", ""), (None, "▁")], "id string, text string")
    assert {columns(r) for r in alignment.align(none, "id", "text", A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
