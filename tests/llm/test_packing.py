import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from rcspark.llm import packing


def check(pieces, ids, capacity):
    """Every id of every document lies in one piece; sequences are gapless and not padded."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, own in by_doc.items():
        for p in own:
            part = ids[doc][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert p.doc_tokens == len(ids[doc])
    assert set(by_doc) == set(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at & (at - 1) == 0
    return by_doc


def encoded(rows):
    t = Tokenizer.from_file(packing.default_tokenizer())
    return {i: t.encode(x or "", add_special_tokens=False).ids + [packing.END_ID] for i, x in rows}


def test_words_encode_as_whole_texts():
    rng = random.Random(0)
    parts = ["the", "The", "word", "it's", "don't", "can't", "é", "é", "́", "İ", "ß", "ǅ", "12", "3.5", "...", ",", ".", "a.", "b,", "c.,", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "'S", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    for size in (10**6, 20):
        tok = packing.WordTokenizer(packing.default_tokenizer(), cache_size=size)
        got = list(tok.encode_all([x.encode() for x in texts], budget=200))
        assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_pieces_cover_documents_without_padding(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for fan_in, capacity in ((2, 64), (3, 100), (32, 64)):
        pieces = packing.pack(docs, packing.default_tokenizer(), capacity=capacity, open_windows=3, fan_in=fan_in).collect()
        check(pieces, encoded(rows), capacity)


def test_odd_rows(spark, odd_docs):
    unique = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    by_doc = check(packing.pack(unique, packing.default_tokenizer(), with_ids=True).collect(), encoded(rows), 4096)
    assert sum(p.length for p in by_doc[1]) == 1
    out = packing.pack(odd_docs, packing.default_tokenizer()).collect()
    assert sum(p.length for p in out if p.doc_id is None) == len(encoded([(0, "no id here")])[0])
    assert packing.pack(odd_docs.limit(0), packing.default_tokenizer()).count() == 0
