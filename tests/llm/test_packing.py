import random
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from cdm_engine.llm import packing
from cdm_engine.llm._text import slices

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_give_the_tokenizers_ids(tokenizer):
    r = random.Random(3)
    bits = "é É ß × ÷ Ÿ Σ ς ' 's it's 'S don’t The the 9 12 ½ ٣ _ - ... ! \x0b \x0c \x85 　 ́ å 😀 漢字 ﬁ İ \x00 \x1c \x7f a Z <|endoftext|> @".split(" ") + [" ", "\n", "\t", " ", "\xa0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", "x" * 5000]
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    got = []
    for _, _, data, off in slices(pa.array(texts), 1 << 12):
        flat, ptr = encoder.encode(data, off)
        got += [flat[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_and_places(rows, tokenizer):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["alpha", "be", "gamma-ray", "É"]) for _ in range(r.choice([0, 1, 5, 5, 5, 40, 130])))) for i in range(200)] + [(500, None), (500, None), (None, "x")]
    got = packing.pack(rows(docs).withColumn("task", pa_free()), PATH, capacity=64, keep_ids=True).collect()
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(struct.pack(f"<{len(ids[s : s + 64])}I", *ids[s : s + 64])), ids[s : s + 64]) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, x.ids) for x in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.1 * sum(x.length for x in got) / 64 + 1


def pa_free():
    from pyspark.sql import functions as F

    return F.lit("a column with a clashing name")


@pytest.mark.parametrize("seed", range(5))
def test_plan_fills_like_best_fit(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 100): r.randint(1, 60) for _ in range(30)}
    p = packing.plan(histogram, 100)
    room, need = [], 0
    for length in sorted(histogram, reverse=True):  # best fit, piece by piece
        for _ in range(histogram[length]):
            k = min((k for k in range(len(room)) if room[k] >= length), key=room.__getitem__, default=None)
            if k is None:
                room.append(100 - length)
            else:
                room[k] -= length
            need += length
    assert p.sequences == len(room) and p.sequences * 100 >= need
    import numpy as np

    used = defaultdict(int)
    for length, n in histogram.items():
        seq, _ = p.place(np.full(n, length), np.arange(n))
        for s in seq.tolist():
            used[s] += length
    assert max(used.values()) <= 100


def test_empty_table(rows):
    assert packing.pack(rows([(1, "a")]).where("false"), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    with open(PATH, encoding="utf-8") as f:
        assert packing.by_words(f.read()) and not encoder.by_words
    texts = ["Two  words", "", "é 漢字 <|endoftext|>", "x" * 3000, "it's\n\tthere "]
    got = []
    for _, _, data, off in slices(pa.array(texts), 16):
        flat, ptr = encoder.encode(data, off)
        got += [flat[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
