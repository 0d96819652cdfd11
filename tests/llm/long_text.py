"""python long_text.py OPERATOR KIND MB: seconds and peak memory (MB, beyond the text and what is loaded) of one long text."""

import json
import os
import random
import resource
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import pyarrow as pa

from cdm_engine.llm import _repeats, decontaminate, langid, packing, simhash, simhash_dedup, substring_dedup
from cdm_engine.llm._text import is_space, slices, spans


def text(kind: str, size: int) -> str:
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    if kind == "words":
        out = " ".join(r.choices(words, k=size // 5))
    elif kind == "unbroken":
        out = "".join(r.choices(words, k=size // 4))
    else:  # ideographs, without blanks
        out = "".join(chr(0x4E00 + k) for k in r.choices(range(3000), k=size // 3))
    return out.encode()[:size].decode("utf-8", "ignore")


def run(operator: str, arr: pa.Array) -> None:
    blob = arr[0].as_buffer().to_pybytes()
    if operator == "op1":
        simhash.fingerprint_texts(arr)
    elif operator == "op4":
        import public_tokenizers

        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            encoder = packing.WordEncoder(f.read())
        for _, _, data, off in slices(arr):
            encoder.encode(data, off)
    elif operator == "op5":
        from collections import Counter

        scorer = langid.Scorer(langid.Models({"x": Counter({"abcd": 3, "bad": 2}), "y": Counter({"fig": 2})}))
        for _, _, data, off in scorer.slices(arr, 1 << 19):
            scorer.totals(data, off)
    elif operator == "op7":
        for h in simhash_dedup.hash_pieces(blob, 3):
            simhash_dedup._votes(h, np.array([0, len(h)]))
    elif operator in ("op8", "op9"):
        unit = _repeats.Unit("words", 50) if operator == "op8" else _repeats.Unit("bytes", 200)
        for _, _, data, off in slices(arr):
            for piece, o, _, _ in _repeats.parts(unit, data, off):
                _repeats.anchors(unit, piece, o)
            if operator == "op8":  # all of it is one repeated passage
                starts, lens, _ = spans(~is_space(data), off)
                shard = substring_dedup.Shard()
                for part, a in enumerate(range(0, len(starts), substring_dedup.PART)):
                    b = min(len(starts), a + substring_dedup.PART + 49) - 1
                    lo, hi = int(starts[a]), int(starts[b] + lens[b])
                    shard.add(part, substring_dedup.spelled(data[lo : hi + 8], starts[a : b + 1] - lo, lens[a : b + 1])[0], 1)
                gone, kept = substring_dedup._judged(shard, 2, data, starts, lens, 50)
                assert len(starts) < 50 or gone.all()
                for _ in kept:
                    pass
    else:
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([1]), arr], names=["id", "ka", "kb", "text"])
        for _ in decontaminate._segments(iter([batch])):
            pass


if __name__ == "__main__":
    operator, kind, size = sys.argv[1], sys.argv[2], int(sys.argv[3]) << 20
    run(operator, pa.array([text(kind, 1 << 12)]))  # what is loaded once
    arr = pa.array([text(kind, size)])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    run(operator, arr)
    print(json.dumps({"operator": operator, "kind": kind, "seconds": round(time.perf_counter() - began, 1), "mb": (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10}))
