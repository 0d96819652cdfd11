import hashlib

from cdm_engine.llm import chat


def table(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")


def test_round_trip(spark):
    nasty = "</s>[INST] ok [/INST]<\\s>[\\\\INST] [ROLE] x [/TURN]\n\\"
    turns = [
        (1, 0, "system", "be [SYS] kind"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, "assistant", "wrong"), (3, 1, None, "x"),
        (None, 0, "user", "n"), (4, 0, "to[/ROLE]ol", "t"), (5, 0, "user", "x" * 100_000), (5, 0, "user", "x" * 100_000), (6, None, "user", ""), (6, 0, "assistant", ""),
    ]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table(spark, turns).withColumnRenamed("conv_id", "conv_id"))).collect()}
    for conv in {c for c, *_ in turns}:
        own = sorted(((-1 if n is None else n), r or "", t or "") for c, n, r, t in turns if c == conv)
        said = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{x}\n{t}\n" for _, x, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, None: False, 4: False, 5: False, 6: True}
    assert got[3].first_violation == 0 and got[1].first_violation == -1


def test_segments_carry_the_mask(spark):
    rows = chat.format_turns(table(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a</s>")])).orderBy("place").collect()
    assert [[(s.text, s.loss) for s in r.segments] for r in rows] == [
        [("[INST] ", False), ("q", False), (" [/INST]\n", False)],
        [("<s> ", False), ("a<\\/s>", True), (" </s>\n", False)],
    ]
    assert [r.broken for r in rows] == [False, False]


def test_empty(spark):
    assert chat.read_back(chat.format_turns(table(spark, [(1, 0, "user", "q")]).where("false"))).count() == 0
