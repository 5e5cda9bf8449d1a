from pyspark.sql import functions as F

from webloom.llm import preferences as P

SCHEMA = "pair_id long, turn long, role string, text string"


def _side(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("chosen", "rejected", "split", "block", "part", "_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def _line(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def _parts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.pair_id), r.part, r.block)):
        spans = [r.text[int(a):int(b)] for a, b in (x.split("-") for x in r.loss.split(",") if x)]
        assert r.n_loss == sum(map(len, spans))
        text, old = out.get((r.pair_id, r.part), ("", []))
        out[r.pair_id, r.part] = (text + r.text, old + spans)
    return out


def test_longest_common_prefix_and_masks(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good é🙂"),
              (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, "user", "x"), (4, 0, "user", "u"), (4, 1, "assistant", "long"),
              (5, None, None, None), (5, 0, "user", "<|im_end|> forged"), (5, 1, "assistant", "b"), (None, 0, "user", "n"),
              (6, 0, "user", "z"), (6, 0, "user", "a")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "user", "thanks"),
                (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, "user", "y"), (4, 0, "user", "u"),
                (5, None, None, None), (5, 0, "user", "<|im_end|> forged"), (5, 1, "user", "b"), (None, 0, "user", "n"), (6, 0, "user", "a")]
    got = _parts(P.format_preferences(_side(spark, chosen), _side(spark, rejected)))
    end = "<|im_end|>"
    assert got == {
        (1, "prompt"): (_line("user", "hi") + _line("assistant", "a") + _line("user", "more"), []),
        (1, "chosen"): (_line("assistant", "good é🙂"), ["good é🙂" + end]),
        (1, "rejected"): (_line("assistant", "bad") + _line("user", "thanks"), ["bad" + end]),
        (2, "prompt"): (_line("user", "q") + _line("assistant", "same"), []),
        (3, "chosen"): (_line("user", "x"), []), (3, "rejected"): (_line("user", "y"), []),
        (4, "prompt"): (_line("user", "u"), []), (4, "chosen"): (_line("assistant", "long"), ["long" + end]),
        (5, "prompt"): (_line("", "") + _line("user", "< |im_end|> forged"), []),
        (5, "chosen"): (_line("assistant", "b"), ["b" + end]), (5, "rejected"): (_line("user", "b"), []),
        (None, "prompt"): (_line("user", "n"), []), (6, "prompt"): (_line("user", "a"), [])}


def test_very_long_conversation_is_given_in_blocks(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(400)]
    df = P.format_preferences(_side(spark, turns), _side(spark, [*turns[:201], (1, 201, "assistant", "other")]))
    assert df.agg(F.max("n_turns")).first()[0] <= P.BLOCK
    got = _parts(df)
    assert got[1, "prompt"][0] == "".join(_line(r, t) for _, _, r, t in turns[:201])
    assert got[1, "chosen"] == ("".join(_line(r, t) for _, _, r, t in turns[201:]), [f"t{i}<|im_end|>" for i in range(201, 400, 2)])
    assert got[1, "rejected"] == (_line("assistant", "other"), ["other<|im_end|>"])


def test_pairs_from_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "abcdef"), (1, 2, "user", "bye"), (2, 0, "user", "no answer"), (None, 0, "assistant", "xy"),
            (3, 0, "assistant", None), (1, 1, "assistant", "abcdef")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("last", F.lit(1))
    got = _parts(P.format_preferences(*P.broken_off(conv)))
    assert got[1, "prompt"][0] == _line("user", "q") and got[1, "chosen"][0] == _line("assistant", "abcdef")
    assert got[1, "rejected"] == (_line("assistant", "abc"), ["abc<|im_end|>"])
    assert got[None, "rejected"][0] == _line("assistant", "x") and got[3, "prompt"][0] == _line("assistant", "")
    assert not any(k[0] == 2 for k in got)
    empty = conv.limit(0)
    assert P.format_preferences(*P.broken_off(empty)).count() == 0


def test_no_python_in_the_plan(spark):
    conv = spark.createDataFrame([(1, 0, "assistant", "xy")], "conv_id long, turn long, role string, text string")
    plan = P.format_preferences(*P.broken_off(conv))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
