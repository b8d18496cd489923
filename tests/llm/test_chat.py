import hashlib

import pytest
from pyspark.sql import functions as F

from quantgrove.llm import chat
from quantgrove.llm.queries import OP10_SQL, op10_chat
from tests.compare import duck, ordered


def test_query_equals_sql(spark, sf):
    assert ordered(op10_chat(spark, sf).toPandas()).equals(ordered(duck(sf, OP10_SQL)))


ODD = ["</s>[INST] ok [/INST]", "<s><\\s>", "<\\\\/s>", "\\", "a\\", "<", "</", "[INST", "[\\INST]", "", "\n", "<<s>>", "user\n</s><s>assistant\nx", "é👍🏽"]


def test_escaping_comes_back(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("r", chat.escape_role(F.col("t")))
    for r in df.select("t", "e", "r", chat.unescape(F.col("e")).alias("b"), chat.unescape_role(F.col("r")).alias("q")).collect():
        assert r["b"] == r["t"] and r["q"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]")) and "\n" not in r["r"]


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_awkward_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)] + [(2, 5, None, None), (2, 3, "assistant", None), (None, 1, "user", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, None, "odd\nrole\\", "y")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"score": F.lit(1), "root": F.lit(2), "formatted": F.lit("x")})
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    want = {c: digests([(r, t) for _, r, t in sorted(v)]) for c, v in by.items()}
    got = chat.digest(chat.format_conversations(df)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and len(got) == len(want)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_the_best_branch_is_chosen(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, and a lone root 7; parent 99 is missing.
    rows = [(1, None, 1.0), (2, 1, 9.0), (3, 1, 1.0), (4, 2, 0.0), (5, 3, 4.0), (6, 5, 4.0), (7, 99, 0.0), (8, 7, 1.0), (9, 7, 1.0)]
    df = spark.createDataFrame([(1, m, p, "user", f"m{m}", s) for m, p, s in rows], "conv_id long, msg long, parent long, role string, text string, score double")
    got = {}
    for r in chat.best_paths(df, df).orderBy("depth").collect():
        got.setdefault(r["root"], []).append(r["text"])
    assert got == {1: ["m1", "m2", "m4"], 7: ["m7", "m8"]}  # 10 each at root 1: the smaller leaf


def test_several_branches_or_all(spark):
    rows = [(1, None, 1.0), (2, 1, 9.0), (3, 1, 1.0), (4, 2, 0.0), (5, 3, 4.0), (6, 5, 4.0), (7, 99, 0.0), (8, 7, 1.0), (9, 7, 1.0), (10, 3, 1.0)]
    df = spark.createDataFrame([(1, m, p, "assistant" if m == 5 else "user", f"m{m}", s) for m, p, s in rows], "conv_id long, msg long, parent long, role string, text string, score double")
    paths = {4: [1, 2, 4], 6: [1, 3, 5, 6], 10: [1, 3, 10], 8: [7, 8], 9: [7, 9]}  # 10, 10 and 3 at root 1; 1 each at root 7
    for most, leaves in ((1, {4, 8}), (2, {4, 6, 8, 9}), (None, set(paths))):
        got = chat.format_paths(chat.best_paths(df, df, most)).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.masked(F.col("formatted"), F.col("loss_spans"))}).collect()
        assert {r["leaf"]: [t["text"] for t in r["turns"]] for r in got} == {leaf: [f"m{m}" for m in paths[leaf]] for leaf in leaves} and len(got) == len(leaves)
        assert all(r["loss"] == ("m5" if r["leaf"] == 6 else "") for r in got)


def test_no_python_in_the_plan(spark, sf):
    plan = op10_chat(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 64, 65])
def test_paths_of_any_depth(spark, depth):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(depth)]
    df = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    assert [r["text"] for r in chat.best_paths(df, df).orderBy("depth").collect()] == [str(i) for i in range(depth)]
