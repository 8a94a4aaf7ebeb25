import hashlib
import random

from callmeter.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, leaf string"
TREE = "conv_id long, node long, parent long, role string, text string, score double"


def plain(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    parts = ["\\", "#", "###", ":", ": ", "</turn>", "<", "/turn>", "\n", " </turn>\n", "### assistant: ", "é", "a", "$1", "\\n"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "s string").withColumn("e", chat.escape(chat.F.col("s")))
    assert df.filter("contains(e, '</turn>') OR contains(e, '###')").count() == 0
    assert df.filter(chat.unescape(chat.F.col("e")) != chat.F.col("s")).count() == 0


def test_digest_against_plain_turns(spark):
    rng = random.Random(2)
    rows = []
    for c in (1, 2, 3, -7, None):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys: tem", None]), rng.choice([None, "", queries.HOSTILE, "hi\nthere", "x" * 5000, "é: #1 \\"]), "x"))
    rows += [(4, None, "user", "no turn", "x"), (4, 0, "assistant", "first", "x"), (4, 0, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(df).collect()}
    assert got == {c: plain(t) for c, t in want.items()}
    assert chat.digest(df.limit(0)).count() == 0


def test_branches_of_a_tree_ranked_by_score(spark):
    nodes = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "a", 1.0), (1, 12, 10, "assistant", "b", 5.0), (1, 13, 11, "user", "c", 2.0),
             (1, 14, 13, "assistant", "d", None), (2, 20, 99, "user", "lost parent", None), (3, 30, 31, "user", "cycle", 1.0), (3, 31, 30, "user", "cycle", 1.0)]
    df = spark.createDataFrame(nodes, TREE)
    got = {(r.conv_id, r["rank"]): (r.leaf, r.n_turns, r.formatted, [(m.start, m.length) for m in r.loss_mask]) for r in chat.format_trees(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert got[1, 1][:3] == (12, 2, "### user: q </turn>\n### assistant: b </turn>\n")
    assert got[1, 2][:2] == (14, 4)
    text = got[1, 2][2]
    assert [text[s - 1:s - 1 + n] for s, n in got[1, 2][3]] == ["a", "d"]
    assert chat.format_trees(df, branches=1).count() == 2


def test_deep_lines_take_a_logarithm_of_joins(spark):
    df = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)], TREE)
    paths = chat.leaf_paths(df)
    assert sorted((r.leaf, 299 - r.back, r.node) for r in paths.collect()) == [(299, i, i) for i in range(300)]


def test_main_path_without_python(spark):
    plan = chat.digest(spark.createDataFrame([(1, 0, "user", "x", "y")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
