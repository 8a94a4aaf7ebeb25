from callmeter.llm import line_runs

LONG = "a line that many documents share, in full length"
OTHER = "another line that only some documents hold, ok"


def plain(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i if i is not None else -(2**63)) == (i if i is not None else -(2**63))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(d, **options):
    return sorted(((r.doc_id, r["__lines"], len(r["__dropped"]), r.text or "") for r in line_runs.with_kept(d, **options).collect()), key=str)


def test_against_brute_force(spark, docs):
    rows = [(i, f"{LONG}\nown {i}\n\t{LONG.upper()} \n{OTHER if i < 4 else ''}") for i in range(9)]
    rows += [(9, None), (10, ""), (11, "É" + LONG), (12, "é" + LONG), (3, "second row of three\n" + OTHER), (3, "second row of three\n" + OTHER),
             (None, LONG), (None, "no id\n" + LONG), (20, "\n" + LONG + "\n"), (21, "\n".join(["short"] * 5000 + [LONG]))]
    d = docs(rows)
    for options in ({}, {"batches": 1}, {"batches": 7, "fanout": 2}):
        assert result(d, **options) == plain(rows)
    assert line_runs.dedup_lines(d).columns == d.columns


def test_limits_of_length_and_count(spark, docs):
    line = "x" * 40
    rows = [(i, line + "\n" + "y" * 39) for i in range(5)]
    assert result(docs(rows)) == plain(rows)
    assert sum(r[2] for r in plain(rows)) == 4
    assert sum(r[2] for r in result(docs(rows[:4]))) == 0


def test_fresh_lines_are_those_in_no_run(spark, docs):
    runs = line_runs.LineRuns(spark, fanout=2)
    first, second = (line_runs.keyed_lines(docs([(i, t)])) for i, t in ((1, LONG), (2, LONG + "\n" + OTHER)))
    runs.add(first)
    assert runs.fresh(second).count() == 1
    runs.add(second)
    assert len(runs.levels[0]) == 0 and len(runs.levels[1]) == 1
    assert runs.levels[1][0].filter("n_docs = 2 and keeper = 2").count() == 1


def test_empty_table_and_main_path_without_python(spark, docs):
    d = docs([(1, LONG)])
    assert line_runs.digest(d.limit(0)).count() == 0
    plan = line_runs.digest(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
