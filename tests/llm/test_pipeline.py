import corpus_pipeline
from callmeter.llm import line_runs
from test_decontaminate import plain as plain_leaks
from test_line_runs import plain as plain_lines
from test_packing import hold
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        at.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean = at
    assert lines == {i: t for i, _, _, t in plain_lines(list(quality.items()))}
    assert sorted(near) == plain_kept(list(lines.items()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = sorted(near)
    hit = {order[row] for row, _ in plain_leaks([near[i] for i in order], items)}
    assert sorted(clean) == sorted(set(near) - hit)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert hold(packed, [(i, [*t.encode(x, add_special_tokens=False).ids, 1]) for i, x in clean.items()]) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_stages_take_nulls_repeats_extra_columns_and_empty_tables(spark, docs):
    d = docs([(1, "some words of a text that is long enough to be kept"), (1, "some words of a text that is long enough to be kept"), (2, None), (None, ""), (3, "x " * 30_000)])
    for rows in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.written(stage(spark, rows, SF), name)
    assert line_runs.dedup_lines(d).columns == d.columns
