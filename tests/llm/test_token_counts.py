import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callmeter.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sizes(library, texts):
    return [len(e) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_table(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(zip([r.doc_id for r in table], [len((r.text or "").encode()) for r in table], sizes(library, [r.text for r in table])))
    got = queries.QUERIES["op12_token_counts"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


HARD = ["", " ", "\n\n\n", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", " 's 'S I'll we've  don't''s 've", "a   b\t\tc \n d  ", "ünïcödé Straße ÀÉ", "日本語のテキスト、漢字 한국어 русский",
        "emoji 👩‍👩‍👧 🎉🎉 ①② ½ ٣٤", "͸՘a ᲉꟋ", "\U00010940\U000323b0 x", "\x00\x01\x1f\x7f\x85\xa0   x", "=" * 5000, "word " * 30_000, "x" * 20_000, "1234567 12,345.67e-9", "\r\n\r\n a​b", "café é́"]


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_hard_texts_for_any_choice_of_broadcast(docs, library, most):
    texts = [*HARD, None, HARD[3], HARD[3]]
    got = token_counts.count_tokens(docs([(k if k % 4 else None, t) for k, t in enumerate(texts)]), most=most).collect()
    want = [(k if k % 4 else None, len((t or "").encode()), n) for (k, t), n in zip(enumerate(texts), sizes(library, texts))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)


def test_random_characters(docs, library):
    rng = random.Random(4)
    def text():
        return "".join(chr(rng.choice([rng.randrange(32, 127), 32, 10, rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(200)))
    texts = [text() for _ in range(300)]
    got = token_counts.count_tokens(docs(enumerate(texts)), most=20).collect()
    assert [r.n_tokens for r in sorted(got)] == sizes(library, texts)


def test_a_sample_smaller_than_the_table_changes_nothing(docs, library):
    texts = [f"common words and rare{k} {k * 977}" for k in range(400)]
    got = token_counts.count_tokens(docs(enumerate(texts)), sample=20, most=10).collect()
    assert [r.n_tokens for r in sorted(got)] == sizes(library, texts)


def test_fast_pattern_agrees_with_the_tokenizer_on_every_stable_code_point(library):
    cut = token_counts.Pretokens(PATH)
    stable = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not cut.unstable(chr(c))]
    assert len(stable) > 30_000
    for k in range(0, len(stable), 50):
        text = "".join(f"a{c}1{c}.{c} {c}\n" for c in stable[k:k + 50])
        assert cut.fast(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_each_distinct_pretoken_is_cut_into_pieces_once(monkeypatch):
    import pyarrow as pa
    seen = []
    monkeypatch.setattr(token_counts.Pretokens, "sizes", lambda self, pieces: seen.extend(pieces) or [1] * len(pieces))
    rows = ["a"] * 3 + ["b"] * 4
    batches = [pa.RecordBatch.from_pydict({"row": pa.array([1] * len(p)), "piece": pa.array(p, pa.string()), "n": pa.array([1] * len(p))}) for p in ([None, None, *rows], ["b", "c"], ["c"])]
    out = list(token_counts._measured(None)(iter(batches)))
    assert seen == ["a", "b", "c"] and sum(b.num_rows for b in out) == 12


def test_other_columns_and_no_rows(spark, docs):
    d = docs([(1, "one two")]).withColumn("row", token_counts.F.lit("clash")).withColumn("n", token_counts.F.lit(2)).withColumn("piece", token_counts.F.lit(2))
    assert [tuple(r) for r in token_counts.count_tokens(d).collect()] == [(1, 7, 2, False)]
    assert token_counts.count_tokens(d, limit=1).collect()[0].over_limit
    assert token_counts.count_tokens(d.limit(0)).collect() == []


def test_a_tokenizer_that_normalizes_is_refused():
    with pytest.raises(ValueError):
        token_counts.Pretokens(public_tokenizers.path("word_bpe_49k.json"))
