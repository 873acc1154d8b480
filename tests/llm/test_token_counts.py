import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from textlattice.llm import queries, token_counts
from tests.llm import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = token_counts.Counter(MODEL, token_counts.prove(MODEL))


def test_whole_table_against_the_library(spark, smoke):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()}
    got = queries.op2_token_counts(spark, smoke).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        n = len(SP.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁<s>/unk abcE'é\x00\u3000\u200b"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_any_text_against_the_library(text):
    assert COUNTER.count(text) == len(SP.encode(text))


def test_odd_rows(spark):
    want = sorted(((i, len((t or "").encode()), len(SP.encode(t or ""))) for i, t, *_ in cases.ODD), key=repr)
    out = token_counts.count_tokens(spark, cases.odd(spark), MODEL)
    assert cases.rows_of(out, "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(spark, cases.empty(spark), MODEL).collect() == []
