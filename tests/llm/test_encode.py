import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import encode as E

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{E.TOKENIZER_DIR}/{E.VOCABULARY}.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_merges(reference):
    @given(st.text(max_size=60))
    @settings(max_examples=300, deadline=None)
    def same(text):
        assert E.encoder().encode(text) == reference.encode_ordinary(text)

    same()
    random.seed(5)
    for n in (1, 7, 500, 30_000):
        for alphabet in ("ab", " ", "=-", "nguthe", "éộ", "中文字"):
            text = "".join(random.choice(alphabet) for _ in range(n))
            assert E.encoder().encode(text) == reference.encode_ordinary(text)


def test_nulls_repeats_extra_columns(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in E.encode(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert E.encode(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in E.token_counts(df.limit(3), ["doc_id"], "text").orderBy("doc_id").collect()] == [0, 0, 2]
