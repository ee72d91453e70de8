import base64

import numpy as np
import pytest
import tiktoken

from ridgeline.llm.token_counts import PATTERN, balanced, split_safely, token_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def whole():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    e = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(e.encode_ordinary(t))


def test_counts_are_those_of_whole_texts(spark, awkward, whole):
    got = [tuple(r) for r in token_counts(awkward, VOCABULARY, batch_bytes=1000, most_bytes=500).collect()]
    want = [(r.doc_id, None if r.text is None else whole(r.text)) for r in awkward.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["", " ", "a" * 50, "a b  c   d\n e " * 9, "don't we're  \t x", "  lead", "x " * 30, "é è  ü ö " * 8])
def test_pieces_count_as_much_as_the_whole(text, whole):
    for most in (1, 3, 10):
        parts = split_safely(text, most)
        assert "".join(parts) == text
        assert sum(map(whole, parts)) == whole(text)


def test_empty_table(spark, awkward):
    assert token_counts(awkward.where("false"), VOCABULARY).count() == 0


def test_batches_hold_about_the_same_bytes():
    sizes = np.random.default_rng(3).integers(0, 900, 500)
    cut = balanced(sizes, 10_000)
    assert [c[0] for c in cut] == [0, *(c[1] for c in cut[:-1])] and cut[-1][1] == 500
    own = [int(sizes[i:j].sum()) for i, j in cut]
    assert max(own) <= 11_000 and max(own) - min(own) <= 1800
    assert balanced(np.zeros(0, int), 5) == [] and balanced(np.array([90, 1]), 5)[-1][1] == 2
