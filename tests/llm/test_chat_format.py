import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recfeat.llm import chat_format as c

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
BOTH = c.Formatter(PATH), c.Formatter(PATH, **RANKS)
PIECES = st.lists(st.sampled_from(["<|", "|>", "<|end|>", "\\", "\n", " ", "a", "é", "😀", "<|assistant|>", "<", "<|endoftext|>", ".", "</turn>", "́", "<|text|>"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "<|x", "a\\|"]), PIECES), max_size=6)


@pytest.fixture(scope="module", params=[{}, RANKS], ids=["tokenizer file", "rank file"])
def make(request):
    return c.Formatter(PATH, **request.param)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_rank_file_and_tokenizer_file_agree(turns):
    (a, x), (b, y) = (f.encode(c.render(turns)[0]) for f in BOTH)
    assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_round_trip(make, turns):
    made = make(turns)
    assert c.read_back(made["formatted"]) == turns
    assert c.masked_text(made["formatted"], made["offsets"], made["mask"]) == [t for r, t in turns if r == "assistant" and t]


def test_end_marks_can_be_learned():
    made = c.Formatter(PATH, learn_end=True)([("user", "a"), ("assistant", ""), ("assistant", "b")])
    assert c.masked_text(made["formatted"], made["offsets"], made["mask"]) == ["", "b"] and made["mask"].sum() == 3


def test_mask_by_binary_search_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 20))
        offsets = np.stack([cuts[:-1], cuts[1:]], axis=1)
        ends = np.unique(rng.integers(0, 60, 8))
        spans = [(int(a), int(b)) for a, b in zip(ends[::2], ends[1::2])]
        assert c.token_mask(offsets, spans).tolist() == [any(a < e and b > s for s, e in spans) for a, b in offsets.tolist()]


def test_conversations(spark):
    data = [(1, 1, "assistant", "x\\y"), (1, 0, "user", None), (None, None, None, "z"), (2, 0, "user", "q"), (2, 0, "user", "q"), (3, 5, "tool", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in c.format_conversations(df, PATH, **RANKS).collect()}
    assert got == {r.conv_id: r for r in c.format_conversations(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\n\nassistant\nx\\y\n"), 3, sha("x\\y"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (2, sha("user\nq\nuser\nq\n"), 0)
    assert got[None].n_turns == 1 and got[3].turns_sha256 == sha("tool\n\n") and len(got[1].ids) == len(got[1].loss_mask)
    assert got[1].formatted_chars == len(got[1].formatted) and c.format_conversations(df.limit(0), PATH).count() == 0


def test_a_very_long_turn(make):
    made = make([("user", "u"), ("assistant", "word " * 200_000)])
    assert "".join(c.masked_text(made["formatted"], made["offsets"], made["mask"])) == "word " * 200_000
