import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from lumaframe.llm import token_count

from .conftest import ordered, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = token_count.load_pieces(PATH)
COUNT = token_count.Counter(PIECES)


def library():
    # its bytes and unknown piece need places in the vocabulary; their score is the lowest there is
    least = min(score for _, score in PIECES)
    extra = [("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256))]
    t = Tokenizer(models.Unigram([*extra, *PIECES], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=False)
    return t


LIBRARY = library()


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids) if text else 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("the of and  tion▁\n", max_size=80) | st.text("aA é日🙂 ", max_size=300), max_size=5))
def test_counts_of_the_library(some):
    for text, (n, _) in zip(some, COUNT(some), strict=True):
        assert n == expected(text), text


@settings(max_examples=100, deadline=None)
@given(st.text("thea onig日", min_size=1, max_size=60))
def test_both_passes_agree(text):
    assert COUNT.many([text, "▁the", text]) == [COUNT.one(text), COUNT.one("▁the"), COUNT.one(text)]


def test_every_row(odd_docs, no_docs):
    got = ordered(token_count.token_counts(odd_docs, PATH).select("doc_id", "n_tokens").collect())
    assert got == sorted(((i, expected(t)) for i, t in texts(odd_docs)), key=repr)
    assert token_count.token_counts(no_docs, PATH).collect() == []


def test_ties_go_to_the_piece_that_starts_first():
    bytes_ = [(f"<0x{b:02X}>", -50.0) for b in range(256)]
    tie = token_count.Counter([*bytes_, ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0)])
    assert tie(["abc"]) == [(3, -4.0)]  # ▁ | ab | c


def test_pieces_it_cannot_cut_for():
    with pytest.raises(ValueError):
        token_count.Counter([("a▁b", 0.0)])


def slow_count(text):
    """(tokens, score) by trying every piece at every place."""
    marked, score, unknown = "▁" + text.replace(" ", "▁"), dict(PIECES), min(s for _, s in PIECES) - 10
    best = [(0.0, 0)] + [(-float("inf"), 0)] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 20), end):
            piece = marked[start:end]
            if piece in score:
                best[end] = max(best[end], (best[start][0] + score[piece], best[start][1] + 1), key=lambda x: x[0])
        if marked[end - 1] not in score and best[end - 1][0] + unknown > best[end][0]:
            best[end] = (best[end - 1][0] + unknown, best[end - 1][1] + len(marked[end - 1].encode()))
    return best[-1][1], best[-1][0]


def test_control_and_byte_pieces_are_ordinary_text():
    names = {p for p, _ in PIECES}
    assert not names & {"<s>", "</s>", "<unk>", "<0x00>", "<0xFF>"} and all(s < 0 for _, s in PIECES)
    for text in ("<s>", "a <s> b </s>", "<0x41> and <unk>", "the <s>the</s> 🙂"):
        (n, score), (slow_n, slow_score) = COUNT([text])[0], slow_count(text)
        assert n == slow_n and abs(score - slow_score) < 1e-6
    assert COUNT(["<s>"])[0][0] > 1
