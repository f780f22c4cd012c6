import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumaframe.llm import bpe

from .conftest import ordered, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCAB = bpe.Vocabulary(PATH)
LETTERS = st.characters(max_codepoint=0x2FFFF, exclude_categories=["Cs"])


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_every_row(odd_docs, library):
    want = []
    for i, t in texts(odd_docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert ordered(bpe.encoded(odd_docs, PATH).collect()) == sorted(want, key=repr)


def test_empty(no_docs):
    assert bpe.encoded(no_docs, PATH, digests=True).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=40) | st.text("abTHE'sll 12!ΣσςİÉ́<|endoftext|>\n\x1c\x85", max_size=60) | st.text("ab", max_size=200), max_size=6))
def test_ids_of_the_library(some):
    library = test_ids_of_the_library.library = getattr(test_ids_of_the_library, "library", None) or Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    for text, ids in zip(some, bpe.Encoder(VOCAB)(some), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids, VOCAB) == library.decode(ids, skip_special_tokens=False)


def test_small_cache():
    encode, large = bpe.Encoder(VOCAB, cache=3), bpe.Encoder(VOCAB)
    some = [["one two three four"], ["four five six"], ["one seven"], [None, ""]]
    assert [encode(x) for x in some] == [large(x) for x in some]


def test_every_code_point(library):
    encode = bpe.Encoder(VOCAB)
    for first in range(0, 0x110000, 0x4000):
        some = [f"a{chr(c)}b" for c in range(first, first + 0x4000) if not 0xD800 <= c < 0xE000]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert encode(some) == want, hex(first)
