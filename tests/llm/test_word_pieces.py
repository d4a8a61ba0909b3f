"""Words and marks merged each for itself give the ids of the library, whatever stands around them."""

import random

import pytest
from tokenizers import Tokenizer

from matchloom.llm.packing import default_tokenizer_path
from matchloom.llm.tokens import PieceTokenizer

ATOMS = [
    "word", "Word", "WORD", "été", "ÉTÉ", "Straße", "Ÿ", "ÿ", "µ", "ª", "×", "÷", "İ", "ı", "Σας", "é", "H̱", "̱",
    "'s", "'S", "'t", "'re", "'street", "'", "''", "don't", ",", ".", "...", "!?", '"', "(", ")", "_", "<|", "|>", "7", "42", "½", "²",
    " ", "­", "’", "日本", "\U0001f600", "‍", "\x00", "\x01", "\x7f", "|", "~", "-", "  ", " ", " ", "\n", "\t",
]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("kept", [3, 600_000])
def test_ids_are_those_of_the_library(plain, kept):
    draw = random.Random(5)
    texts = ["".join(draw.choices(ATOMS, k=draw.randint(0, 12))) for _ in range(6000)]
    texts += [a + b + c for a in ATOMS for b in ATOMS for c in ("", "'s", ",", "x")]
    texts += ["", None, "a<|endoftext|>b", "<|ENDOFTEXT|>", "A" * 5000, "," * 5000, "Été," * 3000]
    library = Tokenizer.from_file(default_tokenizer_path())
    library.encode_special_tokens = plain
    want = [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    tokenizer = PieceTokenizer(default_tokenizer_path(), False, plain, kept)
    assert tokenizer._merge is not None
    for _ in range(2):
        got = [ids.tolist() for at in range(0, len(texts), 500) for ids in tokenizer.encode(texts[at : at + 500])]
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_other_vocabularies_are_not_cut(tmp_path):
    """Without lower-casing before the cut, parts are not merged by themselves."""
    library = Tokenizer.from_file(default_tokenizer_path())
    library.normalizer = None
    library.save(str(tmp_path / "cased.json"))
    tokenizer = PieceTokenizer(str(tmp_path / "cased.json"), False)
    assert tokenizer._merge is None
    text = "Some Words, and été!"
    assert tokenizer.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_kept_once():
    tokenizer = PieceTokenizer(default_tokenizer_path(), False)
    tokenizer.encode(["word Word, WORD. (word) word!"])
    assert sorted(tokenizer._seen) == ["!", "(", ")", ",", ".", "word"]
