"""Units are encoded many at once, and those of a group of texts are looked up once."""

import numpy as np
import public_tokenizers
from placelens.llm import pieces, token_files
from tokenizers import Tokenizer

UNITS = [
    " the", " Été,", " 12a", " ...", " a b", "the", "\n", " ", "  x", " x\x85", " x\x1c", " <|endoftext|>", " a<|endoftext|>b", " 'll", " 'tis",
    " it's", " 日本語", " \U0001f600", "<|endoftext|>", " ", " q ", " ́e", " z" * 1 + "z" * 300,
] + [f" w{k}x" for k in range(5000)]


class Counted:
    def __init__(self, inner, longer: int = 0) -> None:
        self.inner, self.strings, self.longer = inner, 0, longer

    def get_vocab(self, with_added_tokens: bool = True) -> dict:
        return {token + "?" * self.longer: k for token, k in self.inner.get_vocab(with_added_tokens=with_added_tokens).items()}

    def get_added_tokens_decoder(self) -> dict:
        return self.inner.get_added_tokens_decoder()

    def encode_batch_fast(self, texts: list, add_special_tokens: bool) -> list:
        self.strings += len(texts)
        return self.inner.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_lines_give_the_ids_of_units():
    inner = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    units = list(dict.fromkeys(UNITS))
    want = [inner.encode(unit, add_special_tokens=False).ids for unit in units]
    counted = Counted(inner)
    assert [np.frombuffer(x, "<u2").tolist() for x in token_files._many(counted, "<u2")(units)] == want
    assert counted.strings < 30
    odd = Counted(inner, longer=1)  # tokens that do not tell their bytes: each unit alone
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files._many(odd, "<u4")(units)] == want


def test_units_of_a_group_are_looked_up_once():
    texts = ["a b c\nd " * 50, None, "", "e\0f a", " x  y ", "a b"]
    asked = []

    def make(units: list[str]) -> list[bytes]:
        asked.append(list(units))
        return [unit.encode() for unit in units]

    for group in (texts, [t for t in texts if "\0" not in (t or "")]):
        asked.clear()
        assert list(pieces.CutTexts(make).encode_all(group)) == [(t or "").encode() for t in group]
        assert len(asked) == 1 and len(set(asked[0])) == len(asked[0])
