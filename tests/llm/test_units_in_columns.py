"""Units of a column of texts meet their ids in one table of parts."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from placelens.llm import pieces, token_files, worker
from tokenizers import Tokenizer

ODD = [
    None, "", " ", "a", "é,", " a,b.. c!?", "it's, 'tis' x'", "e\0f, a\0", "\0", " x  y ,", "a\n\nb,\tc\xa0d.", "x\x85, y z", "<|endoftext|>",
    "a<|endoftext|>, b <|endoftext|", "z" * 300 + ", " + "z" * 300, "日本語、 日本,", "\U0001f600! ə! ß? ª, × ÷, 1, 2.5,", "ᲊ, Ა! 𐵐,", "a \n b\n,c", "Été,", "!", ", ,",
]


def made(column: pieces.CutColumns, texts: list) -> list[bytes]:
    return [x.as_py() for ids in column.encode(pa.array(texts, pa.string())) for x in ids]


@pytest.mark.parametrize("group", [1, 300, 12_000_000])
def test_columns_equal_the_library(monkeypatch, group):
    monkeypatch.setattr(pieces, "GROUP_BYTES", group)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(7)
    alphabet = "aeintAÉñß ''  ,.!?\n\t\xa0\x85\x1c　日1<|>"
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(300)]
    texts += [" ".join(draw.choices(["the", "of,", "Été!", "w\nx", "no%%%", "12,"], k=30)) for _ in range(30)]
    column = pieces.CutColumns(token_files._many(tokenizer, "<u2"), most_bytes=20_000)
    for _ in range(2):
        got = made(column, texts)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert all(len(x.encode()) <= pieces.LONG_UNIT for x in column.parts.to_pylist())
        assert sum(pieces.PART_BYTES + len(x) for x in column.parts.to_pylist()) <= 20_000


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""]])
def test_columns_without_text(texts):
    assert made(pieces.CutColumns(lambda parts: [x.encode() for x in parts]), texts) == [b""] * len(texts)


def test_units_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    asked = []

    def make(parts: list[str]) -> list[bytes]:
        asked.extend(parts)
        return [b"id"] * len(parts)

    class Content:
        value = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()

    monkeypatch.setattr(token_files, "_many", lambda *_: make)
    worker.let_go()
    texts = [" ".join(f"word{k:016d}" for k in range(a, a + 100_000)) for a in range(0, 600_000, 100_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    found = [x for out in token_files._encode(Content, "<u2", b"end.")(iter([batch, batch])) for x in out.to_pylist()]
    worker.let_go()
    assert found == [{"doc_id": k, "ids": b"id" * 100_000 + b"end."} for k in [*range(6), *range(6)]]
    assert len(asked) < 600_010


def test_parts_are_made_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(pieces, "MADE", 10)
    asked = []

    def make(parts: list[str]) -> list[bytes]:
        asked.append(len(parts))
        return [part.encode() for part in parts]

    text = " ".join(f"w{k}" for k in range(95))
    assert made(pieces.CutColumns(make), [text]) == [text.encode()]
    assert max(asked) == 10 and sum(asked) == 95


def test_punctuation_is_a_part_of_its_own():
    asked = []

    def make(parts: list[str]) -> list[bytes]:
        asked.extend(parts)
        return [part.encode() for part in parts]

    column = pieces.CutColumns(make)
    text = " ".join(f"w{k}x" for k in range(1000))
    for again in (text, text.replace(" ", ", "), text.replace(" ", "%%% ")):
        assert made(column, [again]) == [again.encode()]
    assert len(asked) == len(set(asked)) < 1005


def test_parts_met_again_stay():
    asked = []

    def make(parts: list[str]) -> list[bytes]:
        asked.extend(parts)
        return [part.encode() for part in parts]

    column = pieces.CutColumns(make, most_bytes=40_000)
    for k in range(50):
        made(column, ["often seen, " + " ".join(f"{k}n{j}" for j in range(100))])
    assert asked.count("often") == asked.count(" seen") == 1
    assert len(column.parts) < 400
