"""Tokenizing against the public libraries, binary files and chat formatting by round trip."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from placelens.llm import backtrack_bpe, catalog, chat_format, pieces, token_files
from pyspark.sql import functions as F

BITS = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", " '", "é", "日", "1", "23", "\t", "\x1c", "\x85", "\xa0", "!", "?!",
        "the", " the", "ing", "🙂", "_", "don't", "\r\n", "<|endoftext|>", "​", "theonst"]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n: int = 300, bits=BITS) -> list:
    rng = random.Random(5)
    return [None, "", "ab" * 5000, "z" * 4000, " ", "\n"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(n)]


@given(st.text(max_size=40) | st.lists(st.sampled_from(BITS), max_size=20).map("".join))
@settings(max_examples=600, deadline=None)
def test_bpe_equals_tiktoken(reference, text):
    _, cut = backtrack_bpe._encoder(backtrack_bpe.vocabulary(RANKS), public_tokenizers.PATTERN)
    (ids,) = cut.encode_all([text])
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_query_form(spark, reference):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, id int").repartition(3)
    got = sorted(map(tuple, backtrack_bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for k, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = {r["doc_id"]: r["decoded"] for r in backtrack_bpe.round_trip(df.where("doc_id < 200"), RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[k] == (t or "") for k, t in rows if k is not None and k < 200 and k != 3)
    assert backtrack_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_unit_tables_forget(reference):
    many = [t for t in texts(400) if t]
    table = pieces.CutTexts(lambda units: [u.encode() for u in units], most_bytes=200_000)
    for _ in range(3):
        for text in many:  # a group is one text
            assert list(table.encode_all([text])) == [text.encode()]
            assert sum(map(len, table.new)) < 100_000 + 2 * len(text)
    assert list(table.encode_all(many * 3)) == [t.encode() for t in many * 3]
    assert table._size == sum(pieces._cost(*x) for x in table.new.items())


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65530, 65540), max_size=60))
@settings(max_examples=300, deadline=None)
def test_packed_values_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


@pytest.mark.parametrize("shuffled", [False, True])
def test_token_files_equal_library(spark, tmp_path, shuffled):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    df = df.repartition(5) if shuffled else df.coalesce(4)
    folder = str(tmp_path / "files")
    token_files.write_token_files(df, folder, JSON, 50_257, 2, block_ids=500)
    assert spark.read.parquet(f"{folder}/blocks").count() > 3
    got = sorted(map(tuple, token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in ordered]
    for (_, text, _), (_, at, n, ids) in zip(ordered, got, strict=True):
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (at, n) == (start, len(ids))
        start += n
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_files.check_token_files(spark, folder).collect()}
    assert all(crc[r[0]] == zlib.crc32(np.array(r[3], "<u4").tobytes()) for r in got)


def test_token_files_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(df, str(tmp_path / "f"), JSON, 50_257, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "f")).count() == 0


@given(st.lists(st.tuples(st.text(max_size=8), st.text("<|im_startend>\\-n\na", max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    assert chat_format.parse_chatml(chat_format.chatml(turns)) == turns
    out, at = chat_format.chatml(turns), 0
    for (_, text), span, start, end in chat_format.turn_spans(iter(turns), chat_format.chatml, window=4):
        assert out[at:at + len(span)] == span
        assert chat_format.unescape(span[start:end]) == text
        at += len(span)
    assert at == len(out)


def last_only(turns):
    return f"{len(turns)}:" + chat_format.chatml(turns)


def needs_first(turns):
    return "".join(f"<{turns[0][0]}>{role}:{text};" for role, text in turns)


@pytest.mark.parametrize("template", [last_only, needs_first])
def test_rewriting_templates_are_found(template):
    turns = [(f"r{k}", "x") for k in range(9)]
    with pytest.raises(chat_format.HistoryRewritten):
        list(chat_format.turn_spans(iter(turns), template, window=4))


def begins(turns):
    """Depends on the first turn and on numbers, and never rewrites."""
    return "<s>" + "".join(f"[{k} {turns[0][0]}]{role}:{text};" for k, (role, text) in enumerate(turns))


def keeps_last(turns):
    return "".join(f"{role}:{text};" for role, text in turns[-100:])


def edits_late(turns):
    return "".join(f"{role}:{text};" for role, text in ([("r0", "edited"), *turns[1:]] if len(turns) >= 100 else turns))


def test_long_conversations_are_rendered_from_the_first_turn():
    turns = [(f"r{k}", f"text {k}") for k in range(150)]
    found = list(chat_format.turn_spans(iter(turns), begins))
    assert "<s>" + "".join(span for _, span, _, _ in found) == begins(turns)
    assert [span[a:b] for _, span, a, b in found] == [text for _, text in turns]
    for template in (keeps_last, edits_late):
        with pytest.raises(chat_format.HistoryRewritten):
            list(chat_format.turn_spans(iter(turns), template))
    assert "".join(x[1] for x in chat_format.turn_spans(iter(turns), chat_format.chatml)) == chat_format.chatml(turns)


def test_chat_queries(spark):
    rows = [(k % 7 if k % 7 else None, k % 11, ["user", "assistant", None][k % 3], None if k % 5 == 0 else f"<|im_end|>{k}\n", 1) for k in range(200)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    got = {r["conv_id"]: r for r in chat_format.chatml_digests(df).collect()}
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        joined = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(joined.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())

    def by_length(turns):
        return f"{len(turns)}:" + "".join(f"{role}:{text};" for role, text in turns)

    marked = chat_format.format_conversations(df, by_length, window=4)
    assert marked.where(F.col("rewrites") & F.col("formatted").isNull()).count() == 7
    assert chat_format.chatml_digests(df.limit(0)).count() == 0


def test_hostile_conversation(spark):
    row = catalog.op9_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = catalog.HOSTILE
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
