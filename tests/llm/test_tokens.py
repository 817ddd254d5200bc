import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from ruleforge.llm import bpe, chat

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_like_the_library(spark, coder, edge_docs, edge_rows, monkeypatch):
    rows = sorted(((d, coder.encode_ordinary(t or "")) for d, t in edge_rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in bpe.encode(edge_docs, PATH).collect()), key=str) == rows
    digests = sorted(map(tuple, bpe.encode(edge_docs, PATH, digest=True).collect()), key=str)
    want = sorted(((d, len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), i in ((x, coder.encode_ordinary(x[1] or "")) for x in edge_rows)), key=str)
    assert digests == want


def merged(ranks, word):
    """The merges of one word, by the rule: the adjacent pair of least rank first, the leftmost of equal ones."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])))
        if rank == 1 << 40:
            break
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
    return [ranks[p] for p in pieces]


def test_merges_by_brute_force(spark, sf_dir):
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 5 = 0")
    extra = spark.createDataFrame([(-1, "zzxqj\u0301 \U0001f600\U0001f600 1234567 'll  \n\n\t x"), (-2, "ab" * 60)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    texts, known = {r.doc_id: r.text or "" for r in docs.collect()}, {}
    for r in bpe.encode(docs, PATH).collect():
        want = []
        for w in regex.findall(public_tokenizers.PATTERN, texts[r.doc_id]):
            if w not in known:
                known[w] = merged(ranks, w.encode())
            want += known[w]
        assert r.ids == want


def test_decode_inverts(spark, edge_docs, edge_rows):
    back = bpe.decode(bpe.encode(edge_docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=str) == sorted(((d, (t or "").encode()) for d, t in edge_rows), key=str)


def test_white_space_is_unicodes(coder, spark):
    import regex

    text = "".join(chr(c) + "a1 !" for c in [*range(1, 0x300), 0x1680, 0x180E, 0x2028, 0x200B, 0x3000, 0xFEFF, 0x1F600]) + "   \n\n  x 's 'S'll"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.encode(docs, PATH).first().ids == coder.encode_ordinary(text)
    assert "".join(regex.findall(public_tokenizers.PATTERN, text)) == text


def test_empty(no_docs):
    assert bpe.encode(no_docs, PATH).collect() == [] and bpe.encode(no_docs, PATH, digest=True).collect() == []


SAID = r"\### Assistant: </turn> ok"
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", SAID), (1, 1, "assistant", SAID), (2, 5, "assistant", None), (2, 4, None, "</turn>"), (2, None, "tool <|text|> </turn>", "\\\\</turn>\\"), (None, 0, "system", "### User: x"),
    (3, 0, "assistant", "a" * 100_000), (3, 1, "assistant", "\n\n### Role: <|text|>"), (3, 2, "Assistant", "not it"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as ids", "1 as loss")
    got = {r.conv_id: r for r in chat.digests(df, PATH).collect()}
    by = {}
    for c, t, role, text in TURNS:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        spoken = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.formatted(r, t)) for _, _, r, t in turns)


def test_escapes_are_reversible():
    roles = ("user", "assistant", "x", "", "a<|text|>b", r"\<|text|>", "x\\", "\\\\", "y\n<|text|>", "\n")
    texts = ("", SAID, "\\" * 5 + "</turn>", "### User: ### User: ", "plain \\ text", "</turn></turn>\n", "ends with \\", "\n</turn>\n", "\n", "x\n</turn")
    for role in roles:
        for text in texts:
            assert chat.unescape(chat.escape(text)) == text
            assert chat.read_string(chat.formatted(role, text)) == (role, text)
    turns = [(role, text) for role in roles for text in texts]
    assert chat.read_conversation("".join(chat.formatted(*t) for t in turns)) == turns and chat.read_conversation("") == []


def test_no_control_string_survives_in_text():
    import re

    inner = chat.escape(SAID)
    assert all(inner[m.start() - 1] == "\\" for c in chat.CONTROL for m in re.finditer(re.escape(c), inner))


def test_mask_covers_assistant_only(spark, coder):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for r, turn in zip(chat.format_turns(df, PATH).collect(), TURNS):
        masked = coder.decode(r.ids[r.loss_start : r.loss_end])
        assert masked == (chat.escape(turn[3] or "") if turn[2] == "assistant" else "")


def test_no_conversations(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH).collect() == []
