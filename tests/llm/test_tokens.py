import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tradepost.llm import byte_bpe, packing, token_files
from tradepost.llm.chunks import ChunkEncoder, document_encoder, library_encoder, text_encoder, word_end_encoder
from tradepost.llm.scratch import Scratch

from .conftest import words

ODD = [
    "", " ", "  a", "a  b   c", "x \n y\t z \r\n\r\n q", "é ́x é ΑΣ ΣΑΣ. σας ς", "7 77 a7b 7", "don't we'll I'M", "<|endoftext|> <|startoftext|>x <unk> <s>",
    " a  b c", "\x1c a\x1cb \x1c", "a​b", "日本語 テキスト 한국어", "🙂🙂 a🙂", " lead", "trail ", "a\x85b", "\n\n\n a", "▁a ▁", "\x00\x01 \x00", "İI ẞß ǅ", "x" * 3000,
]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_the_library_does(name):
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    texts = ODD + [words(300, 5), " ".join(ODD)]
    expected = [packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert library_encoder(P.path(name))(texts) == expected
    assert text_encoder(P.path(name))(texts) == expected


def test_a_small_memory_gives_the_same_ids():
    texts = [words(400, i) for i in range(20)] * 2
    encoder = library_encoder(P.path("byte_bpe_50k.json"))
    assert ChunkEncoder(encoder.encode, remembered=3, at_once=500)(texts) == encoder(texts)


def test_pieces_and_places(odd_docs, odd_rows, spark):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    keep = Scratch(spark, "test")
    cut = keep.cut(packing.pieces(odd_docs, P.path("byte_bpe_50k.json"), capacity=64))
    placed = packing.place(cut, 64, keep).collect()
    by_row = defaultdict(list)
    for r in cut.collect():
        by_row[r["row"]].append(r)
    texts = defaultdict(list)
    for i, t in odd_rows:
        texts[i].append(packed(whole.encode(t or "", add_special_tokens=False).ids + [2]))
    assert len(by_row) == len(odd_rows)
    for rows in by_row.values():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert all(r["length"] == 64 for r in rows[1:]) and 1 <= rows[0]["length"] <= 64
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        texts[rows[0]["id"]].remove(b"".join(bytes(r["ids"]) for r in rows))
    assert not any(texts.values())
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(placed) == cut.count()
    total = sum(r["length"] for r in placed)
    assert -(-total // 64) <= len(sequences) <= -(-total // 64) + 3
    ids = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(cut, spark.createDataFrame(placed)).collect()}
    assert set(ids) == set(sequences) and all(len(ids[s]) == 4 * sum(n for _, n in sequences[s]) for s in ids)


def test_pack_query_columns(odd_docs, odd_rows):
    got = packing.pack(odd_docs, P.path("byte_bpe_50k.json")).collect()
    empty = [r for r in got if r["length"] == 1]
    assert len(empty) >= 3 and {r["ids_crc32"] for r in empty if r["id"] in (22, 23)} == {zlib.crc32(packed([2]))}


@pytest.mark.parametrize("lengths", [[600] * 10, [512] * 9, [1023, 1, 1, 1], [300, 300, 300, 124] * 50, list(range(1, 1024)) * 3, [1024] * 4, [7]])
def test_plans_place_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.make_plan(counts, 1024)
    placed = np.zeros(1025, np.int64)
    for config, times in plan:
        assert sum(config) <= 1024 and times > 0
        placed += times * np.bincount(config, minlength=1025)
    assert (placed == counts).all()
    sequences = sum(times for _, times in plan)
    assert sequences <= sum(t for _, t in packing._best_fit(counts, 1024))
    if lengths[:4] == [300, 300, 300, 124]:
        assert sequences == 50  # the full configuration, which best fit alone may miss
    rows = packing.plan_rows(plan)
    taken = set()
    for length, first, end, copies, sequence, offset in rows:
        for number in range(first, end):
            k = number - first
            place = (sequence + k // copies, offset + k % copies * length)
            assert place not in taken
            taken.add(place)
    assert len(taken) == len(lengths)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        prices = np.zeros(31)
        some = rng.choice(np.arange(1, 31), 6, replace=False)
        prices[some] = rng.random(6)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - n] + prices[n] for n in some if n <= c)])
        got = packing.knapsack(prices, 30)
        assert sum(got) <= 30 and sum(prices[list(got)]) == pytest.approx(best[30])


def test_no_rows_no_pieces(no_docs):
    assert packing.pack(no_docs, P.path("byte_bpe_50k.json")).collect() == []


def test_token_files_round_trip(odd_docs, odd_rows, spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_BYTES", 2000)
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    folder = Scratch(spark, "test").path
    token_files.write_files(odd_docs, P.path("word_bpe_49k.json"), folder)
    got = token_files.read_files(spark, folder).collect()
    want = defaultdict(list)
    for i, t in odd_rows:
        want[i].append(packed(whole.encode(t or "", add_special_tokens=False).ids + [2]))
    line = sorted(got, key=lambda r: r["start"])
    ids = [-1 if r["id"] is None else r["id"] for r in line]
    assert ids == sorted(ids) and len(ids) == len(odd_rows)
    start = 0
    for r in line:
        want[r["id"]].remove(bytes(r["ids"]))
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    segments = spark.read.parquet(f"{folder}/segments").collect()
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    assert len(segments) > 2
    opened = token_files.Segment(bytes(segments[0]["body"]), dictionary)
    assert opened.ids(opened.n - 1)[-4:] == packed([2])  # a single document
    with pytest.raises(ValueError):
        token_files.Segment(bytes(segments[0]["body"]), dictionary + b"x")


def test_large_ids_are_kept_whole():
    for ids in ([], [1, 65535], [65536, 2**32 - 1, 0]):
        assert token_files.widened(token_files.narrow(packed(ids))) == packed(ids)


def test_no_rows_no_files(no_docs):
    assert token_files.token_files(no_docs, P.path("word_bpe_49k.json")).collect() == []


MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def test_ranks_through_sentencepiece():
    ranks = byte_bpe.read_ranks(MULTI)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.ByteBpe(MULTI, P.PATTERN)
    texts = ODD + [words(300, 6), bytes(range(256)).decode("latin-1"), "".join(map(chr, range(0x300, 0x2000, 3)))]
    got = codec.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]


def test_gaps_in_ranks(tmp_path):
    import base64

    entries = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" x"]
    path = tmp_path / "small"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (i * 2) for i, t in enumerate(entries)))
    codec = byte_bpe.ByteBpe(str(path), P.PATTERN)
    assert np.frombuffer(codec.encode(["abcab xé"])[0], "<u4").tolist() == [514, 512, 516, 2 * 0xC3, 2 * 0xA9]
    assert codec.decode(codec.encode(["abcab xé"])[0]) == "abcab xé".encode()


def test_round_trip_of_documents(odd_docs, odd_rows):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(odd_docs, MULTI, P.PATTERN), MULTI, P.PATTERN).collect()
    want = sorted((-1 if i is None else i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_rows)
    assert sorted((-1 if r["id"] is None else r["id"], r["ids"], bytes(r["decoded"])) for r in got) == want


def test_no_rows_no_ids(no_docs):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, MULTI, P.PATTERN), MULTI, P.PATTERN).collect() == []


ADDED = [
    "a <|endoftext|> b", "<|endoftext|>", "<|startoftext|><|endoftext|><|endoftext|>x", "  <|endoftext|>  \n<|startoftext|> y  ", "<|ENDOFTEXT|> <|endoftext", "É<|endoftext|>́x İ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_unmodified_library_does(name):
    whole = Tokenizer.from_file(P.path(name))
    texts = ODD + ADDED + [words(300, 5), " ".join(ODD + ADDED), "".join(ADDED)]
    assert document_encoder(P.path(name))(texts) == [packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("flag", ["lstrip", "rstrip", "single_word", "normalized"])
def test_added_tokens_with_rules_of_their_own(flag, tmp_path):
    import json

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        parts = json.load(file)
    parts["added_tokens"][-1][flag] = True
    path = str(tmp_path / "file.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(parts, file)
    whole = Tokenizer.from_file(path)
    assert document_encoder(path)(ADDED) == [packed(whole.encode(t, add_special_tokens=False).ids) for t in ADDED]


def test_operators_turn_added_tokens_into_ids(make_docs, spark):
    docs = make_docs(list(enumerate(ADDED)))
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [packed(whole.encode(t, add_special_tokens=False).ids + [2]) for t in ADDED]
    got = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    assert {r["id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(w) // 4, zlib.crc32(w)) for i, w in enumerate(want)}
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [packed(whole.encode(t, add_special_tokens=False).ids + [2]) for t in ADDED]
    files = sorted(token_files.token_files(docs, P.path("word_bpe_49k.json")).collect(), key=lambda r: r["id"])
    assert [bytes(r["ids"]) for r in files] == want
    assert [r["start"] for r in files] == [sum(len(w) // 4 for w in want[:i]) for i in range(len(want))]


def test_words_with_end_marks_as_the_unmodified_library_does():
    import random

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng, texts = random.Random(9), []
    pools = [range(32, 0x180), range(0x180, 0x3000), range(0x10000, 0x1FFFF), "abc ABC'sZz \t\n09\u00bd\u00b2_\u0130\u017f\u212b"]
    for _ in range(3000):
        picks = (rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40)))
        texts.append("".join(c if isinstance(c, str) else chr(c) for c in picks))
    texts += ODD + ADDED + ["", "Z", "zZz Z", "'S'll don't"]
    plain = [t for t in texts if "<|" not in t]
    assert word_end_encoder(path)(plain) == [packed(whole.encode(t, add_special_tokens=False).ids) for t in plain]
    assert word_end_encoder(path)(plain, at_once=10) == word_end_encoder(path)(plain)
    assert word_end_encoder(P.path("byte_bpe_50k.json")) is None


def test_a_small_memory_of_words_gives_the_same_ids():
    from tradepost.llm.chunks import _Words

    def encode(words):
        return np.frombuffer("".join(words).encode(), np.uint8).astype("<u4"), np.array([len(w) for w in words])

    words_held = _Words(encode, remembered=3)
    for some in (["ab", "c", "ab"], [], ["c", "defg", "h", "ab"], ["h", "x", "ab", "ab"]):
        ids, ends = words_held(some)
        assert bytes(ids.astype(np.uint8)).decode() == "".join(some) and ends.tolist() == np.cumsum([0, *map(len, some)]).tolist()
