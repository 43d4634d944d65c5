import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tradepost.llm import alignment
from tradepost.llm.alignment import BLANK, align_ends
from tradepost.llm.queries import QUERIES

from .conftest import words

SF = "/root/testdata/sf0.001"
WHOLE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
WHOLE.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


BOTH = alignment.tokenizer_pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def brute_links(a, b):
    """Overlapping stretches by comparing every two."""
    starts_a, starts_b = [0, *a[:-1]], [0, *b[:-1]]
    return [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]


def brute_groups(a, b):
    common = sorted(set(a) & set(b))
    return [a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common]


def test_ends_equal_brute_force():
    rng = random.Random(12)
    for _ in range(400):
        n = rng.randint(1, 90)
        cuts = set(rng.sample(range(1, n + 1), rng.randint(0, n))) | {n}
        a = sorted(cuts | {n} if rng.random() < 0.3 else {c for c in cuts if rng.random() < 0.9} | {n})
        b = sorted({c for c in cuts if rng.random() < 0.9} | set(rng.sample(range(1, n + 1), rng.randint(0, n // 4))) | {n})
        assert [x.tolist() for x in align_ends(np.array(a), np.array(b))] == list(brute_groups(a, b))
        links_a, links_b = alignment.overlaps(np.array(a), np.array(b))
        assert list(zip(links_a, links_b)) == sorted(brute_links(a, b))


@pytest.mark.parametrize("ahead", [1, 2, 3, 4, 7, 8, 9, 1000])
def test_one_on_one_stretches_are_jumped_whole(ahead):
    a = list(range(1, ahead + 1))
    assert alignment.irregular_groups(a, a) == []
    more = [ahead + 7, ahead + 9]
    assert alignment.irregular_groups(a + more, a + more[1:]) == [ahead, ahead, ahead + 1, ahead]
    assert alignment.irregular_groups([2, *(x + 5 for x in a), 4000], [1, 2, *(x + 5 for x in a), 3000, 4000]) == [0, 0, 0, 1, ahead + 1, ahead + 2, ahead + 1, ahead + 3]


def test_no_ends():
    assert [x.tolist() for x in align_ends(np.array([], int), np.array([], int))] == [[], []]


def test_pieces_have_the_ids_of_whole_texts():
    rng, texts = random.Random(2), []
    for _ in range(2000):
        picks = (rng.choice(["  ", " ", "\n", "\t ", "a", "the", "é", "日", "🙂", "1", "'s", ".", "\x1c", "\x85", "\xa0", "</s>", "<0x20>"]) for _ in range(rng.randint(1, 25)))
        texts.append("".join(picks))
    texts += [words(200, i) for i in range(20)] + ODD
    a, b = BOTH()
    for remembered in (10**6, 5):
        encode = alignment.PairEncoder(a, b, remembered)
        for some in (texts[:700], texts[700:]):
            for text, (x, y) in zip(some, encode(some)):
                if BLANK not in text:
                    assert x.tolist() == WHOLE.encode(" " + text, add_special_tokens=False).ids
                    assert y.tolist() == MODEL.encode(text, num_threads=1)
                else:
                    assert not len(x) and not len(y)


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x41> ▁x", "a  b   c\n\n d\x00", "▁", " ", "\t", "x" * 3000, "日本語 🙂 é é", "  lead and trail  ", "<0x0A>", "a b c",
]


def plain(rows):
    """What every row must give, from the unmodified libraries and all pairs of tokens."""
    alphabet = {c: b for b, c in enumerate(alignment.byte_characters())}
    done = []
    for i, text in rows:
        found = WHOLE.encode(" " + (text or ""), add_special_tokens=False)
        a_bytes = [bytes(alphabet[c] for c in WHOLE.id_to_token(t)) for t in found.ids]
        b = MODEL.encode(text or "", num_threads=1)
        pieces = [MODEL.id_to_piece(t) for t in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if MODEL.is_byte(t) else p.replace("▁", " ").encode() for t, p in zip(b, pieces)]
        written = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != written or b"".join(b_bytes) != written:
            done.append((i, [], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (a_bytes, b_bytes))
        a_starts, b_starts = np.array([0, *ends_a[:-1]]), np.array([0, *ends_b[:-1]])
        links = [
            (found.ids[k], b[j])
            for k in range(len(ends_a))
            for j in range(np.searchsorted(ends_b, a_starts[k], side="right"), np.searchsorted(b_starts, ends_a[k]))
        ]
        common = sorted(set(ends_a) & set(ends_b))
        groups, p, q = [], 0, 0
        for end in common:
            u, v = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups.append(",".join(map(str, found.ids[p:u])) + "|" + ",".join(map(str, b[q:v])))
            p, q = u, v
        done.append((i, found.ids, b, groups, links))
    counts = Counter(link for *_, links in done for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, groups, links in done:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        n_best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, len(a), len(b), len(groups), len(links), n_best, sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def collected(df, name="id"):
    order = [name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(order).collect()), key=str)


@pytest.mark.parametrize("chunk", [1 << 22, 50])
def test_rows_equal_plain_python(make_docs, odd_rows, monkeypatch, chunk):
    import pyspark.sql.functions as F

    monkeypatch.setattr(alignment, "CHUNK_LINKS", chunk)
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, words(30, i % 4)) for i in range(20)]
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("written").cast("binary"), 256))
    got = alignment.aligned(make_docs(rows), BOTH, {"groups_sha256": digest})
    assert collected(got) == plain(rows)


def test_groups_are_returned(make_docs):
    (row,) = alignment.aligned(make_docs([(1, "unbelievable tokenization")]), BOTH).collect()
    a, b = ([i for g in row["groups"] for i in g[side]] for side in ("a", "b"))
    assert a == WHOLE.encode(" unbelievable tokenization").ids and b == MODEL.encode("unbelievable tokenization")
    assert row["n_groups"] == len(row["groups"]) and row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


def test_packed_places_come_back():
    chunk = alignment._Chunk(3)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, n) << 32 | rng.integers(0, 9, n) for n in (0, 5, 300, 0, 0, 1, 70, 0)]
    for d in docs:
        chunk.add(d)
    row = chunk.row()
    held, places, times = alignment._uses(row["uses"])
    pairs = row["pair_a"].astype(np.int64) << 32 | row["pair_b"]
    ends = np.cumsum(held)
    for d, a, b in zip(docs, ends - held, ends):
        assert Counter(d.tolist()) == dict(zip(pairs[places[a:b]].tolist(), times[a:b].tolist()))
    assert Counter(np.concatenate(docs).tolist()) == dict(zip(pairs.tolist(), row["pair_n"].tolist()))


def test_no_rows(no_docs):
    assert alignment.aligned(no_docs, BOTH).collect() == []


def test_only_empty_texts(make_docs):
    got = alignment.aligned(make_docs([(1, ""), (2, None)]), BOTH).collect()
    assert sorted((r["id"], r["n_a"], r["n_links"], r["n_best"], r["count_sum"], len(r["groups"])) for r in got) == [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0)]


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_alignment"](spark, SF)
    assert collected(got, "doc_id") == plain(rows)


def test_only_aligned_rows_are_stored(make_docs, odd_rows, monkeypatch):
    purposes, cut = [], alignment.Scratch.cut
    monkeypatch.setattr(alignment.Scratch, "cut", lambda self, df, *a: purposes.append(self.path.rsplit("/", 1)[-1].rsplit("-", 1)[0]) or cut(self, df, *a))
    assert alignment.aligned(make_docs(odd_rows), BOTH).count() == len(odd_rows)
    assert purposes == ["alignment"]
