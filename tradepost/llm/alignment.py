"""How the tokens of two tokenizers lie over each other, and which pairs of ids that makes.

Both tokenizers write the same bytes, so a token is a stretch of bytes. Where tokens of both end together the text is cut
into groups; inside a group every two tokens whose stretches overlap are linked.

Groups are found by running along a diagonal. ``shift`` is the place in the second list of ends less that in the first.
While ends at this shift are equal, tokens lie one on one; how far that goes is probed with doubled steps and then halved
ones, and the whole stretch is jumped. Where it stops, the list that lags behind is moved until both ends meet: one
irregular group, after which the shift is another.

Neither tokenizer merges over a lone blank, so texts are encoded piece by piece and pieces seen before are looked up; the
alignment runs over the ends of the whole text.

Pairs of ids are counted over all documents. Tasks write their documents in chunks: the distinct pairs of a chunk with
their numbers, and for each document which of them it holds how often, packed. So what is shuffled is one row per chunk
and pair, however often a pair comes, and counts go back to chunks instead of documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import REMEMBERED, byte_characters, text_encoder
from .scratch import Scratch, column

#: A chunk is closed once its documents have this many links.
CHUNK_LINKS = 1 << 22
#: How SentencePiece writes a blank.
BLANK = "▁"

_GROUPS = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
_ALIGNED = pa.schema(
    [
        ("chunk", pa.int64()),
        ("nth", pa.int32()),  # of the document in its chunk; missing in the row of the chunk itself
        ("id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups", _GROUPS),
        ("written", pa.string()),
        ("pair_a", pa.list_(pa.int32())),
        ("pair_b", pa.list_(pa.int32())),
        ("pair_n", pa.list_(pa.int64())),
        ("uses", pa.binary()),
    ]
)
_ALIGNED_SQL = (
    "chunk bigint, nth int, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups array<struct<a: array<int>, b: array<int>>>, written string, pair_a array<int>, pair_b array<int>, pair_n array<bigint>, uses binary"
)


class Tokens:
    """Ids of texts and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], written: list[str], pieces: list[bytes]):
        self.encode = encode
        self.written = written  # as the vocabulary writes them
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """Tokens of a byte-level file of the tokenizers library; texts get a blank in front. Strings of special tokens are ordinary text."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    ids = parts["model"]["vocab"] | {t["content"]: t["id"] for t in parts["added_tokens"]}
    alphabet = {c: b for b, c in enumerate(byte_characters())}
    written, pieces = [""] * (max(ids.values()) + 1), [b""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        written[i] = piece
        pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    encode = text_encoder(path)
    return Tokens(lambda texts: [np.frombuffer(x, "<u4").astype(np.int32) for x in encode([" " + t for t in texts])], written, pieces)


@lru_cache(maxsize=4)
def piece_level(path: str) -> Tokens:
    """Tokens of a SentencePiece model, which puts a blank before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    written = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = []
    for i, piece in enumerate(written):
        pieces.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(BLANK, " ").encode())
    return Tokens(lambda texts: [np.array(x, np.int32) for x in model.encode(texts, num_threads=1)], written, pieces)


def tokenizer_pair(byte_path: str, piece_path: str) -> Callable[[], tuple[Tokens, Tokens]]:
    """Both tokenizers, loaded where they are used."""
    return lambda: (byte_level(byte_path), piece_level(piece_path))


def irregular_groups(a: list[int], b: list[int]) -> list[int]:
    """First place in a, first in b, last in a, last in b of every group that is not one token on one, in a row. ``a`` and
    ``b`` are ascending ends with the same last end."""
    found: list[int] = []
    i = shift = 0
    n, m = len(a), len(b)
    while i < n:
        j = i + shift
        if a[i] == b[j]:
            # Doubled steps while the ends at this shift stay equal, then halved ones.
            i += 1
            step, most = 1, min(n, m - shift)
            while i < most and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step *= 2
            step >>= 1
            while step:
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
                step >>= 1
            i = min(i, most)
            continue
        x, y = a[i], b[j]
        found += i, j
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        found += i, j
        i += 1
        shift = j + 1 - i
    return found


def align_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all groups, as numbers of tokens in a and in b."""
    found = np.array(irregular_groups(a.tolist(), b.tolist()), np.int64).reshape(-1, 4)
    ends = []
    for n, first, last in ((len(a), found[:, 0], found[:, 2]), (len(b), found[:, 1], found[:, 3])):
        inside = np.zeros(n + 1, np.int64)  # a token that its group goes on after
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        ends.append(np.flatnonzero(np.cumsum(inside[:-1]) == 0) + 1)
    return ends[0], ends[1]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all tokens that overlap: between two neighbouring ends of either list lie just one token of each."""
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


class Alignment:
    """Ids and alignment of one text."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, a: Tokens, b: Tokens):
        self.a, self.b = ids_a, ids_b
        # Tokens without bytes, such as unused control pieces, would make ends repeat; no encoder gives them.
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        self.ends_a, self.ends_b = align_ends(ends_a, ends_b)
        self.links_a, self.links_b = overlaps(ends_a, ends_b)

    def pairs(self) -> np.ndarray:
        """One number per link for its pair of ids."""
        return self.a[self.links_a].astype(np.int64) << 32 | self.b[self.links_b].astype(np.int64)


class _Held:
    """Ids of numbered pieces in one array."""

    def __init__(self):
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> None:
        """Take the ids of new pieces in a row; ``numbers`` are those of the pieces less the number of pieces held."""
        starts = np.empty((2, len(sizes)), np.int64)
        starts[0, numbers], starts[1, numbers] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids = np.concatenate([self.ids, ids])
        self.starts, self.sizes = np.concatenate([self.starts, starts[0]]), np.concatenate([self.sizes, starts[1]])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(sizes.sum())]


class PairEncoder(dict):
    """Ids of texts by both tokenizers. Neither merges over a lone blank between two characters that are none, so texts are cut
    there; equal pieces have equal ids and are encoded once. More than ``remembered`` pieces are forgotten before the next call."""

    _cut = re.compile(r"(?<=\S) (?=\S)")
    _other = re.compile(r"\A |\s | \s| \Z")  # a blank that is not alone

    def __init__(self, a: Tokens, b: Tokens, remembered: int = REMEMBERED):
        if any(BLANK in p.lstrip(BLANK) for p in b.written):
            raise ValueError("a piece goes on after a blank")
        self.a, self.b, self.remembered = a, b, remembered
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.held_a, self.held_b, self.same = _Held(), _Held(), np.empty(0, bool)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def _encode_new(self) -> None:
        new, self.new = self.new, []
        # Pieces without blanks at their ends may stand beside each other again, so all go through the tokenizers as one line.
        inner = [p for p in new if p.strip() == p and BLANK not in p]
        line = " ".join(inner)
        ids = [t.encode([line])[0] for t in (self.a, self.b)] if inner else []
        written = b" " + line.encode("utf-8", "surrogatepass")
        if inner and all(t.bytes_of(x) == written for t, x in zip((self.a, self.b), ids)):
            ends = np.cumsum([1 + len(p.encode("utf-8", "surrogatepass")) for p in inner])
            numbers = [self[p] for p in inner]
            rest = set(new).difference(inner)
        else:
            ids, ends, numbers, rest = [np.empty(0, np.int32)] * 2, np.empty(0, np.int64), [], new
        alone = [p for p in new if p in rest] if rest else []
        encoded = [t.encode(alone) if alone else [] for t in (self.a, self.b)]
        same = np.ones(len(new), bool)
        for piece, x, y in zip(alone, *encoded):
            written = b" " + piece.encode("utf-8", "surrogatepass")
            same[self[piece] - len(self.same)] = self.a.bytes_of(x) == written and self.b.bytes_of(y) == written
        numbers = np.array(numbers + [self[p] for p in alone], np.int64) - len(self.same)
        for tokens, held, flat, single in zip((self.a, self.b), (self.held_a, self.held_b), ids, encoded):
            sizes = np.diff(np.searchsorted(np.cumsum(tokens.sizes[flat]), ends, side="right"), prepend=0)
            held.add(np.concatenate([flat, *single]), np.concatenate([sizes, [len(x) for x in single]]).astype(np.int64), numbers)
        self.same = np.concatenate([self.same, same])

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by both; none for texts that are missing, empty or not written back byte for byte after a blank."""
        if len(self) > self.remembered:
            self.forget()
        pieces = [(self._cut.split(t) if self._other.search(t) else t.split(" ")) if t else [] for t in texts]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), np.int64, sum(map(len, pieces)))
        if self.new:
            self._encode_new()
        out, at = [], 0
        for some in pieces:
            own = numbers[at : at + len(some)]
            at += len(some)
            if not self.same[own].all():
                own = own[:0]
            out.append((self.held_a.of(own), self.held_b.of(own)))
        return out


def _planes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


class _Chunk:
    """Links of some documents, to be written as one row."""

    def __init__(self, number: int):
        self.number = number
        self.pairs: list[np.ndarray] = []  # distinct ones of each document
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, links: np.ndarray) -> None:
        pairs, times = np.unique(links, return_counts=True)
        self.pairs.append(pairs)
        self.times.append(times)
        self.links += len(links)

    def row(self) -> dict:
        every, times = np.concatenate(self.pairs), np.concatenate(self.times)
        pairs, place = np.unique(every, return_inverse=True)
        held = np.array([len(p) for p in self.pairs], np.int64)
        # Pairs of a document ascend, so their places are kept as steps; the first of a document is kept itself.
        steps = np.diff(place, prepend=0)
        firsts = (np.cumsum(held) - held)[held > 0]
        steps[firsts] = place[firsts]
        parts = [zstandard.ZstdCompressor(level=3).compress(_planes(x)) for x in (held, steps, times)]
        head = np.array([len(p) for p in parts], "<u8").tobytes()
        return {
            "chunk": self.number,
            "pair_a": (pairs >> 32).astype(np.int32),
            "pair_b": (pairs & 0xFFFFFFFF).astype(np.int32),
            "pair_n": np.bincount(place, times, len(pairs)).astype(np.int64),
            "uses": head + b"".join(parts),
        }


def _uses(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs held per document, their places, their times) of a chunk."""
    out, at = [], 24
    for size in np.frombuffer(data, "<u8", 3):
        out.append(_unplaned(zstandard.ZstdDecompressor().decompress(data[at : at + int(size)])))
        at += int(size)
    held, steps, times = out
    total = np.cumsum(steps)
    first = np.cumsum(held) - held
    some = held > 0
    before = np.zeros(len(held), np.int64)
    before[some] = total[first[some]] - steps[first[some]]
    return held, total - np.repeat(before, held), times


def _group_lists(done: list[Alignment]) -> pa.Array:
    """One list of groups (a, b) per alignment."""

    def lists(ids: str, ends: str) -> pa.Array:
        offset, cuts = 0, [np.zeros(1, np.int64)]
        for x in done:
            cuts.append(getattr(x, ends) + offset)
            offset += len(getattr(x, ids))
        flat = np.concatenate([np.empty(0, np.int32), *(getattr(x, ids) for x in done)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(cuts), pa.int32()), pa.array(flat, pa.int32()))

    groups = pa.StructArray.from_arrays([lists("a", "ends_a"), lists("b", "ends_b")], names=["a", "b"])
    offsets = np.concatenate([[0], np.cumsum([len(x.ends_a) for x in done])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), groups)


class _Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``, decimal ids of all groups in order."""

    def __init__(self, a: Tokens, b: Tokens):
        # Every id with each sign that may follow it: first the ids of a, then those of b.
        self.signed = [f"{i}{sign}" for n, last in ((len(a.pieces), "|"), (len(b.pieces), ";")) for i in range(n) for sign in (",", last)]
        self.first_b = 2 * len(a.pieces)

    def __call__(self, x: Alignment) -> str:
        code = np.empty(len(x.a) + len(x.b), np.int64)
        sides = ((x.a, x.ends_a, np.concatenate([[0], x.ends_b[:-1]]), 0), (x.b, x.ends_b, x.ends_a, self.first_b))
        for ids, ends, before, first in sides:
            last = np.zeros(len(ids), np.int64)
            last[ends - 1] = 1
            # What stands before a token: those of its own side, and those of the other side in earlier groups (for b, also in its own).
            code[np.arange(len(ids)) + np.repeat(before, np.diff(ends, prepend=0))] = first + 2 * ids + last
        return "".join(map(self.signed.__getitem__, code.tolist()))[:-1]


def _align(load: Callable[[], tuple[Tokens, Tokens]], written: bool):
    def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ALIGNED]
        return pa.RecordBatch.from_arrays(arrays, schema=_ALIGNED)

    def closed(chunk: _Chunk) -> pa.RecordBatch:
        row = chunk.row()
        return batch_of({name: pa.array([value], _ALIGNED.field(name).type) for name, value in row.items()}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load()
        encode, write = PairEncoder(a, b), _Writer(a, b)
        first = TaskContext.get().partitionId() << 32
        chunk = _Chunk(first)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                done, nth = [], []
                for ids_a, ids_b in encode(batch.column("text").to_pylist()):
                    done.append(Alignment(ids_a, ids_b, a, b))
                    nth.append((chunk.number, len(chunk.pairs)))
                    chunk.add(done[-1].pairs())
                    if chunk.links >= CHUNK_LINKS:
                        yield closed(chunk)
                        chunk = _Chunk(chunk.number + 1)
                columns = {
                    "chunk": pa.array([c for c, _ in nth], pa.int64()),
                    "nth": pa.array([k for _, k in nth], pa.int32()),
                    "id": batch.column("id"),
                    "n_a": pa.array([len(x.a) for x in done], pa.int64()),
                    "n_b": pa.array([len(x.b) for x in done], pa.int64()),
                    "n_groups": pa.array([len(x.ends_a) for x in done], pa.int64()),
                    "n_links": pa.array([len(x.links_a) for x in done], pa.int64()),
                }
                if written:
                    columns["written"] = pa.array([write(x) if len(x.a) else "" for x in done], pa.string())
                else:
                    columns["groups"] = _group_lists(done)
                yield batch_of(columns, len(done))
        if chunk.pairs:
            yield closed(chunk)

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks with the counts of their pairs to (chunk, nth, n_best, count_sum)."""
    for batch in batches:
        for i in range(batch.num_rows):
            found = batch.column("found")[i]
            place, count, best = (np.asarray(found.values.field(k)) for k in ("place", "count", "best"))
            counts, bests = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            counts[place], bests[place] = count, best
            held, places, times = _uses(batch.column("uses")[i].as_py())
            owner = np.repeat(np.arange(len(held)), held)
            sums = np.zeros(len(held), np.int64)
            np.add.at(sums, owner, counts[places] * times)
            n_best = np.zeros(len(held), np.int64)
            np.add.at(n_best, owner, bests[places] * times)
            chunk = np.full(len(held), batch.column("chunk")[i].as_py(), np.int64)
            arrays = [pa.array(chunk), pa.array(np.arange(len(held), dtype=np.int32)), pa.array(n_best), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "nth", "n_best", "count_sum"])


def align(
    docs: DataFrame, tokens: Callable[[], tuple[Tokens, Tokens]], id_column: str = "doc_id", text: str = "text", written: bool = False
) -> DataFrame:
    """Rows of two kinds: for each row of ``docs`` (nth not missing) its id, n_a, n_b, n_groups, n_links and groups, lists of the ids of
    both tokenizers; for each chunk of rows the distinct pairs of linked ids, how often each is linked, and which row holds which.
    With ``written`` groups are given as text instead, such as ``a1,a2|b1;a3|b2,b3``, in the column of that name.

    ``tokens`` is called in the tasks and gives both tokenizers. Missing and empty texts, and those that one of the two does not
    write back byte for byte after a blank, have no tokens. Repeated rows and missing ids are kept, an empty table gives no rows, other
    columns are not read.
    """
    slim = docs.select(column(docs, id_column).cast("bigint").alias("id"), column(docs, text).cast("string").alias("text"))
    return slim.mapInArrow(_align(tokens, written), _ALIGNED_SQL)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, n, best) for every pair of ids in rows of chunks; best says that no other pair of its b is linked more often."""
    pairs = chunks.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = pairs.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of the second vocabulary at most
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(
    docs: DataFrame,
    tokens: Callable[[], tuple[Tokens, Tokens]],
    derive: dict[str, Column] | None = None,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent one of its id in the
    second tokenizer, ties included), count_sum (the counts of the pairs of all links) and the columns of ``derive``, which may use
    ``written``, the groups as text, and ``align``'s other columns. Without ``derive`` the groups themselves are returned as lists.

    Counts are over all documents. See ``align`` for odd rows.
    """
    found = align(docs, tokens, id_column, text, written=bool(derive))
    derive = derive or {"groups": F.col("groups")}
    keep = Scratch(docs.sparkSession, "alignment")
    own = ["id", "n_a", "n_b", "n_groups", "n_links"]
    stored = found.select(
        "chunk", "nth", *own, "pair_a", "pair_b", "pair_n", "uses", *(F.when(F.col("nth").isNotNull(), c).alias(f"_d_{n}") for n, c in derive.items())
    )
    stored = keep.cut(stored)
    rows = stored.filter("nth is not null").select("chunk", "nth", *own, *(f"_d_{n}" for n in derive))
    chunks = stored.filter("nth is null")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "p"))
    pairs = pairs.select("chunk", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    # Counts and scores are read once each, so they are not stored: a file costs a task several small processes where Hadoop has no native code.
    found = (
        pairs.join(pair_counts(chunks), ["a", "b"])
        .groupBy("chunk")  # a chunk has a bounded number of pairs
        .agg(F.collect_list(F.struct("place", F.col("n").alias("count"), F.col("best").cast("bigint").alias("best"))).alias("found"))
    )
    known = chunks.select("chunk", "uses").join(found, "chunk", "left")
    empty = F.array().cast("array<struct<place: int, count: bigint, best: bigint>>")
    scores = known.select("chunk", "uses", F.coalesce("found", empty).alias("found")).mapInArrow(
        _score, "chunk bigint, nth int, n_best bigint, count_sum bigint"
    )
    return rows.join(scores, ["chunk", "nth"]).select(
        *own, "n_best", "count_sum", *(F.col(f"_d_{n}").alias(n) for n in derive)
    )
