"""Encoding texts piece by piece with a bounded memory of pieces seen before.

The tokenizers used here never merge over a blank that a non-blank follows, so a text may be cut before every such
blank, and equal pieces have equal ids. Texts repeat words; most pieces are looked up, only new ones are encoded.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Ids are kept and returned as little-endian unsigned 32-bit integers.
ID = np.dtype("<u4")
#: Pieces that each memory keeps.
REMEMBERED = 250_000
_CUT = re.compile(r" (?=\S)")
_AWKWARD = re.compile(r" (?:\s|\Z)")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


_AS_CHARACTER = dict(enumerate(byte_characters()))


def mapped(piece: str) -> str:
    """UTF-8 bytes of ``piece``, one printable character each."""
    if piece.isascii() and piece.isalnum():
        return piece
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_AS_CHARACTER)


class ChunkEncoder:
    """``encode`` gives the packed ids of one piece; pieces start with their blank. Two generations of at most
    ``remembered`` pieces each are kept (more only while one slice of ``at_once`` characters needs more)."""

    def __init__(self, encode: Callable[[str], bytes], remembered: int = REMEMBERED, at_once: int = 1_000_000):
        self.encode = encode
        self.remembered = remembered
        self.at_once = at_once
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= self.at_once:
                out += self._some(texts[start : i + 1])
                start, size = i + 1, 0
        return out + self._some(texts[start:])

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") if not _AWKWARD.search(t) else _CUT.split(t) for t in texts]
        heads = [self.encode(parts[0]) for parts in cut]
        for parts in cut:
            del parts[0]
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old, encode = self.young, self.old, self.encode
        for piece in set(chain.from_iterable(cut)).difference(young):
            young[piece] = old[piece] if piece in old else encode(" " + piece)
        find = young.__getitem__
        return [head + b"".join(map(find, parts)) for head, parts in zip(heads, cut)]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> ChunkEncoder:
    """Encoder by a byte-level file of the tokenizers library; strings of special tokens are ordinary text.

    The library's own normalizer and model do the work, without the bookkeeping of offsets that makes its whole pass
    slow. Only the cutting into words is done here, by the file's own pattern.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, normalizer = tokenizer.model, tokenizer.normalizer
    model._resize_cache(0)  # every word comes once
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    words = regex.compile(_word_pattern(parts["pre_tokenizer"]))
    find, tokenize = words.findall, model.tokenize
    lower = _only_lower(parts["normalizer"])
    known: dict[str, bytes] = {}

    def word_ids(word: str) -> bytes:
        ids = known.get(word)
        if ids is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = [t.id for t in tokenize(mapped(word))]
            ids = known[word] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def encode(piece: str) -> bytes:
        if normalizer is not None:
            # Below U+0250 no character changes when composed, and lower case does not depend on neighbours.
            piece = piece.lower() if lower and (piece.isascii() or max(piece) < "\u0250") else normalizer.normalize_str(piece)
        words = find(piece)
        return word_ids(words[0]) if len(words) == 1 else b"".join(map(word_ids, words))

    return ChunkEncoder(encode)


class _Words(dict):
    """Ids of words seen before, in one array. ``encode`` gives the ids of many words and how many each has. Once more than
    ``remembered`` words are held, all are forgotten before the next call."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED // 2):
        self.encode = encode
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = np.empty(0, ID), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's end, with a leading 0."""
        if len(self) > self.remembered:
            self.forget()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            ids, sizes = self.encode(self.new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.new = []
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _cut_at_ends(ids: np.ndarray, is_end: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[ranks], np.diff(np.flatnonzero(is_end[ranks]), prepend=-1)


#: Written after each word for a vocabulary that marks the ends of words; lower-case text does not hold it.
_END = "Z"


@lru_cache(maxsize=4)
def word_end_encoder(path: str) -> Callable[[list[str]], list[bytes]] | None:
    """Encoder of whole texts by a file whose tokens mark the ends of words, with the same ids as ``library_encoder``; None for other
    files and for texts in other than lower case.

    The file's merges are a table of ranks once the mark is a byte of its own that is merged with the byte before it first. The new
    words of many texts, a mark after each, go through tiktoken in one call, and the tokens that end in a mark say where words end.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, suffix = parts["model"], parts["model"].get("end_of_word_suffix")
    made = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or not _only_lower(parts["normalizer"]):
        return None
    if any(_END in piece.removesuffix(suffix) for pair in made for piece in pair):
        return None
    alphabet = {c: b for b, c in _AS_CHARACTER.items()}

    def written(token: str) -> bytes:
        ends = token.endswith(suffix)
        return bytes(alphabet[c] for c in token.removesuffix(suffix)) + (_END.encode() if ends else b"")

    tokens = list(alphabet) + [c + suffix for c in alphabet if c != _END] + ["".join(pair) for pair in made]
    ranks = {written(t): rank for rank, t in enumerate(tokens)}
    if len(ranks) != len(tokens):
        return None  # a token is made in two ways
    ids = np.array([model["vocab"][t] for t in tokens], ID)
    is_end = np.array([t.endswith(suffix) for t in tokens])
    encoding = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
    whole = regex.compile(_word_pattern(parts["pre_tokenizer"])).findall
    # For characters whose lower case is one of them too, the classes of the file's pattern are written out for the faster module.
    plain = [c for c in map(chr, range(0x180)) if len(c.lower()) == 1 and ord(c.lower()) < 0x180]
    beyond = re.compile("[^" + "".join(map(re.escape, plain)) + "]").search
    simple = _simple_words(_word_pattern(parts["pre_tokenizer"]), plain)
    library = Tokenizer.from_file(path)
    normalize, cut, newer = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str, _unassigned()

    def words_of(text: str) -> list[str]:
        if simple and not beyond(text):
            return simple(text.lower())
        text = normalize(text)
        # About characters newer than Python's tables the modules may disagree; the library's own cut decides.
        return [text[a:b] for _, (a, b) in cut(text)] if newer(text) else whole(text)

    known = _Words(lambda words: _cut_at_ends(ids, is_end, encoding.encode_to_numpy(_END.join(words) + _END, disallowed_special=())))

    def some(texts: list[str]) -> list[bytes]:
        words = [words_of(t) for t in texts]
        found, ends = known(list(chain.from_iterable(words)))
        cuts = 4 * ends[np.concatenate([[0], np.cumsum([len(w) for w in words])])]
        packed = found.tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def run(texts: list[str], at_once: int = 500_000) -> list[bytes]:
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= at_once:
                out += some(texts[start : i + 1])
                start, size = i + 1, 0
        return out + (some(texts[start:]) if start < len(texts) else [])

    return run


@lru_cache(maxsize=1)
def _unassigned():
    """Search for a character that Python's tables don't know."""
    from unicodedata import category

    ranges: list[list[int]] = []
    for c in range(0x110000):
        if category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]").search


def _simple_words(pattern: str, characters: list[str]) -> Callable[[str], list[str]] | None:
    """``findall`` of a file's word pattern for texts of ``characters`` only."""
    import regex

    def kind(name: str) -> str:
        return "".join(re.escape(c) for c in characters if regex.match(name, c))

    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(f"[{name}]", f"[{kind(name)}]").replace(name, kind(name))
    try:
        return re.compile(pattern).findall
    except re.error:
        return None


@lru_cache(maxsize=4)
def text_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder of whole texts by a byte-level file of the tokenizers library, with the same ids as ``library_encoder``.

    A file that numbers its merges in the order of their ranks is a table of ranks; tiktoken encodes by such tables
    several times faster and without remembering words. Other files go to ``library_encoder``.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    ranks = _ranks(parts)
    if ranks is None:
        return word_end_encoder(path) or library_encoder(path)
    import tiktoken

    encoding = tiktoken.Encoding("file", pat_str=_word_pattern(parts["pre_tokenizer"]), mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()).astype(ID).tobytes() for t in texts]


@lru_cache(maxsize=4)
def document_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder with the ids that the library's ``encode`` gives without the special tokens of templates: strings of the file's
    added tokens become their ids first, the leftmost and longest ones, and the text between is encoded piece by piece.

    Added tokens that take blanks with them, stand for whole words only or are looked for in normalized text go to the library.
    """
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path).encode
        return lambda texts: [np.array(whole(t, add_special_tokens=False).ids, ID).tobytes() for t in texts]
    encode = text_encoder(path)
    if not added:
        return encode
    ids = {t["content"]: struct.pack("<I", t["id"]) for t in added}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")

    def run(texts: list[str]) -> list[bytes]:
        parts = [cut.split(t) if any(c in t for c in ids) else [t] for t in texts]
        coded = iter(encode([p for some in parts for p in some[::2]]))
        return [b"".join(ids[p] if i % 2 else next(coded) for i, p in enumerate(some)) for some in parts]

    return run


def _ranks(parts: dict) -> dict[bytes, int] | None:
    """Ids by token bytes, if the file has no normalizer and a merge of a lower rank always makes a token of a lower id."""
    model, vocab = parts["model"], parts["model"]["vocab"]
    if parts["normalizer"] or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    made = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    alphabet = {c: b for b, c in _AS_CHARACTER.items()}
    if any(vocab.get(c, 256) > 255 for c in alphabet) or [vocab.get(t) for t in made] != list(range(256, 256 + len(made))):
        return None
    return {bytes(alphabet[c] for c in t): vocab[t] for t in (*alphabet, *made)}


def _only_lower(step: dict | None) -> bool:
    """Whether a file's normalizer composes characters, makes white space blank (which the pattern drops) and writes lower case."""
    kinds = [s["type"] for s in step["normalizers"]] if step and step["type"] == "Sequence" else []
    return kinds == ["NFC", "Replace", "Lowercase"] and step["normalizers"][1]["pattern"] == {"Regex": r"\s+"}


def _word_pattern(step: dict) -> str:
    """Pattern whose matches a file's pre-tokenizer gives to the model."""
    if step["type"] == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]:
        import public_tokenizers

        return public_tokenizers.PATTERN
    if step["type"] == "Sequence" and [s["type"] for s in step["pretokenizers"]] == ["Split", "ByteLevel"]:
        split, level = step["pretokenizers"]
        if split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
            return split["pattern"]["Regex"]
    raise ValueError("only byte-level vocabularies with a word pattern are supported")
