"""BPE encoding by a trie of distinct words, whose shared prefixes are encoded once, and decoding."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stratum.llm import vocab
from stratum.llm.common import pick, small_batches, texts

#: The words of a lower-cased text of Latin-1 characters, as the vocabulary's pattern takes them. Fixed values.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾\x85\xa0]+", re.ASCII)
NEVER = 1 << 60


@dataclass(frozen=True)
class Params:
    """bpe: a file of the tokenizers library with byte-level BPE and word ends. nodes, pieces: of the trie and of the
    table of strings between blanks; when a batch finds it larger, a worker starts anew with the trie, and keeps of the
    strings those that it meets again. slice: characters of texts that are
    encoded at once, or one text. longest: bytes of a word or string that is kept; a longer one is encoded on its own, in the same way."""

    bpe: str = field(default_factory=lambda: vocab.default_path("word_bpe_49k.json"))
    nodes: int = 400_000
    pieces: int = 250_000
    slice: int = 2_000_000
    longest: int = 256


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: bytes of visible Latin-1 characters are themselves,
    the others follow in order from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def names(path: str) -> list[str]:
    """The names of tokens by id, and empty ones of ids between that have none."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    known = {**file["model"]["vocab"], **{t["content"]: t["id"] for t in file["added_tokens"]}}
    out = [""] * (max(known.values()) + 1)
    for name, i in known.items():
        out[i] = name
    return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> Merges:
    return Merges(path)


class Merges:
    """The vocabulary: ids by bytes, within a word and at its end, and for each id the merge that makes it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        known = file["model"]["vocab"]
        end = file["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inside: dict[bytes, int] = {}
        self.at_end: dict[bytes, int] = {}
        for name, i in known.items():
            body = name.removesuffix(end)
            if body and all(c in letters for c in body):
                (self.at_end if body != name else self.inside)[bytes(letters[c] for c in body)] = i
        self.names = names(path)
        size = len(self.names)
        self.rank, self.parts, self.order = [-1] * size, [(-1, -1)] * size, {}
        for r, pair in enumerate(file["model"]["merges"]):
            a, b = (known[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = known[self.names[a] + self.names[b]]
            if self.rank[made] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError(f"{path}: a token is made twice, or before its parts")
            self.rank[made], self.parts[made], self.order[a, b] = r, (a, b), r
        self.lengths = [0] * size
        for body, i in chain(self.inside.items(), self.at_end.items()):
            self.lengths[i] = len(body)
        self.inside, self.at_end = ({x: i for x, i in ids.items() if self.whole(i)} for ids in (self.inside, self.at_end))
        self.inside_sizes, self.end_sizes = sizes(self.inside), sizes(self.at_end)
        self.letters = letters
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side are what merging makes of their letters.

        They are unless a merge across the border comes first. The pieces beside the border are gone through from the
        last to the first, by undoing the later merge of either; a merge of the two takes place if its rank comes before
        the merge that uses up the left one, and before or with that which uses up the right one, as of equal merges the
        leftmost is first.
        """
        left_until = right_until = NEVER
        rank = self.rank
        while True:
            across = self.order.get((a, b), NEVER)
            if across < left_until and across <= right_until:
                return False
            if rank[a] > rank[b]:
                left_until, a = rank[a], self.parts[a][1]
            elif rank[b] >= 0:
                right_until, b = rank[b], self.parts[b][0]
            else:
                return True

    def whole(self, i: int) -> bool:
        """Whether merging the letters of a token makes that token."""
        a, b = self.parts[i]
        return a < 0 or (self.whole(a) and self.whole(b) and not self.stays(a, b))

    def split(self, piece: bytes) -> list[str | int]:
        """The words of a string as the library finds them, and ids of special tokens."""
        text = piece.decode()
        if text.isascii() and text.isalpha():
            return [text.lower()]
        out: list[str | int] = []
        for part in self.cuts.split(text) if self.cuts and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() or max(part) <= "\xff":
                out += WORDS.findall(part.lower())
            else:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(self.letters[c] for c in word).decode("utf-8", "surrogateescape"))
        return out


def sizes(ids: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """For the last three bytes of a word, or as many as it has, the sizes that tokens may have which end it, longest first."""
    tails: dict[bytes, set[int]] = {}
    for body in ids:
        tails.setdefault(body[-3:], set()).add(len(body))
    for tail, of in tails.items():
        of |= {n for n in (1, 2) if tail[-n:] in ids and n <= len(tail)}
    return {tail: tuple(sorted(of, reverse=True)) for tail, of in tails.items()}


class Trie:
    """Distinct words as paths of bytes. A node, known by its path, keeps the last token of the encoding of the bytes on the path.
    From it and from nodes above it the encoding is read backwards. The last byte of a word is a letter of its own, as it ends the
    word, and is not in the trie."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.state: dict[bytes, int] = {}
        #: Whether two tokens stay side by side, for those met so far.
        self.pairs: dict[int, bool] = {}

    def last(self, word: bytes, end: int, path: list[int] | None, ids: dict[bytes, int], by_tail: dict[bytes, tuple[int, ...]]) -> int:
        """The last token of the first ``end`` bytes: of all tokens that end there, the one that stays beside the last token of what
        is before it, which the trie has, or ``path`` of a word that isn't kept. There is exactly one."""
        tail = word[end - 3 : end] if end > 3 else word[:end]
        for size in by_tail.get(tail) or by_tail.get(tail[-2:]) or (1,):
            start = end - size
            if start < 0 or (i := ids.get(word[start:end])) is None:
                continue
            if not start:
                return i
            pair = (path[start] if path else self.state[word[:start]]) << 24 | i
            if (fits := self.pairs.get(pair)) is None:
                fits = self.pairs[pair] = self.merges.stays(pair >> 24, i)
            if fits:
                return i
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode(self, words: Iterable[str], longest: int) -> Iterator[tuple[str, bytes]]:
        """The ids of each word, as 32-bit numbers. Words come in order, so the trie is gone through depth-first; a node that is there
        already has its state, and only those below the deepest one get theirs."""
        m, state = self.merges, self.state
        lengths = m.lengths
        for name in sorted(words):
            word = name.encode("utf-8", "surrogateescape")
            inner, path = len(word) - 1, None
            if inner < longest:
                at = inner
                while at and word[:at] not in state:
                    at -= 1
                while at < inner:
                    at += 1
                    state[word[:at]] = self.last(word, at, None, m.inside, m.inside_sizes)
            else:
                path = [-1]
                while len(path) <= inner:
                    path.append(self.last(word, len(path), path, m.inside, m.inside_sizes))
            i = self.last(word, inner + 1, path, m.at_end, m.end_sizes)
            out = [i]
            at = inner + 1 - lengths[i]
            while at:
                i = path[at] if path else state[word[:at]]
                out.append(i)
                at -= lengths[i]
            yield name, array("i", out[::-1]).tobytes()


class Encoder:
    """Encodes batches of texts; the trie and the strings seen are kept from one batch to the next within bounds."""

    def __init__(self, p: Params) -> None:
        self.p, self.merges = p, model(p.bpe)
        self.trie = Trie(self.merges)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def batch(self, batch: list[str]) -> pa.ListArray:
        """The ids of texts, some at a time, so that only their own strings are held at once."""
        encoded, some, size = [], [], 0
        for text in batch:
            some.append(text)
            size += len(text)
            if size >= self.p.slice:
                encoded += self.some(some)
                some, size = [], 0
        encoded += self.some(some)
        places = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), np.int32), pa.int32()))

    def some(self, batch: list[str]) -> list[bytes]:
        p, m = self.p, self.merges
        if len(self.trie.state) > p.nodes or len(self.trie.pairs) > p.nodes:
            self.trie = Trie(m)
        if len(self.known) > p.pieces:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        # no word goes over a blank, so a text's encoding is that of its strings between blanks, one after the other
        pieces = [t.encode().split() for t in batch]
        fresh = set().union(*pieces).difference(known)
        known.update((x, older[x]) for x in fresh.intersection(older))
        split = {x: m.split(x) for x in fresh.difference(known)}
        ids = dict(self.trie.encode({w for of in split.values() for w in of if isinstance(w, str)}, p.longest))
        for x, of in split.items():
            known[x] = b"".join([ids[w] if isinstance(w, str) else array("i", [w]).tobytes() for w in of])
        encoded = [b"".join(map(known.__getitem__, of)) for of in pieces]
        for x in split:
            if len(x) > p.longest:
                del known[x]
        return encoded


@functools.lru_cache(maxsize=2)
def encoder(p: Params) -> Encoder:
    return Encoder(p)


def decoded(ids: pa.ListArray, of: pa.Array) -> pa.Array:
    """What the library's decode gives for a vocabulary without a decoder: the names of the tokens with a blank between.
    Ids that the vocabulary hasn't got are left out; null ids give a null text."""
    flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    places = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
    known = (flat >= 0) & (flat < len(of))
    known &= np.asarray(pc.not_equal(of, ""))[np.where(known, flat, 0)]
    left = np.concatenate([[0], np.cumsum(known)])[places].astype(np.int32)
    names = pa.ListArray.from_arrays(pa.array(left, pa.int32()), of.take(pa.array(flat[known])))
    return pc.if_else(pc.is_valid(ids), pc.binary_join(names, " "), None)


def encode(docs: DataFrame, params: Params | None = None, back: bool = False) -> DataFrame:
    """doc_id and ids of every whole text, as the tokenizers library encodes it without adding special tokens; with ``back`` also
    text, decoded from the ids at once.

    A task gathers the distinct words of a batch into a trie, which it keeps for the next batches, and goes through it
    depth-first: each node gets the last token of its prefix from the nodes above it, once for all words that share the prefix.
    Nothing is shuffled, and memory is bounded by a batch, ``nodes`` and ``pieces``, whatever the number of distinct words.

    A null or empty text, or one of blanks alone, has no ids. Strings of special tokens in a text are those tokens. Very long
    words are encoded in the same way, in time linear in their length, and not kept. Repeated rows and ids give a row each;
    an empty table gives no rows; further columns are ignored, whatever their names.
    """
    p = params or Params()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, of = encoder(p), pa.array(names(p.bpe), pa.string())
        for b in batches:
            ids = e.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, *([decoded(ids, of)] if back else [])], ["doc_id", "ids", *(["text"] if back else [])])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * back)


def decode(tokens: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, ids and the text that the library decodes them to, special tokens included. Null ids give a null text."""
    p = params or Params()
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.array(names(p.bpe), pa.string())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), decoded(b.column(1), of)], ["doc_id", "ids", "text"])

    return pick(tokens, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, ids array<int>, text string")
