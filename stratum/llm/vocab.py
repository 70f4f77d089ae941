"""Public tokenizer vocabularies, loaded once for each Python worker."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: White space of str.isspace() that the vocabularies' pattern does not take as such.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPECIAL = "<|endoftext|>"
#: Characters beyond which ids come as an array at once, which takes less memory than a list but a little more time.
LONG = 1 << 18
BLANKS = str.maketrans("\t\n\r", "   ")


def default_path(name: str) -> str:
    """The place of a file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> "ByteBpe":
    return ByteBpe(path)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> "Pieces":
    return Pieces(path)


class ByteBpe:
    """Ids of the byte-level BPE in ``path``, a file of the tokenizers library.

    tokenizers.Tokenizer defines the ids. Texts are encoded by the rank file of the same vocabulary beside
    ``path`` where there is one, as it is several times as fast and gives the same ids. Texts that hold a special
    token or odd white space go to tokenizers. Nothing is kept from one text to the next.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def one(self, text: str) -> np.ndarray:
        if not self.fast or SPECIAL in text or ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)
        if len(text) > LONG:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind)
        return np.array(self.fast.encode_ordinary(text), self.kind)

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return map(self.one, texts)


class Pieces:
    """Counts of pieces, and of byte-fallback pieces among them, by the sentencepiece model in ``path``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes = {i for i in range(size) if self.model.is_byte(i)}
        #: Characters that are pieces: a text of these alone never falls back to bytes.
        self.known = {x for x in map(self.model.id_to_piece, range(size)) if len(x) == 1} | set(" \t\n\r")

    def byte_share(self, text: str) -> float:
        """Byte-fallback pieces among all pieces. Line ends and tabs count as blanks, as they are no sign of a strange script."""
        if self.known.issuperset(text):
            return 0.0
        ids = self.model.encode(text.translate(BLANKS), num_threads=1)
        return sum(i in self.bytes for i in ids) / len(ids) if ids else 0.0
