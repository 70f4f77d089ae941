"""Quality rules from tokeniser fertility, with rejection bands for each language or script."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import vocab
from stratum.llm.common import pick, small_batches

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, band string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, reason string"
)


@dataclass(frozen=True)
class Band:
    """What a language or script allows.

    chars_per_token: least and most characters for each byte-BPE token. byte_share: most byte-fallback
    pieces among all pieces. evenness: least token entropy as a share of log2 of the number of tokens,
    beyond which that number no longer counts at ``level`` tokens.
    """

    chars_per_token: tuple[float, float] = (1.2, 9.0)
    byte_share: float = 0.25
    evenness: float = 0.55
    level: int = 1024


#: By language where the language is known, else by script, else "other".
BANDS = {
    "en": Band(evenness=0.6, chars_per_token=(1.6, 8.0), byte_share=0.05),
    "de": Band(evenness=0.6, chars_per_token=(1.4, 8.0), byte_share=0.05),
    "fr": Band(evenness=0.6, chars_per_token=(1.3, 8.0), byte_share=0.05),
    "es": Band(evenness=0.6, chars_per_token=(1.3, 8.0), byte_share=0.05),
    "latin": Band(),
    "greek": Band(chars_per_token=(0.4, 6.0)),
    "cyrillic": Band(chars_per_token=(0.4, 6.0)),
    "arabic": Band(chars_per_token=(0.3, 6.0)),
    "hebrew": Band(chars_per_token=(0.3, 6.0)),
    "indic": Band(chars_per_token=(0.2, 5.0), byte_share=0.9),
    "han": Band(chars_per_token=(0.2, 4.0), byte_share=0.6),
    "kana": Band(chars_per_token=(0.2, 4.0), byte_share=0.6),
    "hangul": Band(chars_per_token=(0.2, 4.0), byte_share=0.9),
    "other": Band(chars_per_token=(0.1, 9.0), byte_share=1.0, evenness=0.4),
}
#: First code points of Unicode's blocks, and the script from there on; "" holds no letters to speak of.
BLOCKS = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x1F000, ""), (0x20000, "han"), (0x32000, "other"),
]
STARTS = np.array([x for x, _ in BLOCKS], np.uint32)
SCRIPTS = sorted({s for _, s in BLOCKS})
OF_BLOCK = np.array([SCRIPTS.index(s) for _, s in BLOCKS])


@dataclass(frozen=True)
class Params:
    bpe: str = field(default_factory=lambda: vocab.default_path("byte_bpe_50k.json"))
    model: str = field(default_factory=lambda: vocab.default_path("piece_bpe_32k.model"))
    bands: dict[str, Band] = field(default_factory=lambda: BANDS)
    min_words: int = 50
    repeat_percent: int = 50


def script(text: str) -> str:
    """The script of most letters; "other" without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.bincount(OF_BLOCK[np.searchsorted(STARTS, codes, "right") - 1], minlength=len(SCRIPTS))
    counts[SCRIPTS.index("")] = 0
    return SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def repeated(words: list) -> int:
    """Words within three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, end = Counter(windows), 0, 0
    for i, x in enumerate(windows):
        if counts[x] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def base(text: str) -> tuple[list[bytes], int, int, int, int]:
    """The words, their characters, symbols, repeated lines and words of repeated windows."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    space = len(raw) - len(raw.translate(None, SPACES))
    return words, len(text) - space, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated(words)


def judge(n: int, per_token: float, share: float, entropy: float, band: Band) -> str:
    """The first band that a text of n tokens leaves, or none."""
    if n == 0:
        return "empty"
    if not band.chars_per_token[0] <= per_token <= band.chars_per_token[1]:
        return "chars_per_token"
    if share > band.byte_share:
        return "byte_share"
    if entropy < band.evenness * math.log2(max(2, min(n, band.level))):
        return "token_entropy"
    return ""


def measured(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sp = vocab.byte_bpe(p.bpe), vocab.pieces(p.model)
        for b in batches:
            rows = []
            whole = [x or "" for x in b.column(1).to_pylist()]
            for doc_id, text, lang, ids in zip(b.column(0).to_pylist(), whole, b.column(2).to_pylist(), bpe.batch(whole)):
                words, chars, symbols, lines, again = base(text)
                failed = len(words) < p.min_words or 100 * again > p.repeat_percent * len(words)
                n = len(ids)
                counts = np.unique(ids, return_counts=True)[1] if n else np.zeros(0)
                entropy = float(math.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0
                own = script(text)
                key = lang if lang in p.bands else own if own in p.bands else "other"
                per_token, share = len(text) / n if n else 0.0, sp.byte_share(text)
                reason = judge(n, per_token, share, entropy, p.bands.get(key, Band()))
                why = "base" if failed else reason
                rows.append((doc_id, len(words), chars, symbols, lines, again, failed, not why, own, key, n, per_token, share, max(0.0, entropy), why))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(TYPES), TYPES)], NAMES)

    return run


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def fertility(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each document with its fertility measures and whether it is kept.

    A document fails the base rules with under 50 words or with over half of its words in repeated
    three-word windows; it is then rejected. Else it is kept if characters per byte-BPE token, the share of
    byte-fallback pieces and the entropy of its tokens lie in the band of its language, or of its script
    where the language has no band. A narrow pass over the rows: nothing is shuffled.

    Null and empty texts have no words and fail; null languages go by script; repeated rows give a row each;
    a null doc_id stays null; further columns are ignored; an empty table gives an empty table.
    """
    p = params or Params()
    small_batches(docs.sparkSession)
    columns = pick(docs, doc_id="long", text="string", lang="string") if "lang" in docs.columns else pick(docs, doc_id="long", text="string").withColumn("lang", F.lit(None).cast("string"))
    return columns.mapInArrow(measured(p), SCHEMA)
