"""Token counts and ids with a public byte-level BPE vocabulary, in Arrow batches balanced by bytes.

A text of the alphabet on which both agree is encoded by the compiled BPE that is given the same vocabulary as
ranks; any other text (special strings, rare scripts, unusual numerals, control characters) is encoded by the
vocabulary's own library. A long text is split where no piece can reach across, whoever encodes it: before a single
blank between two printable ASCII characters, and between a letter and a punctuation mark of the CJK scripts or ASCII.
Both ways give what the library gives for the whole text; ``tests/llm`` compares them on random texts and on every safe
character. A file whose rules are not those (another pattern, a normaliser, merges out of order, special strings with
blanks) is left to the library alone, whole texts at a time.

Defined results: null is the empty text (0 tokens); repeated rows stay; a run without such a place is one part, as long
as it is; only the key and text columns are read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessella.llm.common import text_or_empty
from tessella.session import ship_package

#: Characters for which the two pre-tokenisers agree on letters, digits and white space; anything else is unsafe.
_UNSAFE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ώА-я‐-‧‰-›€ぁ-ゖァ-ヺ一-龥]|<\|")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER = "A-Za-zぁ-ゖァ-ヺ一-龥"
#: Where a text may be split: no piece of the pattern holds a blank behind its first character, or a mark behind a letter.
_CUT = re.compile(rf"(?<=[!-~]) (?=[!-~])|(?<=[{_LETTER}])(?=[。，、！？；：,.!?;:()])")

#: Characters of one part of a long text, and bytes of one batch handed to an encoder.
PART_CHARS, BATCH_BYTES = 1 << 16, 1 << 20


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of about ``size`` characters whose tokens, put together, are those of the text."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def byte_ranks(spec: dict) -> dict[bytes, int]:
    """Ranks by bytes of a byte-level BPE file, without its special tokens."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(back[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}


def follows_ranks(spec: dict) -> bool:
    """Whether the file's rules are those of a byte-level BPE by ranks over ``_PATTERN``, and its special strings leave blanks alone."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type", "BPE") != "BPE" or "merges" not in model or any(model.get(k) for k in odd) or spec.get("normalizer"):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        return False
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = sum(len(t) == 1 for t in model["vocab"])
    special = len({t["content"] for t in spec["added_tokens"]} & model["vocab"].keys())
    return single == 256 and made == sorted(set(made)) and len(made) + single + special == len(model["vocab"])


class Encoder:
    """One per worker and vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.compiled = None
        if follows_ranks(spec):
            self.compiled = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=byte_ranks(spec), special_tokens={})
            self.special = re.compile("|".join([_UNSAFE.pattern, *(re.escape(t["content"]) for t in spec["added_tokens"])]))

    def _parts(self, text: str) -> list[str]:
        return safe_parts(text) if self.compiled and len(text) > PART_CHARS else [text]

    def _safe(self, part: str) -> bool:
        return self.compiled is not None and not self.special.search(part)

    def counts(self, texts: list[str]) -> list[int]:
        """Lengths only, of each whole text; what goes to the library goes in batches of bounded size."""
        out, held, size = [0] * len(texts), [], 0

        def flush() -> None:
            for (i, _), e in zip(held, self.tokenizer.encode_batch_fast([p for _, p in held], add_special_tokens=False), strict=True):
                out[i] += len(e)
            held.clear()

        for i, t in enumerate(texts):
            for part in self._parts(t):
                if self._safe(part):
                    out[i] += len(self.compiled.encode_ordinary(part))
                    continue
                if held and size + len(part) > BATCH_BYTES:
                    flush()
                    size = 0
                held.append((i, part))
                size += len(part)
        flush()
        return out

    def _one(self, part: str) -> list[int]:
        return self.compiled.encode_ordinary(part) if self._safe(part) else self.tokenizer.encode(part, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each whole text as little-endian 32-bit bytes, in order."""
        for t in texts:
            yield b"".join(np.array(self._one(p), "<u4").tobytes() for p in self._parts(t))


def balanced(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[str], list[int]]]:
    """Runs (start, texts, bytes of each) of about ``most`` bytes; a longer text is a run of its own."""
    at, held, sizes, total = 0, [], [], 0
    for i, (x, n) in enumerate(zip(texts, pc.binary_length(texts).to_pylist(), strict=True)):
        if held and total + n > most:
            yield at, held, sizes
            at, held, sizes, total = i, [], [], 0
        held.append(x.as_py())
        sizes.append(n)
        total += n
    if held:
        yield at, held, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each whole text; ``vocabulary`` is the path of a tokenizers file."""
    ship_package(df.sparkSession)
    source = df.select(key, text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at, texts, sizes in balanced(batch.column(1)):
                counts = enc.counts(texts)
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                    [key, "n_bytes", "n_tokens", "over_limit"],
                )

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
