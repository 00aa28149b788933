"""Token ids of the word-level public tokenizer, fast where that is safe.

Ids are those of the `tokenizers` library. Texts of common Latin characters take a short way: pre-tokens by the
tokenizer's own pattern, ranks by `tiktoken` over the same merges (the end-of-word mark is a zero byte), and a
bounded cache by white-space chunk, looked up once for each different chunk of a batch. Texts with any other
character or a special token's string go to `tokenizers` whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a Python worker, about 200 bytes each.
CACHE_CHUNKS = 400_000
#: Characters on which both libraries agree: no combining marks, no controls, no odd cases of lower-casing.
UNSAFE = re.compile("[^\t-\r -~\xa0-įı-ɏ‐-‧‰-⁞€]")
MARK = "\x01"
_loaded: dict[str, "WordBpe"] = {}


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encodes texts to little-endian 32-bit ids."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        byte_of = {c: b for b, c in enumerate(chars)}

        def to_bytes(token: str) -> bytes:
            return bytes(byte_of[c] for c in token.removesuffix(end)) + b"\0" * token.endswith(end)

        tokens = [*chars, *(c + end for c in chars[1:]), *("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])]
        ranks = {to_bytes(t): k for k, t in enumerate(tokens)}
        if len(ranks) != len(tokens):
            raise ValueError("merges make a token twice")
        self.ids = np.array([vocab[t] for t in tokens], "<u4")
        self.mark = ranks[MARK.encode() + b"\0"]
        self.fast = tiktoken.Encoding("word", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        """One encoder for each Python worker and file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode(self, texts: list[str]) -> list[memoryview | bytes]:
        odd = {i for i, t in enumerate(texts) if UNSAFE.search(t) or any(s in t for s in self.special)}
        plain = pa.array(["" if i in odd else self._spaced(t) for i, t in enumerate(texts)], pa.large_string())
        chunks = pc.split_pattern(plain, " ")
        coded = chunks.values.dictionary_encode()
        wanted = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.cache.get, wanted))
        new = [k for k, ids in enumerate(known) if ids is None]
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache = {w: ids for w, ids in zip(wanted, known, strict=True) if ids is not None}
        if new:
            for k, ids in zip(new, self._learn([wanted[k] for k in new]), strict=True):
                known[k] = ids
        # the chunks' ids one after another, and where each text's begin
        laid = pa.array(known, pa.large_binary()).take(coded.indices)
        _, at, data = laid.buffers()
        at = np.frombuffer(at, "<i8")[: len(laid) + 1] if len(laid) else np.zeros(1, "<i8")
        bounds, body = at[chunks.offsets.to_numpy()].tolist(), memoryview(data).cast("B") if data else b""
        return [self._slowly(t) if i in odd else body[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts)]

    def _slowly(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _spaced(text: str) -> str:
        for c in "\t\n\v\f\r":
            if c in text:
                text = text.replace(c, " ")
        return text

    def _learn(self, chunks: list[str]) -> list[bytes]:
        words = self.pattern.findall(f" {MARK} ".join(chunks).lower())
        ranks = np.array(self.fast.encode_ordinary("\0".join(words) + "\0"), "u4") if words else np.array([], "u4")
        ends = np.append(np.flatnonzero(ranks == self.mark), len(ranks))
        data, found, start = self.ids[ranks].tobytes(), [], 0
        for end in (4 * ends).tolist():
            found.append(data[start:end])
            start = end + 4
        self.cache.update(zip(chunks, found, strict=True))
        return found
