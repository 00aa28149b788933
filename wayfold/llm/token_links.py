"""Alignment of two tokenizers over the same bytes, and how often the corpus links each pair of their ids.

A text is encoded by a byte-level BPE (A, over a space and the text) and a sentence-piece BPE (B, which adds that
space). Byte offsets where a token of each ends cut both into groups; all A-B pairs of a group are linked. A pair
of ids counts once for each document that links it.

Matrices: sparse rows in hand-built CSR. The token-byte incidences give the overlap A x B' by Gustavson's row
products; groups begin at the rows of the overlap that share no B token with the row before. Incidences of ids
and groups, with the number of tokens as values, multiply to the links of each id pair.

Chunks: neither tokenizer has a token that goes on from a character over a following space, so both end before
each word that a space begins, and every matrix is block-diagonal by such words. Each different word of a block of
documents is encoded and multiplied once. Counts: a block gives its different pairs with their documents, Spark sums
them by pair; then a block gets its own pairs' counts back, so no row is made for a link, and no table of all pairs
goes to a task. A pair in all texts has a row for each block, and those rows are dealt over salts.

Texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens: zeros and ''.
Repeated rows and null ids are rows like any others. An empty table gives no rows. Keys may have any names but
those of the result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.llm.shared import arrow_rows, lookup, own_keys, shared_dir, ship_package, written
from wayfold.llm.tokens import _byte_chars

#: Bytes of text, about, that make a block; a longer text is a block of its own.
BLOCK_BYTES = 5 << 20
#: Different words whose matrices are multiplied at once, and texts whose pairs are counted at once.
WORDS_AT_ONCE, TEXTS_AT_ONCE = 1 << 15, 256
#: Characters that are encoded in one call.
CALL_CHARS = 1 << 16
#: A space that both tokenizers begin a token with, whatever stands before: after a character, before a word.
CUT = re.compile(r"(?<=\S) (?= *\S)")
ODD_SPACES = re.compile(r"\s\s|^\s|\s$")
#: Words with other characters than those on which the two libraries for A agree, or with white space at an end, are encoded alone.
ODD_WORDS = r"[^\n\t -~\x{a1}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}\x{4e00}-\x{9fa5}]|[\n\t ]$|^[\n\t ]"
SPACE_MARK = "▁"
_loaded: dict[tuple[str, str, str], "Pair"] = {}


class Csr(NamedTuple):
    """Rows of a sparse matrix: columns and values of row i are at starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> "Csr":
        """From entries in any order; equal places are summed."""
        at = rows.astype(np.int64) * max(width, 1) + columns
        if len(at) > 1 and (at[1:] < at[:-1]).any():
            order = np.argsort(at, kind="stable")
            at, values = at[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        values = np.add.reduceat(values, first) if len(first) else values[:0]
        at = at[first]
        starts = np.searchsorted(at, np.arange(height + 1, dtype=np.int64) * max(width, 1))
        return cls(starts, at % max(width, 1), values, width)

    def transposed(self) -> "Csr":
        return Csr.of(self.columns, self.rows, self.values, self.width, len(self.starts) - 1)

    def times(self, other: "Csr") -> "Csr":
        """Gustavson's product: row i is the sum of other's rows that its columns name, times its values."""
        lengths = np.diff(other.starts)[self.columns]
        ends = np.cumsum(lengths)
        at = np.repeat(other.starts[self.columns] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Csr.of(np.repeat(self.rows, lengths), other.columns[at], np.repeat(self.values, lengths) * other.values[at], len(self.starts) - 1, other.width)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def on_bytes(lengths: np.ndarray) -> Csr:
    """Incidence of tokens that lie one after another with the bytes they cover."""
    starts = starts_of(lengths)
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def groups_of(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each A and each B token, from the overlaps A x B'."""
    overlap = on_bytes(a_lengths).times(on_bytes(b_lengths).transposed())
    first, last = overlap.columns[overlap.starts[:-1]], overlap.columns[overlap.starts[1:] - 1]
    begins = np.ones(len(first), bool)
    begins[1:] = first[1:] != last[:-1]
    a_group = np.cumsum(begins) - 1
    b_group = np.empty(len(b_lengths), np.int64)
    b_group[overlap.columns] = a_group[overlap.rows]
    return a_group, b_group


def linked_ids(a_ids: np.ndarray, a_chunk: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, chunks: int, groups: int, b_width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each chunk by ids: starts by chunk, A id, B id, number. Product of the incidences (chunk, A id) x group and group x B id."""
    keys, row = np.unique(a_chunk * (1 << 32) + a_ids, return_inverse=True)
    left = Csr.of(row, a_group, np.ones(len(row), np.int64), len(keys), groups)
    right = Csr.of(b_group, b_ids, np.ones(len(b_ids), np.int64), groups, b_width)
    made = left.times(right)
    own = keys[made.rows]
    return np.searchsorted(own >> 32, np.arange(chunks + 1)), own & 0xFFFFFFFF, made.columns, made.values


class Pair:
    """Both tokenizers with the bytes of their ids; one for each Python worker and pair of files."""

    def __init__(self, a: str, a_ranks: str, b: str) -> None:
        import base64

        import public_tokenizers as P
        import sentencepiece
        import tiktoken

        self.a = P.path(a)
        with open(P.path(a_ranks), "rb") as f:
            ranks = {base64.b64decode(t): int(k) for t, k in (line.split() for line in f)}
        self.fast = tiktoken.Encoding("links", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        a_bytes = sorted(ranks, key=ranks.get)
        if list(map(ranks.get, a_bytes)) != list(range(len(ranks))):
            raise ValueError(f"{a_ranks}: ids have gaps")
        self.piece = sentencepiece.SentencePieceProcessor(model_file=P.path(b))
        pieces = [self.piece.id_to_piece(k) for k in range(self.piece.get_piece_size())]
        self.b_apart = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE_MARK, " ").encode() for p in pieces]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        numbers = lambda n, end: [b"%d%s" % (k, end) for k in range(n)]
        self.written = pa.array([*numbers(self.n_a, b","), *numbers(self.n_a, b"|"), *numbers(self.n_b, b","), *numbers(self.n_b, b";")], pa.large_binary())

    @classmethod
    def load(cls, a: str, a_ranks: str, b: str) -> "Pair":
        if (a, a_ranks, b) not in _loaded:
            _loaded[a, a_ranks, b] = cls(a, a_ranks, b)
        return _loaded[a, a_ranks, b]

    @cached_property
    def slow(self):
        """A as it is written, for the few words that need it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.a)
        made.encode_special_tokens = True
        return made

    @staticmethod
    def _same(table: pa.Array, ids: list[int], text: bytes) -> bool:
        laid = table.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(laid.buffers()[1], "<i8") if len(laid) else (0,)
        return ends[len(laid)] == len(text) and (not text or memoryview(laid.buffers()[2]).cast("B")[: len(text)] == text)

    def _alone(self, chunk: str) -> tuple[list[int], list[int], bool]:
        a, b = self.slow.encode(f" {chunk}", add_special_tokens=False).ids, self.piece.encode(chunk)
        text = f" {chunk}".encode()
        return (a, b, True) if self._same(self.a_bytes, a, text) and self._same(self.b_bytes, b, text) else ([], [], False)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A tokens by chunk, B ids, B tokens by chunk, whether both give the chunk's bytes back)."""
        chunks, sizes = words.to_pylist(), pc.binary_length(words).to_numpy().astype(np.int64)
        alone = pc.match_substring_regex(words, ODD_WORDS).to_pylist()
        found: dict[int, tuple[list[int], list[int], bool]] = {}
        calls: list[list[int]] = [[]]
        size = 0
        for k, c in enumerate(chunks):
            if alone[k]:
                found[k] = self._alone(c)
                continue
            if size > CALL_CHARS:
                calls.append([])
                size = 0
            calls[-1].append(k)
            size += len(c) + 1
        order, ids, counts = [], ([], []), ([], [])
        for call in filter(None, calls):
            text = " ".join([chunks[k] for k in call])
            data = f" {text}".encode()
            a, b = self.fast.encode_ordinary(f" {text}"), self.piece.encode(text)
            ends = np.cumsum(sizes[call] + 1)
            cuts = []
            for table, lengths, own in ((self.a_bytes, self.a_lengths, a), (self.b_bytes, self.b_lengths, b)):
                at = np.cumsum(lengths[np.array(own, np.int64)])
                place = np.searchsorted(at, ends)
                if not self._same(table, own, data) or (at[place] != ends).any():
                    break
                cuts.append(np.diff(place + 1, prepend=0))
            if len(cuts) < 2:
                found |= {k: self._alone(chunks[k]) for k in call}
                continue
            order.append(np.array(call))
            for side, own in enumerate((a, b)):
                ids[side].append(np.array(own, np.int64))
                counts[side].append(cuts[side])
        good = np.ones(len(chunks), bool)
        for k, (a, b, fine) in found.items():
            good[k] = fine
            order.append(np.array([k]))
            for side, own in enumerate((a, b)):
                ids[side].append(np.array(own, np.int64))
                counts[side].append(np.array([len(own)]))
        place = np.empty(len(chunks), np.int64)
        laid = np.concatenate(order) if order else np.zeros(0, np.int64)
        place[laid] = np.arange(len(laid))
        sides = []
        for side in range(2):
            every, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids[side], counts[side]))
            sides += [spread(every, starts_of(n), place), n[place] if len(n) else n]
        return *sides, good


def spread(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given rows, one row after another."""
    lengths = np.diff(starts)[rows]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts[rows] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def cut_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, the number of words of each, and the order in which the texts' words lie."""
    odd = [k for k, t in enumerate(texts) if ODD_SPACES.search(t)]
    rest = np.setdiff1d(np.arange(len(texts)), odd)
    plain = pc.split_pattern(pa.array([texts[k] for k in rest], pa.large_string()), " ")
    others = [CUT.split(texts[k]) for k in odd]
    words = pa.concat_arrays([plain.flatten(), pa.array([w for o in others for w in o], pa.large_string())])
    counts = np.concatenate([np.diff(plain.offsets.to_numpy()), np.array([len(o) for o in others], np.int64)]).astype(np.int64)
    return words, counts, np.concatenate([rest, np.array(odd, np.int64)]).astype(np.int64)


def aligned(pair: Pair, texts: list[str]) -> dict[str, np.ndarray | list]:
    """A block: per text n_a, n_b, n_groups, n_links, groups_sha256, its different words and how often it has them; per word its links as pair numbers; per pair ids and texts that link it."""
    import hashlib

    if pair.b_apart:
        words, counts, order = cut_words(texts)
    else:
        words, counts, order = pa.array(texts, pa.large_string()), np.ones(len(texts), np.int64), np.arange(len(texts))
    coded = words.dictionary_encode()
    code, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    a_ids, a_n, b_ids, b_n, good = pair.encode(different)
    a_group, b_group, groups, parts = np.empty(len(a_ids), np.int64), np.empty(len(b_ids), np.int64), 0, []
    a_at, b_at = starts_of(a_n), starts_of(b_n)
    for k in range(0, len(a_n), WORDS_AT_ONCE):
        end = min(k + WORDS_AT_ONCE, len(a_n))
        a_cut, b_cut = slice(a_at[k], a_at[end]), slice(b_at[k], b_at[end])
        if a_cut.start == a_cut.stop:
            parts.append((np.zeros(end - k + 1, np.int64), *[np.zeros(0, np.int64)] * 3))
            continue
        ga, gb = groups_of(pair.a_lengths[a_ids[a_cut]], pair.b_lengths[b_ids[b_cut]])
        parts.append(linked_ids(a_ids[a_cut], np.repeat(np.arange(end - k), a_n[k:end]), ga, b_ids[b_cut], gb, end - k, int(ga[-1]) + 1, pair.n_b))
        a_group[a_cut], b_group[b_cut] = ga + groups, gb + groups
        groups += int(ga[-1]) + 1
    link_starts = starts_of(np.concatenate([np.diff(x[0]) for x in parts])) if parts else np.zeros(1, np.int64)
    la, lb, times = (np.concatenate([x[c] for x in parts]) if parts else np.zeros(0, np.int64) for c in (1, 2, 3))
    del parts
    group_word = np.zeros(groups, np.int64)
    group_word[a_group] = np.repeat(np.arange(len(a_n)), a_n)

    # the ids as text: A tokens before B tokens within a group
    a_in, b_in = (np.bincount(g, minlength=groups) for g in (a_group, b_group))
    text_ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    a_last, b_last = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (a_group, b_group))
    text_ids[np.arange(len(a_ids)) + starts_of(b_in)[a_group]] = a_ids + pair.n_a * a_last
    text_ids[np.arange(len(b_ids)) + starts_of(a_in)[1:][b_group]] = b_ids + 2 * pair.n_a + pair.n_b * b_last
    spelt = pair.written.take(pa.array(text_ids))
    token_ends = np.frombuffer(spelt.buffers()[1], "<i8")[: len(spelt) + 1] if len(spelt) else np.zeros(1, np.int64)
    by_word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(different), [None, pa.py_buffer(np.ascontiguousarray(token_ends[starts_of(a_n + b_n)])), spelt.buffers()[2] if len(spelt) else pa.py_buffer(b"")])
    laid = by_word.take(pa.array(code))
    at = np.frombuffer(laid.buffers()[1], "<i8")[: len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
    body = memoryview(laid.buffers()[2]).cast("B") if len(laid) and laid.buffers()[2] else memoryview(b"")

    n, bounds = len(texts), starts_of(counts)
    owner = np.repeat(order, counts)
    sums = lambda of_word: np.bincount(owner, of_word[code], n).astype(np.int64)  # noqa: E731  below 2 to the 53
    word_links = np.bincount(np.repeat(np.arange(len(different)), np.diff(link_starts)), times, len(different)).astype(np.int64)
    whole = sums((~good).astype(np.int64)) == 0
    out: dict[str, np.ndarray | list] = {k: np.where(whole, sums(v), 0) for k, v in (("n_a", a_n), ("n_b", b_n), ("n_groups", np.bincount(group_word, minlength=len(different))), ("n_links", word_links))}
    digests = [""] * n
    for k, x, y in zip(order.tolist(), at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True):
        if whole[k]:
            digests[k] = hashlib.sha256(body[x : y - 1]).hexdigest()
    out["groups_sha256"] = digests

    kept = whole[owner]
    held, often = np.unique(owner[kept] * max(len(different), 1) + code[kept], return_counts=True)
    text_of, word_of = held // max(len(different), 1), held % max(len(different), 1)
    out["text_words"] = np.searchsorted(text_of, np.arange(n + 1))
    out["words"], out["often"] = word_of.astype("<i4"), often.astype("<i4")
    pairs, number = np.unique(la * pair.n_b + lb, return_inverse=True)
    out["link_starts"], out["link_pairs"], out["link_times"] = link_starts.astype("<i8"), number.astype("<i4"), times.astype("<i8")
    out["a"], out["b"], out["texts"] = pairs // pair.n_b, pairs % pair.n_b, np.zeros(len(pairs), np.int64)
    per_word = np.diff(link_starts)
    for k in range(0, n, TEXTS_AT_ONCE):
        cut = slice(out["text_words"][k], out["text_words"][min(k + TEXTS_AT_ONCE, n)])
        linked = np.unique(np.repeat(text_of[cut], per_word[word_of[cut]]) * max(len(pairs), 1) + spread(number, link_starts, word_of[cut]))
        out["texts"] += np.bincount(linked % max(len(pairs), 1), minlength=len(pairs))
    return out


BLOCK = "block bigint, kind int, no int, a int, b int, n bigint, x binary, y binary, z binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
#: Kinds of rows of a block: its pairs, its words' links, its texts.
PAIR, WORDS, TEXT = 0, 1, 2


def blocks(docs: DataFrame, keys: list[str], text: str, files: tuple[str, str, str], block_bytes: int) -> DataFrame:
    """Rows of BLOCK with the keys; the rows of a block come from one task."""
    source = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    types = dict(source.dtypes)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size, schema = 0, None

        def made() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = rows.column(len(keys)).to_pylist()
            live = [k for k, t in enumerate(texts) if t]
            got = aligned(Pair.load(*files), [texts[k] for k in live])
            block = (part << 24) + number

            def batch(size: int, kind: int, own_keys: list[pa.Array] | None = None, /, **columns: pa.Array) -> pa.RecordBatch:
                arrays = own_keys or [pa.nulls(size, f.type) for f in schema]
                names = [f.split()[0] for f in BLOCK.split(", ")]
                kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
                columns |= {"block": pa.array(np.full(size, block)), "kind": pa.array(np.full(size, kind, np.int32))}
                arrays = [*arrays, *(columns[c].cast(kinds[f.split()[1]]) if c in columns else pa.nulls(size, kinds[f.split()[1]]) for c, f in zip(names, BLOCK.split(", "), strict=True))]
                return pa.RecordBatch.from_arrays(arrays, names=[*keys, *names])

            n = len(got["texts"])
            for k in range(0, n, 1 << 16):
                cut = slice(k, k + (1 << 16))
                yield batch(len(got["a"][cut]), PAIR, no=pa.array(np.arange(n)[cut]), a=pa.array(got["a"][cut]), b=pa.array(got["b"][cut]), n=pa.array(got["texts"][cut]))
            yield batch(1, WORDS, x=pa.array([got["link_starts"].tobytes()], pa.binary()), y=pa.array([got["link_pairs"].tobytes()], pa.binary()), z=pa.array([got["link_times"].tobytes()], pa.binary()))
            at = np.full(len(texts), -1)
            at[live] = np.arange(len(live))
            bounds = got["text_words"]
            span = [(bounds[k], bounds[k + 1]) if k >= 0 else (0, 0) for k in at.tolist()]
            numbers = {c: pa.array(np.append(got[c], 0)[at]) for c in NUMBERS}
            for k in range(0, len(texts), 500):
                cut = slice(k, k + 500)
                yield batch(len(texts[cut]), TEXT, [c.chunk(0).slice(k, 500) if c.num_chunks else c for c in rows.columns[: len(keys)]], x=pa.array([got["words"][s:e].tobytes() for s, e in span[cut]], pa.binary()), y=pa.array([got["often"][s:e].tobytes() for s, e in span[cut]], pa.binary()), groups_sha256=pa.array([got["groups_sha256"][j] if j >= 0 else "" for j in at[cut].tolist()]), **{c: v.slice(k, 500) for c, v in numbers.items()})

        for b in batches:
            schema = schema or [b.schema.field(k) for k in range(len(keys))]
            for k in range(0, b.num_rows, 50):
                held.append(b.slice(k, 50))
                size += pc.sum(pc.binary_length(held[-1].column(len(keys)))).as_py() or 0
                if size >= block_bytes:
                    yield from made()
                    held, size, number = [], 0, number + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield from made()

    return source.mapInArrow(apply, ", ".join([*(f"`{k}` {types[k]}" for k in keys), BLOCK]))


def counted(rows: DataFrame, where: str) -> DataFrame:
    """Of each block's pairs the count over all texts, and whether it is the A id's highest: block, no, n, best."""
    own = rows.where(F.col("kind") == PAIR).select("block", "no", "a", "b", "n")
    totals = own.groupBy("a", "b").agg(F.sum("n").alias("total"))
    # at most the size of B's vocabulary has one A id
    totals = written(totals.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("a"))), f"{where}/totals")
    return lookup(own.select("block", "no", "a", "b"), totals, ["a", "b"], own.count(), F.col("block"), "inner").select("block", "no", F.col("total").alias("n"), "best")


def token_links(docs: DataFrame, keys: list[str], text: str = "text", a: str = "byte_bpe_50k.json", a_ranks: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: keys, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair has the highest count of all pairs of its A id, ties included; count_sum: the counts of
    all links. a, b: file names of public_tokenizers, read on the executors; a_ranks: the vocabulary of a as ranks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    where = shared_dir(spark, "token-links")
    own = own_keys(keys, *NUMBERS, "n_best", "count_sum", "groups_sha256")
    named = docs.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], F.col(f"`{text}`").alias("_body"))
    rows = written(blocks(named, own, "_body", (a, a_ranks, b), block_bytes), f"{where}/blocks")
    values = counted(rows, where).select("block", F.lit(PAIR).alias("kind"), "no", "n", "best")
    back = values.unionByName(rows.where(F.col("kind") != PAIR).drop("a", "b", "n"), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = back.select(*own, "block", "kind", "no", "n", "best", "x", "y", "z", *NUMBERS, "groups_sha256").repartition(parts, "block").sortWithinPartitions("block", "kind", "no")
    first = len(own)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        of_word = np.zeros((2, 0), np.int64)
        for batch in batches:
            kind = batch.column(first + 1).to_numpy()
            cuts = np.flatnonzero(np.diff(kind, prepend=-1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(kind)], strict=True):
                part = batch.slice(s, e - s)
                if kind[s] == PAIR:
                    pairs.append((part.column(first + 4).to_numpy(zero_copy_only=False).astype(np.int64), part.column(first + 3).to_numpy()))
                elif kind[s] == WORDS:
                    for row in range(e - s):
                        starts, number, times = (np.frombuffer(part.column(first + c)[row].as_py(), t) for c, t in ((5, "<i8"), (6, "<i4"), (7, "<i8")))
                        best, n = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
                        of_word = np.stack([np.diff(np.concatenate([[0], np.cumsum(times * v[number])])[starts]) for v in (best, n)])
                        pairs = []
                else:
                    words, often = (part.column(first + c) for c in (5, 6))
                    got = [of_word[:, np.frombuffer(w.as_py(), "<i4")] @ np.frombuffer(o.as_py(), "<i4").astype(np.int64) for w, o in zip(words, often, strict=True)]
                    n_best, count_sum = (pa.array([int(g[k]) for g in got], pa.int64()) for k in range(2))
                    yield pa.RecordBatch.from_arrays([*part.columns[:first], *part.columns[first + 8 : first + 12], n_best, count_sum, part.column(first + 12)], names=[*own, *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    types = dict(named.dtypes)
    done = dealt.mapInArrow(sums, ", ".join([*(f"`{k}` {types[k]}" for k in own), *(f"{c} bigint" for c in (*NUMBERS, "n_best", "count_sum")), "groups_sha256 string"]))
    return done.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *NUMBERS, "n_best", "count_sum", "groups_sha256")
