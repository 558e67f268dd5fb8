"""Concatenate and cut: documents' tokens form one stream, which is cut into windows of a fixed length.

A first pass tokenises and records each partition's token total and each document's place in its
partition. Prefix sums of the totals, one number for each input partition, then give every document its
place in the whole stream, and a second pass cuts at multiples of the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .process import bounded_batches, keep_nothing, kept
from .scratch import Scratch

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class PackingConfig:
    """Window length, the id after each document, and the ``tokenizers`` file."""

    tokenizer: str
    window: int = 2048
    end_id: int = 1
    cached: int = 700_000


#: Characters whose kind (letter, number, space, other) has been the same in all versions of Unicode for long:
#: Latin, Cyrillic, kana, Han, Hangul. Words with others are left to the library, which may know another version.
_SETTLED = re.compile("[\x21-\x7e\xa1-\u024f\u0400-\u0481\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


class WordTokenizer:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False)``, with words' ids remembered.

    For byte-level BPE tokenizers that drop white space, split the rest into pieces by a regular expression
    and mark the end of a piece by a suffix. Vocabulary, merges, pattern and normaliser come from the file;
    merging is done for many pieces at once. Texts of special tokens count as ordinary text.
    """

    LONGEST = 24  #: bytes of a piece that is merged here; longer ones go to the library

    def __init__(self, path: str, cached: int):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V1).findall
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.size = np.int64(size)
        self.plain = self.find("ab") == ["ab"] and self.find("ab.") == ["ab", "."] and self.find("ab,") == ["ab", ","]
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c in [*map(chr, range(0x80)), *(chr(k) for n in (0x80, 0x800, 0x10000) for k in range(n, min(n * 32, 0x110000), max(1, n >> 6)) if not 0xD800 <= k < 0xE000)]:
            for byte, letter in zip(c.encode(), letters.pre_tokenize_str(c)[0][0], strict=True):
                self.inner[byte], self.final[byte] = vocab[letter], vocab[letter + suffix]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([vocab[x] * size + vocab[y] for x, y in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)
        self.cached = cached
        self.words: dict[int, bytes] = {}  # by the word's hash
        self.old: dict[int, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    _NONE = np.int32(2**31 - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbours; ``_NONE`` where there is none or a neighbour is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (right >= 0) & (left >= 0), self.rank[at], self._NONE)

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of about equal length: the merge of least rank, leftmost first, until none is left."""
        n, width = len(pieces), max(map(len, pieces)) + 1
        length = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < length[:, None], self.inner[data], -1)
        every = np.arange(n)
        ids[every, length - 1] = self.final[data[every, length - 1]]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = every
        while len(live):
            own, least = ids[live], ranks[live]
            at = least.argmin(axis=1)
            best = least[np.arange(len(live)), at]
            more = best != self._NONE
            if not more.all():
                live, own, least, at, best = live[more], own[more], least[more], at[more], best[more]
            if not len(live):
                break
            rows = np.arange(len(live))
            place = np.arange(width)
            own = np.take_along_axis(own, np.minimum(place + (place > at[:, None]), width - 1), axis=1)
            own[rows, at] = self.made[best]
            least = np.take_along_axis(least, np.minimum(place[:-1] + (place[:-1] > at[:, None]), width - 2), axis=1)
            least[:, -1] = self._NONE
            least[rows, at] = self._ranks(own[rows, at], own[rows, np.minimum(at + 1, width - 1)])
            inside = at > 0
            before = np.maximum(at - 1, 0)
            left = self._ranks(own[rows, before], own[rows, at])
            least[rows[inside], before[inside]] = left[inside]
            ids[live], ranks[live] = own, least
        count = (ids >= 0).sum(axis=1)
        raw, step = ids[ids >= 0].astype(self.dtype).tobytes(), self.dtype.itemsize
        end = (np.cumsum(count) * step).tolist()
        return [raw[b:e] for b, e in zip([0, *end[:-1]], end, strict=True)]

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        out, short = {}, []
        for p in pieces:
            raw = p.encode()
            if len(raw) > self.LONGEST:
                out[p] = self.direct(p)
            else:
                short.append((len(raw), raw, p))
        short.sort()
        for b in range(0, len(short), 4096):
            some = short[b : b + 4096]
            out.update(zip((p for _, _, p in some), self._merged([raw for _, raw, _ in some]), strict=True))
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of words that are not known yet."""
        normal = self.tokenizer.normalizer.normalize_str(" ".join(new)).split(" ")
        if len(normal) != len(new):
            normal = list(map(self.tokenizer.normalizer.normalize_str, new))
        find, plain = self.find, self.plain
        # Where letters are one piece, and one of these signs after them another, the pattern need not be asked.
        split = [find(w) if not plain else (w,) if w.isalpha() else (w[:-1], w[-1]) if w[-1:] in (".", ",") and w[:-1].isalpha() else find(w) for w in normal]
        get, join = self._pieces({p for s in split for p in s}).__getitem__, b"".join
        out = [get(parts[0]) if len(parts) == 1 else join(map(get, parts)) for parts in split]
        for k, word in enumerate(new):
            if not (word.isascii() and word.isprintable() or _SETTLED.fullmatch(word)):
                out[k] = self.direct(word)
        return out

    def _known(self, words: W.Words, hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Ids of distinct words, given by their hashes and a place of each."""
        if len(self.words) > self.cached:
            self.words, self.old = {}, self.words
        keys = hashes.tolist()
        ids = list(map(self.words.get, keys))
        missing = [k for k, x in enumerate(ids) if x is None]
        new = []
        for k in missing:
            if (known := self.old.get(keys[k])) is not None:
                ids[k] = self.words[keys[k]] = known
            else:
                new.append(k)
        if new:
            raw = words.data.tobytes()
            spelt = [raw[b:e].decode() for b, e in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)]
            for k, own in zip(new, self._learn(spelt), strict=True):
                ids[k] = self.words[keys[k]] = own
        return ids

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, given by their bytes and offsets, and where each text's begin."""
        words = W.split(data, at, lower=False)
        hashes, first, which = np.unique(W.word_hashes(words), return_index=True, return_inverse=True)
        known = self._known(words, hashes, first)
        length = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(known), self.dtype)
        times = length[which]
        upto = np.concatenate([[0], np.cumsum(times)])
        ids = flat[np.repeat(start[which] - upto[:-1], times) + np.arange(upto[-1])]
        return ids, upto[words.first]


def word_tokenizer(path: str, cached: int) -> WordTokenizer:
    """One for each process, so that later tasks find the words of earlier ones."""
    return kept(("tokenizer", path, cached), lambda: WordTokenizer(path, cached))


def tokenised(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """``doc_id``, its ids with the end id, and where they begin among those of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(config.tokenizer, config.cached)
        part, total, width = TaskContext.get().partitionId(), 0, tokens.dtype.itemsize
        for batch in batches:
            for row, end, data, at in W.chunks(batch.column("text")):
                ids, first = tokens.encode(data, at)
                ids = np.insert(ids, first[1:], config.end_id)
                first = first + np.arange(len(first))
                buffers = [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(ids)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array([part] * (end - row), pa.int32()), pa.array(first[:-1] + total), pa.array(np.diff(first)), pa.Array.from_buffers(pa.binary(), end - row, buffers)],
                    names=["doc_id", "part", "begin", "doc_tokens", "ids"],
                )
                total += int(first[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, begin long, doc_tokens long, ids binary")


def pack(docs: DataFrame, config: PackingConfig, scratch: Scratch | None = None) -> DataFrame:
    """Cut the stream of all documents' tokens into windows; one row for each document's part in a window.

    ``doc_id``; ``start``, the document's ids before the piece; ``length``; ``doc_tokens``, with the end id;
    ``sequence_id`` and ``offset`` of the piece in its window; ``begins`` and ``ends``, whether the piece
    holds the document's first and last id; ``ids``, little-endian unsigned 32-bit. A null text counts as
    empty and is the end id alone. Only the last window can be short. Repeated rows are packed as often as
    they come; a null doc_id stays null; other columns are not read; no rows give no rows. ``scratch``: the
    caller's folder.
    """
    bounded_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    stream = scratch.write(tokenised(docs, config), "stream")
    totals = {r["part"]: r["n"] for r in stream.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    parts = sorted(totals)
    base = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0)))
    window = config.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            begin = batch.column("begin").to_numpy() + np.array([base[p] for p in batch.column("part").to_pylist()], np.int64)
            n = batch.column("doc_tokens").to_numpy()
            first, last = begin // window, (begin + n - 1) // window
            doc = np.repeat(np.arange(len(n)), last - first + 1)
            sequence = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
            low = np.maximum(sequence * window, begin[doc])
            high = np.minimum((sequence + 1) * window, (begin + n)[doc])
            ids, cut, wide = batch.column("ids"), [], {}
            for d, s, e in zip(doc.tolist(), (low - begin[doc]).tolist(), (high - begin[doc]).tolist(), strict=True):
                if d not in wide:
                    raw = ids[d].as_py()
                    wide = {d: np.frombuffer(raw, f"<u{len(raw) // int(n[d])}").astype("<u4")}
                cut.append(wide[d][s:e].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)), pa.array(low - begin[doc]), pa.array(high - low), pa.array(n[doc]),
                    pa.array(sequence), pa.array(low - sequence * window), pa.array(low == begin[doc]), pa.array(high == (begin + n)[doc]), pa.array(cut, pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "begins", "ends", "ids"],
            )

    return stream.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, begins boolean, ends boolean, ids binary")


def sequences(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Whole windows from their pieces: ``sequence_id, n_tokens, ids``, filled up with zero ids."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", "n_tokens", F.rpad(joined, 4 * window, F.lit(b"\0")).alias("ids"))


def packing_digest(docs: DataFrame, config: PackingConfig, scratch: Scratch | None = None) -> DataFrame:
    """``pack`` with the ids as their CRC-32."""
    return pack(docs, config, scratch).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
