"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Training words are streamed through the automaton, which tracks the longest run of words, ending at each
word, that occurs in some item. A run of ``window`` words is an occurrence of a window; an item with fewer
words is one window of its own length. Stretches that cannot hold a window, as two neighbouring words
there follow each other in no item, are found with numpy and not streamed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .process import bounded_batches, keep_nothing
from .rows import text_of, with_text
from .scratch import Scratch


@dataclass(frozen=True)
class DecontamConfig:
    """Window length in words, coverage limit as hits * ``one_in`` >= words, and words in one automaton.

    ``block_words`` bounds what is broadcast: a larger benchmark is streamed against in several passes.
    """

    window: int = 13
    one_in: int = 20
    block_words: int = 100_000


class GeneralisedSuffixAutomaton:
    """All runs of words of the added sequences; states hold runs that end at the same places."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of the runs that p's runs make with ``symbol``, parted from q's longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[own], self.link[q] = self.link[q], own
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = own
            p = self.link[p]
        return own

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for symbol in sequence:
            p = last
            if symbol in self.next[p]:
                last = self._split(p, symbol, self.next[p][symbol])
                continue
            last = self._state(self.length[p] + 1, {})
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                # _split may move the link of the state that p leads to, never that of the new one.
                self.link[last] = self._split(p, symbol, self.next[p][symbol])

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """Follow one more symbol: the state and the length of the longest run that ends with it."""
        edges = self.next[state]
        while symbol not in edges:
            state = self.link[state]
            if state < 0:
                return 0, 0
            edges, matched = self.next[state], self.length[state]
        return edges[symbol], matched + 1

    def shorten(self, state: int, length: int) -> int:
        """The state that holds the last ``length`` symbols of a longer run."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Benchmark:
    """The automaton of some items, and which items each window belongs to."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        """``items``: item_id and the words' hashes."""
        self.window = window
        self.words = np.unique(np.array([h for _, seq in items for h in seq], np.uint64))
        coded = [(item, np.searchsorted(self.words, np.array(seq, np.uint64)).tolist()) for item, seq in items if seq]
        pairs = [(np.array(s[:-1], np.int64) * len(self.words) + np.array(s[1:], np.int64)) for _, s in coded]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.least = min([window, *(len(s) for _, s in coded)])
        self.automaton = a = GeneralisedSuffixAutomaton()
        for _, seq in coded:
            a.add(seq)
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, seq in coded:
            state = matched = 0
            for symbol in seq:
                state, matched = a.step(state, matched, symbol)
                if matched >= window:
                    self.items.setdefault(a.shorten(state, window), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(a.shorten(state, len(seq)), []).append((len(seq), item))

    def _short_in(self, state: int, matched: int) -> Iterator[tuple[int, int]]:
        while state > 0:
            for length, item in self.short.get(state, ()):
                if length <= matched:
                    yield length, item
            state = self.automaton.link[state]

    def stream(self, symbols: list[int], hit: np.ndarray, found: set[int]) -> None:
        """Mark in ``hit`` the words inside occurrences of windows, and add their items to ``found``."""
        a, window = self.automaton, self.window
        state = matched = 0
        for k, symbol in enumerate(symbols):
            state, matched = a.step(state, matched, symbol)
            if matched >= window:
                hit[k + 1 - window : k + 1] = True
                found |= self.items[a.shorten(state, window)]
            if self.short:
                for length, item in self._short_in(state, matched):
                    hit[k + 1 - length : k + 1] = True
                    found.add(item)

    def scan(self, words: W.Words, hit: np.ndarray, found: dict[int, set[int]]) -> None:
        """Stream a run of texts; ``found``: the items of each text in which any occurs."""
        if not len(self.words) or not len(words.start):
            return
        hashes = W.word_hashes(words)
        code = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[code] == hashes
        joined = np.zeros(len(code) + 1, bool)  # to the word before
        if len(self.pairs):
            pair = code[:-1].astype(np.int64) * len(self.words) + code[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:-1] = known[:-1] & known[1:] & (words.doc[:-1] == words.doc[1:]) & (self.pairs[at] == pair)
        begin = np.flatnonzero(known & ~joined[:-1])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        for b, e in zip(begin[end - begin >= self.least].tolist(), end[end - begin >= self.least].tolist(), strict=True):
            own: set[int] = set()
            self.stream(code[b:e].tolist(), hit[b:e], own)
            if own:
                found.setdefault(int(words.doc[b]), set()).update(own)


def _item_words(text: str | None) -> list[int]:
    words = W.split(*W.utf8(pa.array([text], pa.large_string())), W.WORD)
    return W.word_hashes(words).tolist()


def _blocks(benchmark: DataFrame, config: DecontamConfig) -> Iterator[Benchmark]:
    """Automata of at most ``block_words`` words. A longer item is cut into pieces that share all but one
    word of a window, so that each window is whole in one of them."""
    block: list[tuple[int, list[int]]] = []
    size = 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    for item, text in rows.toLocalIterator():
        words, step = _item_words(text), max(1, config.block_words - config.window + 1)
        for at in range(0, max(1, len(words) - config.window + 1), step):
            piece = words[at : at + step + config.window - 1]
            if block and size + len(piece) > config.block_words:
                yield Benchmark(block, config.window)
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    yield Benchmark(block, config.window)


_STATE = [pa.field("hit", pa.binary()), pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.int64()))]


def _scan(rows: DataFrame, benchmark: Benchmark) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            text, before_hit, before_items = text_of(batch), batch.column("hit"), batch.column("items").to_pylist()
            for row, end, data, at in W.chunks(text):
                words = W.split(data, at, W.WORD)
                hit, found = np.zeros(len(words.start), bool), {}
                sent.value.scan(words, hit, found)
                masks, n_hit, items = [], [], []
                for d in range(end - row):
                    own, known = hit[words.first[d] : words.first[d + 1]], found.get(d, set())
                    if before_items[row + d]:
                        own = own | np.unpackbits(np.frombuffer(before_hit[row + d].as_py(), np.uint8), count=len(own)).astype(bool)
                        known = known | set(before_items[row + d])
                    masks.append(np.packbits(own).tobytes() if known else b"")
                    n_hit.append(int(np.count_nonzero(own)) if known else 0)
                    items.append(sorted(known))
                state = [masks, np.diff(words.first), n_hit, items]
                same = [c for c in batch.schema.names if c in ("row", "text")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, end - row) for c in same), *(pa.array(x, f.type) for x, f in zip(state, _STATE, strict=True))],
                    names=[*same, *(f.name for f in _STATE)],
                )

    return rows.mapInArrow(run, rows.schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, columns: list[str], config: DecontamConfig = DecontamConfig(), scratch: Scratch | None = None) -> DataFrame:
    """Each document's ``columns`` as struct ``row`` (and its ``text``), and what of the benchmark it holds.

    ``hit`` has a bit for each word, in bytes (empty if none is hit); ``n_words``, ``n_hit`` and ``items``
    count words, hit words and list the ids of the items that occur. ``benchmark`` has ``item_id`` and
    ``text``. Words are runs of digits, letters and all that is not ASCII, with A-Z in lower case. Null
    texts have no words; rows of the benchmark with a null id or text, or without words, hold no window.
    Repeated rows on either side, and further columns of any name, do no harm. One row for each row of
    ``docs``; an empty benchmark hits nothing. ``scratch``: the caller's folder.
    """
    nothing = {"hit": F.lit(b""), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<long>")}
    out = with_text(docs, columns).withColumns(nothing)
    bounded_batches(docs.sparkSession)
    scratch, before = scratch or Scratch(docs.sparkSession, "decontam"), None
    for k, block in enumerate(_blocks(benchmark, config)):
        if k:
            out = scratch.write(out, "hits")
            if before is not None:
                scratch.drop(before)  # only the last block's table is read again
            before = out
        out = _scan(out, block)
    return out


def _contaminated(config: DecontamConfig) -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * config.one_in >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for each document, by the rules of ``benchmark_hits``.

    Contaminated: some word is hit, and hits * ``one_in`` >= words.
    """
    found = benchmark_hits(docs, benchmark, ["doc_id"], config)
    return found.select("row.doc_id", "n_words", "n_hit", "items", _contaminated(config).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig(), longest_span: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without contaminated documents; all columns and the other texts stay as they are.

    With ``longest_span``, hit spans of more words than that are also cut out of the texts that stay.
    """
    found = benchmark_hits(docs, benchmark, docs.columns, config, scratch).where(~_contaminated(config))
    if longest_span is None:
        return found.select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, h, longest_span) if h else t for t, h in zip(text_of(batch).to_pylist(), batch.column("hit").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "cut"])

    cut = found.select("row", "hit").mapInArrow(run, found.select("row").schema.add("cut", "string"))
    return cut.withColumn("row", F.col("row").withField("text", F.col("cut"))).select("row.*")


def _cut(text: str, hit: bytes, longest: int) -> str:
    """Cut hit spans of more than ``longest`` words out of a text, with what stands between their words."""
    raw = text.encode()
    words = W.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), W.WORD)
    bits = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words.start)).astype(np.int8)
    kept, done = [], 0
    for s, e in np.flatnonzero(np.diff(bits, prepend=0, append=0)).reshape(-1, 2):
        if e - s > longest:
            kept.append(raw[done : words.start[s]])
            done = words.end[e - 1]
    return b"".join([*kept, raw[done:]]).decode()


def contamination_report(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``contamination`` with the items as their number and the SHA-256 of their ids, sorted as strings."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = contamination(docs, benchmark, config)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")
