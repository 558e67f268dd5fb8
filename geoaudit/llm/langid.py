"""Language identification by cross-parsing against suffix automata of labelled text.

Each language's automaton holds the words of a bounded sample of its documents. A word is parsed, from
left to right, into the longest phrases that occur in the automaton; phrases end with the word, and a
letter that occurs nowhere counts as a phrase and a half. The language that needs the fewest phrases for
its number of letters wins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .decontam import GeneralisedSuffixAutomaton
from .process import bounded_batches, kept
from .rows import text_of, with_text

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of letters, after lower-casing, and of all that is not ASCII.
_RUN = np.zeros(256, bool)
_RUN[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class LangIdConfig:
    """Bounds of the sample that each automaton is built from, and the words whose parses are remembered.

    All values of ``lang`` are learnt. ``all_words`` bounds the words of all automata together: from 200 languages
    on, each has a share of it, and at least one word.
    """

    sample_docs: int = 400
    sample_words: int = 20_000
    all_words: int = 4_000_000
    cached: int = 200_000


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower()) if text else []


class CrossParser:
    """Phrase counts of words under one language's automaton."""

    def __init__(self, words: list[str]):
        automaton = GeneralisedSuffixAutomaton()
        for word in words:
            automaton.add(map(ord, f" {word} "))
        # One table of transitions is much smaller than one for each state.
        self.go = {(state << 21) | symbol: to for state, edges in enumerate(automaton.next) for symbol, to in edges.items()}

    def phrases(self, word: str) -> float:
        """Longest-match phrases that spell the word with a space on both sides."""
        go, state, count = self.go, 0, 0.0
        for c in map(ord, f" {word} "):
            to = go.get((state << 21) | c)
            if to is None:
                count += 1.0 if state else 0.0
                to = go.get(c, 0)
                if not to:
                    count += 1.5
            state = to
        return count + (1.0 if state else 0.0)


class LanguageModel:
    """One parser for each language, in the order that settles ties; scores texts by phrases a letter."""

    def __init__(self, sample: dict[str, list[str]], cached: int):
        self.languages = list(sample)
        self.parsers = [CrossParser(sample[x]) for x in self.languages]
        self.cached = cached
        self.known: dict[int, tuple[float, ...]] = {}

    def _measured(self, run: str) -> tuple[float, ...]:
        """Words, letters and each language's phrases of a run of letters and of what is not ASCII."""
        own = letter_words(run)
        return (len(own), sum(map(len, own)), *(sum(map(p.phrases, own)) for p in self.parsers))

    def _totals(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same, added up for each text; each distinct run is measured once."""
        words = W.split(data, at, _RUN)
        hashes, first, which = np.unique(W.word_hashes(words), return_index=True, return_inverse=True)
        if len(self.known) > self.cached:
            self.known.clear()
        raw, rows = words.data.tobytes(), []
        for key, b, e in zip(hashes.tolist(), words.start[first].tolist(), words.end[first].tolist(), strict=True):
            row = self.known.get(key)
            if row is None:
                row = self.known[key] = self._measured(raw[b:e].decode())
            rows.append(row)
        table = np.array(rows, float).reshape(len(rows), 2 + len(self.languages))
        return np.stack([np.bincount(words.doc, c[which], len(at) - 1) for c in table.T], axis=1)

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        """Languages and scores: 0 to 1, how far the winner's phrases fall short of the next one's."""
        total = np.concatenate([np.zeros((0, 2 + len(self.languages))), *(self._totals(data, at) for _, _, data, at in W.chunks(column))])
        if not self.languages:
            return [UNDETERMINED] * len(total), [0.0] * len(total)
        told = total[:, 1] > 0
        rate = total[:, 2:] / np.maximum(total[:, 1:2], 1)
        best = rate.argmin(axis=1)
        score = np.ones(len(total))
        if len(self.languages) > 1:
            two = np.partition(rate, 1, axis=1)[:, :2]
            margin = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-300)
            score = 1 / (1 + np.exp(-margin * 4.0 * np.sqrt(total[:, 0])))  # evidence grows with the words seen
        return [self.languages[k] if t else UNDETERMINED for k, t in zip(best.tolist(), told.tolist(), strict=True)], np.where(told, score, 0.0).tolist()


def learn_sample(training: DataFrame, config: LangIdConfig) -> dict[str, list[str]]:
    """Distinct words of some documents of each language, the same ones however the rows are laid out.

    Documents are taken in the order of a hash of their id and text, ``sample_docs`` at most; words in the
    order in which they come, ``sample_words`` at most (or the language's share of ``all_words``). Only hashes within a rate that leaves about four
    times as many as needed are ranked, so that no language is ranked as a whole.
    """
    rows = training.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # A row for each label, of which all words are sent out below.
    rates = rows.sparkSession.createDataFrame([(lang, min(1.0, (4 * config.sample_docs + 20) / n)) for lang, n in counts.items()], "lang string, rate double")
    some = rows.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * float(1 << 30))
    most = max(1, min(config.sample_words, config.all_words // len(counts)))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).where(F.col("rank") <= config.sample_docs)
    words: dict[str, dict[str, None]] = {lang: {} for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in ranked.orderBy("lang", "rank").toLocalIterator():
        own = words[r["lang"]]
        for w in letter_words(r["text"]):
            if len(own) >= most:
                break
            own.setdefault(w)
    return {lang: list(own) for lang, own in words.items()}


def _predict(rows: DataFrame, model_words: dict[str, list[str]], config: LangIdConfig) -> DataFrame:
    bounded_batches(rows.sparkSession)
    sent, key = rows.sparkSession.sparkContext.broadcast(model_words), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(key, lambda: LanguageModel(sent.value, config.cached))
        for batch in batches:
            language, score = model.predict(text_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(language, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    kind = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, kind)


def identify(docs: DataFrame, training: DataFrame, columns: list[str], config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Each document's ``columns`` as struct ``row``, with ``lang_pred`` and ``score``.

    ``training`` has ``doc_id, text, lang``; rows with a null text or lang are not learnt from. A text that
    is null, empty or without letters, and any text if nothing was learnt, is ``und`` with score 0. Ties go
    to the language with more labelled documents, then to the first by name. The samples, ``all_words`` words at
    most beside one for each label, are collected and broadcast.
    """
    return _predict(with_text(docs, columns), learn_sample(training, config), config)


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the doc_id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def language_report(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Predict every document's language from the documents that are not held out."""
    out = identify(docs, docs.where(~held_out(3, 1)), ["doc_id"], config).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """``docs`` without those whose language cannot be told (``und``), with ``lang`` as it was told.

    All columns stay; of a table without ``lang`` nothing is learnt. By the rules of ``identify``: rows with a
    null text, or without letters, go, and repeated rows come as often as they do. Labels are learnt from all
    rows that have one.
    """
    at = next((c for c in docs.columns if c.lower() == "lang"), None)
    found = identify(docs, docs if at else docs.withColumn("lang", F.lit(None).cast("string")), docs.columns, config).where(F.col("lang_pred") != UNDETERMINED)
    return (found.withColumn("row", F.col("row").withField(at, F.col("lang_pred"))) if at else found).select("row.*")
