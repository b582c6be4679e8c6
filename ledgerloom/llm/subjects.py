"""Subjects of documents: a sentence lexicon grown from labels, and a classifier chain decoded by beam search.

Words of sentences get a distribution over subjects, first from labelled documents and the subjects' descriptions,
then from all sentences of the corpus: a sentence whose known words agree on a subject teaches its other words.
Shared talk stands in sentences of all subjects and stays uninformative. The chain predicts each subject from term,
source and structure features and from the subjects before it.

Texts are cut into sentences once; what is kept of them are hash slots of their words, read by numpy in the later
passes. Words and sentences are counted in tables of a fixed number of slots, whatever the size of the corpus: none
is dropped, and those few that fall together share their counts. No text and no sentence is ever shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.session import Scratch

#: Labelled documents that the classifier is fitted on, at most (by hash of the id, so the same at every run);
#: rounds of growing; slots of words and of sentences; slots of source names among the chain's features.
MAX_LABELLED, ROUNDS, SLOTS, SOURCES = 20_000, 3, 1 << 22, 64
#: Words seen less are too rare to teach; a word of a sentence's matter is at most NEAR times as frequent as the
#: second rarest; least share of a word's evidence that must be for one subject; smoothing.
RARE, NEAR, SURE, SMOOTH = 3, 2.5, 0.5, 1.0
#: A sentence is set when it holds this share of its rarest word's mentions and stands in this share of documents.
SET_SHARE, SET_DOCS = 0.5, 0.002
BEAM = 8

_FENCE = re.compile(r"^[ \t>]*```.*?(?:^[ \t>]*```[ \t]*$|\Z)", re.S | re.M)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_ITEM = re.compile(r"^[ \t]*(?:>+[ \t]*)?(?:[-*•][ \t]+|\d+[.)][ \t]+)?")
_CODE = re.compile(r"(?: {4,}|\t)\S|[ ]*(?:@@|---|\+\+\+|diff |index )|[+-][ \t]{2,}")
_END = re.compile(r"(?<=[.!?。])[\"')\]]*\s+")
_LEAD = re.compile(r"(?:\([^()]{1,20}\)|[^\s:|]{2,20}(?:[ -][^\s:|]{1,12}){0,2}\s?:)\s+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_NAME = re.compile(r"\b\w*(?:[a-z][A-Z]|[\d_/@])\w*\b|\S*/\S*")
_NAMED = re.compile(r"[a-z][A-Z]|[\d_/@]")


def folded(text: str) -> str:
    """Without accents; for comparing terms."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _is_code(line: str) -> bool:
    """A line of code, of a diff or of data: by its beginning, its end, or both."""
    text = line.rstrip(" \t")
    if text[-1] in "{};" or _CODE.match(line):
        return True
    text = text.lstrip(" ")
    return len(text) > 1 and text[0] in "\"'{}[]" and text[-1] in "\"'{}[],:"


def raw_sentences(text: str | None) -> list[str]:
    """Sentences of a text as written; code blocks, diffs and markup are no sentences."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r", "")
    if "```" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if block:
            out.extend(_END.split(" ".join(block)))
            block.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if not bare or _is_code(line):
            close()
            continue
        head = _ITEM.match(line).end()
        if head and line[:head].strip():
            close()
        block.append(line[head:].strip())
    close()
    return out


def sentence_words(sentence: str) -> list[str]:
    """Lower-case words of a sentence without the names of code; none for less than three words."""
    lead = _LEAD.match(sentence)
    if lead:
        sentence = sentence[lead.end() :]
    if _NAMED.search(sentence):
        sentence = _NAME.sub(" ", sentence)
    words = _WORD.findall(folded(sentence).lower())
    return words if len(words) > 2 else []


def slot(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % SLOTS


class Cutter:
    """Texts to slots: of each sentence, and of its distinct words of more than two letters. Remembers to a bound."""

    def __init__(self, bound: int = 200_000):
        self.bound, self.sentences, self.words = bound, {}, {}

    def _sentence(self, raw: str) -> tuple[int, list[int]] | None:
        if len(self.sentences) > self.bound:
            self.sentences.clear()
        if len(self.words) > self.bound:
            self.words.clear()
        words, known = sentence_words(raw), self.words
        if words:
            slots = []
            for w in dict.fromkeys(words):
                if len(w) > 2:
                    at = known.get(w)
                    if at is None:
                        at = known[w] = slot(w)
                    slots.append(at)
            found = slot(" ".join(words)), slots
        else:
            found = None
        if len(raw) <= 1000:
            self.sentences[raw] = found
        return found

    def text(self, text: str | None) -> list[tuple[int, list[int]]]:
        known, out = self.sentences, []
        for raw in raw_sentences(text):
            found = known.get(raw, 0)
            if found == 0:
                found = self._sentence(raw)
            if found is not None:
                out.append(found)
        return out


CUT = "doc_id bigint, source string, code boolean, sets array<int>, sizes array<int>, words array<int>"


def cut_corpus(docs: DataFrame) -> DataFrame:
    """Per document: source, whether it holds code, slots of its sentences, their sizes, and the slots of their words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, names = Cutter(), [c.split()[0] for c in CUT.split(", ")]
        for batch in it:
            for first in range(0, batch.num_rows, 1000):  # so that output batches stay small
                part, code = batch.slice(first, 1000), []
                sets, sizes, words, ends, word_ends = [], [], [], [0], [0]
                for text in part.column(2):
                    text = text.as_py() or ""
                    code.append("```" in text or "\n    " in text)
                    for s, w in cutter.text(text):
                        sets.append(s)
                        sizes.append(len(w))
                        words.extend(w)
                    ends.append(len(sets))
                    word_ends.append(len(words))
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.bool_()), lists(ends, sets), lists(ends, sizes), lists(word_ends, words)], names)

    return docs.select("doc_id", "source", "text").mapInArrow(run, CUT)


class Sentences:
    """A batch of cut documents as flat arrays; sentences without words of known frequency keep their place."""

    def __init__(self, columns: dict[str, pa.Array]):
        flat = lambda c: columns[c].flatten().to_numpy(zero_copy_only=False)
        self.sets, self.size, self.word = flat("sets"), flat("sizes").astype("int64"), flat("words")
        self.n = len(self.sets)
        self.of = np.repeat(np.arange(self.n), self.size)
        lengths = columns["sets"].value_lengths().to_numpy(zero_copy_only=False)
        self.documents, self.doc = len(lengths), np.repeat(np.arange(len(lengths)), lengths)

    def terms(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, its sentence, frequency) of the words that carry the sentences: their matter is rarer than their frame."""
        f = often[self.word]
        ok = f >= RARE
        w, s, f = self.word[ok], self.of[ok], f[ok]
        if not len(w):
            return w, s, f
        order = np.lexsort((f, s))
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        second = f[order][first + np.minimum(1, size - 1)]
        keep = f <= np.repeat(second, size) * NEAR
        return w[keep], s[keep], f[keep]


def _arrays(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return dict(zip(batch.schema.names, batch.columns))


class _Sums:
    """Sums by integer key; merged now and then, so that they hold no more than the distinct keys."""

    def __init__(self):
        self.keys, self.values, self.held = [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        k, at = np.unique(keys, return_inverse=True)
        self.keys.append(k.astype("int64"))
        self.values.append(np.bincount(at, values, len(k)).astype(float))
        self.held += len(k)
        if self.held > 4_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            keys, values = (np.concatenate(x) if x else np.empty(0) for x in (self.keys, self.values))
            k, at = np.unique(keys.astype("int64"), return_inverse=True)
            self.keys, self.values = [k], [np.bincount(at, values, len(k)).astype(float)]
        self.held = len(self.keys[0])
        return self.keys[0], self.values[0]


def _summed(cut: DataFrame, note: Callable[[Sentences, _Sums], None], columns: tuple[str, ...] = ("sets", "sizes", "words")) -> tuple[np.ndarray, np.ndarray]:
    """One pass over all sentences that adds up by integer key; the keys are few multiples of SLOTS at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in it:
            if batch.num_rows:
                note(Sentences(_arrays(batch)), sums)
        k, v = sums.merge()
        for i in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["k", "v"])

    out = cut.select(*columns).mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # slots
    return out["k"].to_numpy("int64"), out["v"].to_numpy(float)


class Table:
    """A number per slot; it travels as the slots that aren't zero, so a small corpus has small broadcasts."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __reduce__(self):
        at = np.flatnonzero(self.values).astype("int32")
        return Table.of, (at, self.values[at])

    @staticmethod
    def of(at: np.ndarray, values: np.ndarray) -> Table:
        table = np.zeros(SLOTS, values.dtype)
        table[at] = values
        return Table(table)


def _dense(keys: np.ndarray, values: np.ndarray, part: int) -> np.ndarray:
    """The part of keys in [part * SLOTS, (part + 1) * SLOTS) as a table."""
    table, own = np.zeros(SLOTS, "float32"), keys // SLOTS == part
    table[keys[own] - part * SLOTS] = values[own]
    return table


def _frequencies(x: Sentences, sums: _Sums) -> None:
    sums.add(x.word)
    sums.add(x.sets.astype("int64") + SLOTS)


def _term_sets(x: Sentences, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the matter, their sentence's place, and for each such sentence a slot of its set of words, and its rarest word's frequency."""
    w, s, f = x.terms(often)
    if not len(w):
        return w, s, w, f
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    mixed = (w.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    slots = (np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), first) >> np.uint64(20)) % np.uint64(SLOTS)
    return w, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(s)])), slots.astype("int64"), np.minimum.reduceat(f, first)


def _subjects(score: np.ndarray, least: float) -> np.ndarray:
    """Index of the subject that each row of log-odds is sure of; the number of subjects: none."""
    top = score.argmax(axis=1)
    best = score[np.arange(len(score)), top]
    sure = (best > np.log(3)) & (1 / np.exp(score - best[:, None]).sum(axis=1) >= least)
    return np.where(sure, top, score.shape[1])


class Lexicon:
    """Sure words and their log-odds by subject; at most SLOTS rows."""

    def __init__(self, n: int, table: dict[int, np.ndarray], often: np.ndarray):
        words = np.array(sorted(t for t in table if often[t] >= RARE), "int32")
        self._fill(n, words, np.array([table[t] for t in words.tolist()], "float32").reshape(len(words), n), Table(often))

    def _fill(self, n: int, words: np.ndarray, odds: np.ndarray, often: Table) -> Lexicon:
        self.n, self.words, self.odds, self.often = n, words, odds, often.values
        self.row = np.full(SLOTS, -1, "int32")
        self.row[words] = np.arange(len(words))
        self.sure = odds.argmax(axis=1) if len(words) else np.empty(0, "int64")
        return self

    def __reduce__(self):
        return Lexicon._of, (self.n, self.words, self.odds, Table(self.often))

    @staticmethod
    def _of(*parts) -> Lexicon:
        return Lexicon.__new__(Lexicon)._fill(*parts)

    def votes(self, x: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, word, row of the table) of the known words among the sentences' matter."""
        w, s, _ = x.terms(self.often)
        at = self.row[w]
        known = at >= 0
        return s[known], w[known], at[known]

    def totals(self, x: Sentences, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((x.n, self.n))
        if len(s):
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            out[s[first]] = np.add.reduceat(self.odds[at].astype(float), first, axis=0)
        return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    return np.log((p + 0.02) / (1 / len(p) + 0.02))


def _share(counts: np.ndarray, smooth: float) -> np.ndarray:
    return (counts + smooth / len(counts)) / (counts.sum() + smooth)


def seed_counts(some: pd.DataFrame, described: list[str], n: int, often: np.ndarray) -> dict[int, np.ndarray]:
    """Word counts from labelled documents (once per document, shared among its labels) and descriptions, as if all
    subjects had as many labels."""
    acc: dict[int, np.ndarray] = {}
    labels_of = np.zeros(n)
    for labels, sets, sizes, words in zip(some["labels"], some["sets"], some["sizes"], some["words"]):
        labels_of[labels] += 1 / len(labels)
        for t in np.unique(_one(sets, sizes, words).terms(often)[0]).tolist():
            acc.setdefault(t, np.zeros(n))[labels] += 1 / len(labels)
    scale = np.where(labels_of > 0, labels_of.mean() / np.maximum(labels_of, 1e-9), 1.0)
    out = {t: c * scale for t, c in acc.items()}
    for i, text in enumerate(described):
        for t in {slot(w) for w in _WORD.findall(folded(text).lower()) if len(w) > 3}:
            out.setdefault(t, np.zeros(n))[i] += 2
    return out


def _one(sets, sizes, words) -> Sentences:
    lists = lambda v: pa.array([np.asarray(v, "int32")], pa.list_(pa.int32()))
    return Sentences({"sets": lists(sets), "sizes": lists(sizes), "words": lists(words)})


def grow(cut: DataFrame, seeds: dict[int, np.ndarray], labelled_share: float, often: np.ndarray, repeats: np.ndarray, matter: np.ndarray, n: int) -> Lexicon:
    """The lexicon taught by the labels, then ROUNDS times by all sentences.

    In each round a word is judged by what the *other* words of its sentences say, so none confirms itself.
    A word is judged in all its sentences, also where it belongs to the frame. Subjects count as equally frequent.
    The labels stay evidence. What is repeated verbatim says little more: c times count as 1 + log(c).
    """
    table = {}
    seeds = {t: c for t, c in seeds.items() if matter[t] or often[t] < RARE}
    for t, c in seeds.items():
        unseen = max(0.0, 0.75 * labelled_share * often[t] * (often[t] >= RARE) - c.sum())  # labels that a special word should have met
        p = _share(c, SMOOTH + unseen / 2)
        if p.max() >= 0.45:
            table[t] = _log_odds(p)
    context = cut.sparkSession.sparkContext
    fixed = context.broadcast((Table(matter), Table(repeats)))  # at most SLOTS entries each
    for _ in range(ROUNDS):
        shared = context.broadcast(Lexicon(n, table, often))  # at most SLOTS rows

        def note(x: Sentences, sums: _Sums, shared=shared) -> None:
            lex, judged, times = shared.value, *(t.values for t in fixed.value)
            s, w, at = lex.votes(x)
            total = lex.totals(x, s, at)
            heard = np.zeros(x.n, bool)
            heard[s] = True
            said = _subjects(total, 0.7)
            c = np.maximum(times[x.sets], 1)
            weight = (1 + np.log(c)) / c
            own = heard[x.of] & judged[x.word]
            # words that vote are judged by the others, words that don't by all
            voted = np.zeros(len(x.word), "int64")
            key = x.of.astype("int64") * SLOTS + x.word
            order = np.argsort(key, kind="stable")
            voted[order[np.searchsorted(key[order], s.astype("int64") * SLOTS + w)]] = at + 1
            target = said[x.of]
            mine = own & (voted > 0)
            if mine.any():
                target[mine] = _subjects(total[x.of[mine]] - lex.odds[voted[mine] - 1], 0.7)
            sums.add(x.word[own].astype("int64") * (n + 1) + target[own], weight[x.of[own]])

        keys, values = _summed(cut, note)
        shared.destroy()
        words, at = np.unique(keys // (n + 1), return_inverse=True)
        counts = np.zeros((len(words), n + 1))
        np.add.at(counts, (at, keys % (n + 1)), values)
        size = counts[:, :n].sum(axis=0) + 5
        table = {}
        for t, c in zip(words.tolist(), counts):
            label = seeds.get(t, np.zeros(n))
            p = _share(c[:n] / (size / size.mean()) + label, SMOOTH)
            if p.max() >= SURE and c[:n].sum() + label.sum() >= 0.1 * c.sum():
                table[t] = _log_odds(p)
    fixed.destroy()
    return Lexicon(n, table, often)


# ---- documents


def features(columns: dict[str, pa.Array], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: sentences per subject, known words per subject, and what is common to all subjects (source by
    slot, length, code, sentences of no subject). A sentence that a text repeats counts once."""
    x = Sentences(columns)
    s, w, at = lex.votes(x)
    said = _subjects(lex.totals(x, s, at), 0.5) if x.n else np.empty(0, "int64")
    once = np.zeros(x.n, bool)
    once[np.unique(x.doc.astype("int64") * SLOTS + x.sets, return_index=True)[1]] = True
    by = np.zeros((x.documents, lex.n + 1))
    np.add.at(by, (x.doc[once], said[once]), 1)
    words = np.zeros((x.documents, lex.n))
    pairs = np.unique(x.doc[s].astype("int64") * SLOTS + w)
    np.add.at(words, (pairs // SLOTS, lex.sure[lex.row[pairs % SLOTS]]), 1)
    length = np.bincount(x.doc, minlength=x.documents)
    common = np.zeros((x.documents, SOURCES + 3))
    for i, source in enumerate(columns["source"].to_pylist()):
        if source is not None:
            common[i, slot(source) % SOURCES] = 1
    common[:, -3:] = np.c_[np.log1p(length) / 3, columns["code"].to_numpy(zero_copy_only=False).astype(float), by[:, -1] / np.maximum(1, length)]
    return by[:, :-1], np.log1p(words) / 3, common


def _design(by: np.ndarray, words: np.ndarray, common: np.ndarray, i: int) -> np.ndarray:
    """Rows of features of subject ``i`` without the labels before it."""
    c, total = by[:, i], by.sum(axis=1)
    return np.c_[np.ones(len(by)), c == 1, c == 2, c >= 3, c / np.maximum(1, total), np.minimum(total - c, 6) / 6, words[:, i], common]


class Chain:
    """One logistic model per subject, in a fixed order, each seeing the labels before it; Platt-calibrated on folds."""

    def __init__(self, n: int, folds: int = 4, ridge: float = 1.0):
        self.n, self.folds, self.ridge = n, folds, ridge

    def _fit(self, x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float) -> np.ndarray:
        w = prior.copy()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + ridge * (w - prior)
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def fit(self, by: np.ndarray, words: np.ndarray, common: np.ndarray, y: np.ndarray) -> Chain:
        """Rows of features and 0/1 labels. Models start from what all subjects share, so rare subjects need few labels."""
        rows = len(by)
        before = lambda i: np.c_[y[:, :i], np.zeros((rows, self.n - i))]
        xs = [np.c_[_design(by, words, common, i), before(i)] for i in range(self.n)]
        start = np.zeros(7 + common.shape[1] + self.n)
        start[:4] = -3, 0.5, 4, 5  # one sentence is a passing mention, two are about
        pooled = self._fit(np.concatenate(xs), np.concatenate([y[:, i] for i in range(self.n)]).astype(float), start, self.ridge) if self.n else start
        self.weights = [self._fit(xs[i], y[:, i].astype(float), pooled, self.ridge * 5) for i in range(self.n)]
        margins, truth = [], []
        for f in range(self.folds):  # calibration on rows that the weights haven't seen
            held = np.arange(rows) % self.folds == f
            if held.any() and (~held).any():
                for i in range(self.n):
                    margins.append(xs[i][held] @ self._fit(xs[i][~held], y[~held, i].astype(float), pooled, self.ridge * 5))
                    truth.append(y[held, i])
        self.scale = np.array([1.0, 0.0])
        if margins:
            m = np.concatenate(margins)
            self.scale = self._fit(np.c_[m, np.ones(len(m))], np.concatenate(truth).astype(float), np.array([1.0, 0.0]), 1.0)
        return self

    def decode(self, by: np.ndarray, words: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Most probable combination of labels of each row, by beam search along the chain over all subjects."""
        rows = len(by)
        score, labels = np.zeros((rows, 1)), np.zeros((rows, 1, self.n))
        for i in range(self.n):
            w = self.weights[i]
            d = len(w) - self.n
            z = (_design(by, words, common, i) @ w[:d])[:, None] + labels @ w[d:]
            z = np.clip(self.scale[0] * z + self.scale[1], -30, 30)
            taken = labels.copy()
            taken[:, :, i] = 1
            score, labels = np.concatenate([score - np.log1p(np.exp(-z)), score - np.log1p(np.exp(z))], axis=1), np.concatenate([taken, labels], axis=1)
            if score.shape[1] > BEAM:
                best = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
                score, labels = np.take_along_axis(score, best, 1), np.take_along_axis(labels, best[:, :, None], 1)
        best = score.argmax(axis=1) if score.shape[1] else np.zeros(rows, int)
        return labels[np.arange(rows), best]


def fit_subjects(cut: DataFrame, documents: int, subjects: DataFrame, labels: DataFrame) -> tuple[list[str], Lexicon, Chain]:
    names = [(r.subject, r.description or "") for r in subjects.filter("subject IS NOT NULL").orderBy("subject").select("subject", "description").collect()]  # a fixed list
    n, index = len(names), {s: i for i, (s, _) in enumerate(names)}
    given = labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("given"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    some = cut.join(F.broadcast(given), "doc_id").orderBy("doc_id").toPandas()  # at most MAX_LABELLED rows
    some["labels"] = [[index[s] for s in g if s in index] for g in some["given"]]
    some = some[some["labels"].map(len) > 0]
    context = cut.sparkSession.sparkContext
    keys, values = _summed(cut, _frequencies)
    often, repeats = _dense(keys, values, 0), _dense(keys, values, 1)
    shared = context.broadcast(Table(often))  # at most SLOTS entries

    def matters(x: Sentences, sums: _Sums) -> None:
        sums.add(_term_sets(x, shared.value.values)[2])
        f = shared.value.values[x.word]
        ok = f >= RARE
        w, s, f = x.word[ok], x.of[ok], f[ok]
        if len(w):
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            near = f <= NEAR * np.repeat(np.minimum.reduceat(f, first), np.diff(np.r_[first, len(s)]))
            sums.add(w[near].astype("int64") + SLOTS)

    keys, values = _summed(cut, matters)
    same, matter = context.broadcast(Table(_dense(keys, values, 0))), _dense(keys, values, 1)  # at most SLOTS entries

    def talk(x: Sentences, sums: _Sums) -> None:
        """Words of set sentences."""
        w, s, slots, least = _term_sets(x, shared.value.values)
        if len(w):
            n = same.value.values[slots]
            sums.add(w[((n >= SET_SHARE * least) & (n >= max(5.0, SET_DOCS * documents)))[s]])

    common = _dense(*_summed(cut, talk), 0) >= 0.5 * np.maximum(often, 1)  # the talk that all texts share
    shared.destroy()
    same.destroy()
    matter = (matter >= 0.5 * often) & (often >= RARE) & ~common
    often = np.where(common, 0, often).astype("float32")
    lexicon = grow(cut, seed_counts(some, [d for _, d in names], n, often), len(some) / max(1, documents), often, repeats, matter, n)
    chain, y = Chain(n), np.zeros((len(some), n))
    for r, own in enumerate(some["labels"]):
        y[r, own] = 1
    arrays = {c: pa.array(some[c], pa.list_(pa.int32())) for c in ("sets", "sizes", "words")} | {"source": pa.array(some["source"], pa.string()), "code": pa.array(some["code"], pa.bool_())}
    chain.fit(*features(arrays, lexicon), y)
    return [s for s, _ in names], lexicon, chain


def document_subjects(docs: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects that a text deals with, none to several; whole texts are read.

    Null, empty and blank texts and texts of code alone have none. Repeated documents give the same subjects.
    Labels of unknown subjects or documents are ignored; without labels, the descriptions alone teach the terms.
    """
    spark = docs.sparkSession
    if subjects.filter("subject IS NOT NULL").isEmpty():
        return spark.createDataFrame([], "doc_id bigint, subject string")
    docs = docs.select("doc_id", "text", K.lower_trim(F.col("source")).alias("source")).filter("text IS NOT NULL")
    cut, documents = Scratch(spark, "subjects").save_counted(cut_corpus(docs), "cut")
    model = spark.sparkContext.broadcast(fit_subjects(cut, documents, subjects, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lexicon, chain = model.value
        for batch in it:
            if batch.num_rows:
                columns = _arrays(batch)
                by, words, common = features(columns, lexicon)
                row, subject = np.nonzero(chain.decode(by, words, common) * (words.sum(axis=1) > 0)[:, None])
                yield pa.RecordBatch.from_arrays([columns["doc_id"].take(pa.array(row)), pa.array([names[i] for i in subject], pa.string())], ["doc_id", "subject"])

    return cut.mapInArrow(run, "doc_id bigint, subject string")


def subject_composition(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents, characters and share of documents per subject; '(none)' for documents without one."""
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    rows = sized.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.count("*").alias("documents"), F.sum("chars").alias("characters"))
    total = sized.agg(F.count("*").alias("all"))
    return rows.crossJoin(F.broadcast(total)).select("subject", "documents", "characters", F.round(F.col("documents") / F.col("all"), 6).alias("share"))  # one row of totals
