"""Encoding of texts with a public byte-level BPE vocabulary, as a lazily determinised transducer.

A token sequence is the BPE encoding of a word exactly when each neighbouring pair is the encoding of its own
concatenation, so every prefix of a word has one last token. Reading bytes, the nondeterministic machine keeps
each start from which a token may still grow, with the token before it and the output not yet agreed upon.
Subset construction with residual outputs makes it deterministic; a transition is compiled when first needed,
and emits the tokens that all live starts share, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.session import ship

#: Fixed value: how the byte-level vocabulary cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Transducer:
    """Byte-level BPE of single words. ``limit`` bounds the compiled transitions, token pairs and remembered words held at once."""

    def __init__(self, vocabulary: bytes, limit: int = 400_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.limit = limit
        self.child: list[dict[int, int]] = [{}]  # trie of the vocabulary
        self.token: list[int] = [-1]
        for t, i in self.ranks.items():
            at = 0
            for b in t:
                nxt = self.child[at].get(b)
                if nxt is None:
                    nxt = self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                at = nxt
            self.token[at] = i
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, ()),)
        self.states, self.index = [start], {start: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """By the merges themselves: the pair of least rank first. For pairs of tokens and tests only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, before: int, token: int) -> bool:
        """``before`` then ``token`` is what the merges make of their bytes (-1: the word begins)."""
        key = (before, token)
        ok = self.pairs.get(key)
        if ok is None:
            b = self.bytes_of
            ok = self.pairs[key] = self.merged((b[before] if before >= 0 else b"") + b[token]) == [x for x in key if x >= 0]
        return ok

    def _compile(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, done = [], None
        for node, before, out in self.states[state]:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if done is None and t >= 0 and self._follows(before, t):
                done = (0, t, (*out, t))
            if self.child[nxt]:
                live.append((nxt, before, out))
        if done is not None:
            live.append(done)
        shared = 0  # output on which all live starts agree
        outs = [x[2] for x in live]
        while all(len(o) > shared for o in outs) and len({o[shared] for o in outs}) == 1:
            shared += 1
        emit = outs[0][:shared] if outs else ()
        key = tuple((n, b, o[shared:]) for n, b, o in live)
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.states)
            self.states.append(key)
        step = self.steps[state << 8 | byte] = (at, emit)
        return step

    def word(self, word: str) -> tuple[int, ...]:
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self.steps) > self.limit or len(self.words) > self.limit or len(self.pairs) > self.limit:
            self.reset()
        state, out, steps = 0, [], self.steps
        for b in word.encode():
            state, emit = steps.get(state << 8 | b) or self._compile(state, b)
            if emit:
                out += emit
        for node, _, rest in self.states[state]:
            if node == 0:  # the start at the word's end holds the last tokens
                out += rest
        ids = tuple(out)
        if len(word) <= 64:
            self.words[word] = ids
        return ids


_WORDS = regex.compile(PATTERN)
_MACHINES: dict[int, Transducer] = {}


def machine(vocabulary: bytes) -> Transducer:
    """The worker's transducer for a vocabulary, compiled once."""
    key = hash(vocabulary)
    if key not in _MACHINES:
        _MACHINES[key] = Transducer(vocabulary)
    return _MACHINES[key]


def encode(t: Transducer, text: str | None) -> list[int]:
    """Ids of a text without special tokens (their spelling is ordinary text); none for an empty or null text."""
    out: list[int] = []
    if text:
        word, known = t.word, t.words.get
        for w in _WORDS.findall(text) if len(text) < 1 << 20 else (m.group() for m in _WORDS.finditer(text)):
            out += known(w) or word(w)
            if len(t.words) > t.limit:  # words are forgotten together with the table that ``known`` reads
                t.reset()
                known = t.words.get
    return out


def decode_stream(t: Transducer, ids: Iterable[int]) -> Iterator[str]:
    """Text of ids as it becomes complete: an incremental UTF-8 state machine over the tokens' bytes.

    Bytes that can't continue a character give U+FFFD; a cut-off character at the end too.
    """
    need, low, high, code = 0, 0x80, 0xBF, 0
    for i in ids:
        chars: list[str] = []
        for b in t.bytes_of[i]:
            if need and low <= b <= high:
                code, need, low, high = code << 6 | b & 0x3F, need - 1, 0x80, 0xBF
                if not need:
                    chars.append(chr(code))
                continue
            if need:
                chars.append("�")
                need = 0
            low, high = 0x80, 0xBF
            if b < 0x80:
                chars.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                need, code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                need, code = 2, b & 0x0F
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                need, code = 3, b & 0x07
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                chars.append("�")
        if chars:
            yield "".join(chars)
    if need:
        yield "�"


def _vocabulary(spark, path: str):
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # under a megabyte, whatever the data


def _batches(df: DataFrame, cols: list[str], path: str, per_batch, schema: str) -> DataFrame:
    vocabulary = _vocabulary(df.sparkSession, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = machine(vocabulary.value)
        for batch in it:
            yield from per_batch(t, batch)

    return df.select(*cols).mapInArrow(run, schema)


def encoded(df: DataFrame, id_col="doc_id", text_col="text", path: str = DEFAULT_PATH, chunk: int = 2_000_000) -> DataFrame:
    """(id, ids) of every row; a null or empty text gives an empty list. Repeated rows are encoded each.

    Output batches are cut after ``chunk`` ids, so long texts don't pile up in a worker.
    """

    def rows(t: Transducer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, first, flat, ends = batch.column(0), 0, [], [0]

        def cut(upto: int) -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.concatenate(flat) if flat else np.empty(0, "int32"), pa.int32()))
            return pa.RecordBatch.from_arrays([keys.slice(first, upto - first), ids], [id_col, "ids"])

        for i, text in enumerate(batch.column(1)):
            ids = np.array(encode(t, text.as_py()), "int32")
            flat.append(ids)
            ends.append(ends[-1] + len(ids))
            if ends[-1] > chunk:
                yield cut(i + 1)
                first, flat, ends = i + 1, [], [0]
        if first < len(keys):
            yield cut(len(keys))

    return _batches(df, [id_col, text_col], path, rows, f"{id_col} bigint, ids array<int>")


def token_counts(df: DataFrame, *keep: str, id_col="doc_id", text_col="text", path: str = DEFAULT_PATH) -> DataFrame:
    """(id, the string columns ``keep``, n_tokens) of every row; 0 for a null or empty text."""

    def rows(t: Transducer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = pa.array([len(encode(t, x.as_py())) for x in batch.column(batch.num_columns - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [id_col, *keep, "n_tokens"])

    schema = ", ".join([f"{id_col} bigint", *(f"{c} string" for c in keep), "n_tokens bigint"])
    return _batches(df, [id_col, *keep, text_col], path, rows, schema)


def round_trip(df: DataFrame, id_col="doc_id", text_col="text", path: str = DEFAULT_PATH) -> DataFrame:
    """(id, n_tokens, n_chars, exact): whether the streamed decoding of the ids gives the text again."""

    def rows(t: Transducer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        ids = [encode(t, x) for x in texts]
        same = [("".join(decode_stream(t, i)) == (x or "")) for i, x in zip(ids, texts)]
        cols = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([len(x or "") for x in texts], pa.int64()), pa.array(same)]
        yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "n_chars", "exact"])

    return _batches(df, [id_col, text_col], path, rows, f"{id_col} bigint, n_tokens bigint, n_chars bigint, exact boolean")
