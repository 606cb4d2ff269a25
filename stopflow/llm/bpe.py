"""Byte-level BPE as a deterministic automaton over tokens.

A sequence of tokens is what BPE makes of its bytes exactly if the automaton accepts it. The automaton is built
merge by merge. At first there is one state per byte and every byte may follow every byte. The gadget of the
merge (a, b) -> c closes the arc from a to b and adds a state c, which is entered from wherever a could be entered
and left to wherever b could be left to. Full arc tables would take the square of the vocabulary, so each state
keeps the arcs it closed and points to the states whose arcs it took over; ``Automaton.arc`` follows those.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Results kept during a task to save work; a store is emptied when full, and long words are not kept.
STORED_WORDS = 400_000
STORED_LENGTH = 64
STORED_ARCS = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary files: itself where visible, else from U+0100 upwards."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Byte ids, merges (left id, right id, own id) in order, and added tokens of a tokenizer file.

    Only plain byte-level BPE is taken; a file with a normalizer, a prefix space, dropout or two merges that make
    the same token raises ValueError.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec["normalizer"] is None
             and not model.get("dropout") and not model.get("ignore_merges") and not model.get("end_of_word_suffix"))
    if not plain:
        raise ValueError("not a plain byte-level BPE file")
    vocab, letters = model["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    if len({c for _, _, c in merges}) < len(merges):
        raise ValueError("two merges make the same token")
    return {"bytes": [(vocab[x], b) for x, b in letters.items()], "merges": merges,
            "added": [(t["content"], t["id"]) for t in spec["added_tokens"]]}


spaced = re.compile(r" (?:\s|\Z)").search


class _Store(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= STORED_LENGTH:
            if len(self) >= STORED_WORDS:
                self.clear()
            self[key] = value
        return value


class Automaton:
    """Compiled from ``read_vocabulary``. ``label[t]`` holds the bytes that the arcs into state t emit."""

    def __init__(self, spec: dict):
        self.label: dict[int, bytes] = {t: bytes([b]) for t, b in spec["bytes"]}
        self.born = {t: -1 for t in self.label}
        self.enter: dict[int, int] = {}  # whose entering arcs a merged state took over
        self.leave: dict[int, int] = {}  # whose leaving arcs
        self.closed: dict[tuple[int, int], int] = {}  # arc -> the merge that closed it
        self.token = {b: t for t, b in self.label.items()}
        for k, (a, b, c) in enumerate(spec["merges"]):
            if a not in self.born or b not in self.born or not self.arc(a, b, k):
                continue  # the pair never stands side by side by then: the token can't arise
            self.closed[a, b] = k
            self.born[c], self.enter[c], self.leave[c] = k, a, b
            self.label[c] = self.label[a] + self.label[b]
            self.token[self.label[c]] = c
        self._scan_tables()
        self.added = dict(spec["added"])
        self.label |= {t: x.encode() for x, t in spec["added"]}
        self._arcs: dict[int, bool] = {}
        self._after_space = _Store(lambda chunk: self._chunk(" " + chunk))
        self._at_start = _Store(self._chunk)
        self.split = regex.compile(PATTERN).findall
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def arc(self, u: int, v: int, before: int | None = None) -> bool:
        """Whether v may follow u, as of just before merge ``before`` (None: in the end)."""
        born, closed = self.born, self.closed
        k = len(self.born) + len(closed) + 1 << 1 if before is None else before
        while True:
            at = closed.get((u, v))
            if at is not None and at < k:
                return False
            bu, bv = born[u], born[v]
            if bu < 0 and bv < 0:
                return True
            if bu > bv:
                k, u = bu, self.leave[u]
            elif bv > bu:
                k, v = bv + 1, self.enter[v]
            else:
                k, u, v = bu, self.leave[u], self.enter[v]

    def _scan_tables(self) -> None:
        """Tables that give, while reading bytes, the longest token that ends here, and its longest proper suffix token."""
        step: list[dict[int, int]] = [{}]  # by state: byte -> state
        ends = [-1]
        for data, t in self.token.items():
            at = 0
            for b in data:
                to = step[at].get(b)
                if to is None:
                    to = step[at][b] = len(step)
                    step.append({})
                    ends.append(-1)
                at = to
            ends[at] = t
        fall, queue = [0] * len(step), list(step[0].values())
        self.suffix = [-1] * (max(self.label) + 1)
        for at in queue:
            if ends[at] >= 0:
                self.suffix[ends[at]] = ends[fall[at]]
            else:
                ends[at] = ends[fall[at]]
            for b, to in step[at].items():
                f = fall[at]
                while f and b not in step[f]:
                    f = fall[f]
                fall[to] = step[f].get(b, 0)
                queue.append(to)
        self.step, self.fall, self.ends = step, fall, ends
        self.length = [len(self.label.get(t, b"")) for t in range(max(self.label) + 1)]

    def _fallen(self, at: int, byte: int) -> int:
        """The state after a byte that no token goes on with; noted as a step of its own."""
        f = self.fall[at]
        while f and byte not in self.step[f]:
            f = self.fall[f]
        to = self.step[at][byte] = self.step[f].get(byte, 0)
        return to

    def word(self, data: bytes) -> list[int]:
        """The one accepted token sequence of some bytes.

        ``last[i]`` is the state after the first i bytes. It is the one token t ending there that may follow
        ``last[i - len(t)]``; candidates are the longest token ending there and its suffixes. Any token may come first.
        """
        step, ends, suffix, length, arcs = self.step, self.ends, self.suffix, self.length, self._arcs
        last = [-1]
        at = 0
        for i, b in enumerate(data, 1):
            try:
                at = step[at][b]
            except KeyError:
                at = self._fallen(at, b)
            t = ends[at]
            n = length[t]
            while n != i:
                u = last[i - n]
                try:
                    ok = arcs[u << 24 | t]
                except KeyError:
                    if len(arcs) >= STORED_ARCS:
                        arcs.clear()
                    ok = arcs[u << 24 | t] = self.arc(u, t)
                if ok:
                    break
                t = suffix[t]
                n = length[t]
            last.append(t)
        out, i = [], len(data)
        while i:
            t = last[i]
            out.append(t)
            i -= length[t]
        out.reverse()
        return out

    def _chunk(self, text: str) -> list[int]:
        core = text.removeprefix(" ")
        if core.isascii() and core.isalpha():  # one word of the pattern
            return self.word(text.encode())
        return [t for w in self.split(text) for t in self.word(w.encode())]

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens.

        A space before a non-space starts a word of the pattern, and what stands before it splits alike with or without
        the rest. So a text is cut at single spaces and the ids of each cut are kept; with other runs of white space
        at a cut, the pattern runs over the whole text.
        """
        if not spaced(text):
            first, *rest = text.split(" ")
            return [*self._at_start[first], *chain.from_iterable(map(self._after_space.__getitem__, rest))]
        return [t for w in self.split(text) for t in (self._after_space[w[1:]] if w[0] == " " and len(w) > 1 and not w[1].isspace() else self._at_start[w])]

    def encode(self, text: str) -> list[int]:
        if not any(x in text for x in self.added):
            return self._plain(text)
        pieces = self.cut(text)
        return [t for p in pieces for t in ([self.added[p]] if p in self.added else self._plain(p))]

    def forget(self) -> None:
        """Give back the memory of the stores; tasks do so at their end, as workers live on."""
        for store in (self._arcs, self._after_space, self._at_start):
            store.clear()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", errors="replace")


_COMPILED: dict[str, Automaton] = {}


def _compiled(shared) -> Automaton:
    """The automaton of a broadcast vocabulary, compiled once per worker process."""
    name, spec = shared.value
    if name not in _COMPILED:
        _COMPILED[name] = Automaton(spec)
    return _COMPILED[name]


def tokenize(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids (array<int>) of whole texts, and if named, the text decoded from those ids.

    The vocabulary file is read on the driver and broadcast (a file of fixed size, one or two MB as tuples). Texts are
    split, encoded and decoded where they are, without a shuffle. NULL text counts as empty, repeated rows are each
    encoded, an empty table gives no rows; other columns are kept, but for one named as ``ids`` or ``decoded``.
    """
    spark = docs.sparkSession
    spec = read_vocabulary(path)
    shared = spark.sparkContext.broadcast((hashlib.sha1(json.dumps(spec).encode()).hexdigest(), spec))

    @F.pandas_udf("struct<ids:array<int>,text:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _compiled(shared)
        for texts in batches:
            found = [machine.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": found, "text": [machine.decode(x) for x in found] if decoded else [""] * len(found)})
        machine.forget()

    made = fresh(docs, "_bpe")
    out = docs.withColumn(made, run(F.coalesce(F.col(text), F.lit("")))).withColumn(ids, F.col(made)["ids"])
    if decoded:
        out = out.withColumn(decoded, F.col(made)["text"])
    return out.drop(made)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text.

    Only digests leave the workers. A row is a batch's unit, so memory holds one Arrow batch; batches are cut by bytes.
    NULL text counts as empty, repeated rows are each returned, an empty table gives no rows.
    """
    spark = docs.sparkSession
    spec = read_vocabulary(path)
    shared = spark.sparkContext.broadcast((hashlib.sha1(json.dumps(spec).encode()).hexdigest(), spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(shared)
        for batch in batches:
            counts, coded, plain = [], [], []
            for value in batch.column(1):
                ids = machine.encode(value.as_py() or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(plain)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        machine.forget()

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
