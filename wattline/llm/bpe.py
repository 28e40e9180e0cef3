"""BPE encoding and decoding with a tokenization automaton.

Compiling. An automaton over tokens accepts exactly the token strings that the merge rules
produce. It starts as one state with a loop for every base symbol (each base token may follow
each). For each merge (u, v) -> w, in order, a merge gadget changes it: wherever a path reads u
and then v, an arc w is added from the path's start to its end, and afterwards v may no longer
follow u. So the state after w starts as a copy of the state after v, w may enter wherever u
might at that moment, and the pair (u, v) is closed from then on. States differ only in the
last token read, and they are not stored densely: 49k x 49k arcs would be 300 MB of bits in every
worker. Gadgets are kept as (left, right, time) instead, and an arc is looked up by replaying
just those gadgets that can have touched it (`Automaton.arc`).

Encoding. The arcs' spellings form a trie. The machine that reads symbols is the token
automaton with these spellings put in, determinised: a state is the set of (token state, trie
node) pairs alive, and every prefix of a word has exactly one tokenization, so exactly one arc ends
with each symbol. Transitions are tables filled when first needed (a lazy DFA; it is cleared when
it reaches its bound, which changes no result). Reading a word is one lookup a symbol; the
arcs' labels, followed back from the end, are the ids. Decoding emits the labels' texts.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wattline.llm._support import process_slot, slices

#: Bounds of the caches of a process: they change no result.
CHUNKS_HELD = 250_000
STATES_HELD = 200_000
BATCH_BYTES = 4 << 20
NODE_BITS, NODE_MASK = 32, (1 << 32) - 1

#: How words are cut from a normalized text, and the normalizer, cutting and model settings that are built in here: fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTING = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = ("single_word", "lstrip", "rstrip", "normalized")


def check_supported(spec: dict) -> None:
    """An error for a vocabulary file that normalizes, cuts or merges in another way than is built in: its ids would be others."""
    model = spec.get("model") or {}
    other = [k for k, v in (("normalizer", NORMALIZER), ("pre_tokenizer", CUTTING)) if spec.get(k) != v]
    other += [k for k, v in MODEL.items() if model.get(k, v) != v] + ["end_of_word_suffix"] * (not model.get("end_of_word_suffix")) + ["decoder"] * (spec.get("decoder") is not None)
    other += ["added_tokens"] * any(x.get(k) for x in spec.get("added_tokens", []) for k in ADDED)
    if other:
        raise ValueError(f"not a tokenizer file of the supported kind: {', '.join(other)}")


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """The token automaton of one vocabulary file, compiled once and shipped to the executors."""

    def __init__(self, source: str):
        spec = json.loads(source)
        check_supported(spec)
        self.key = hashlib.sha256(source.encode()).hexdigest()
        model = spec["model"]
        self.spec = source
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        size = max(self.label) + 1
        # The gadgets: parts of each merged token, and the time at which it was made.
        self.left, self.right, self.time = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.closed: dict[tuple[int, int], int] = {}
        for at, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[u], vocab[v], vocab[u + v]
            self.left[w], self.right[w], self.time[w] = u, v, at
            self.closed[u, v] = at
            if u == v:  # u u u u reads as w w, never as u w u
                self.closed[u, w] = at
        letters = {c: b for b, c in byte_letters().items()}
        self.base: list[int] = [0] * 512  # symbols: bytes, and bytes that end a word
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        for text, i in vocab.items():
            last = text.endswith(self.suffix)
            symbols = [letters[c] for c in (text[: -len(self.suffix)] if last else text)]
            if last:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                self.inner[node] = True
                node = self.trie.setdefault(node << 9 | s, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = i
        self.length = {i: len(s.removesuffix(self.suffix)) for s, i in vocab.items()}

    def arc(self, p: int, t: int) -> bool:
        """Whether t may follow p: replays, newest first, the gadgets by which p and t came to be.
        When w = (u, v) was made, its state copied that after v and it took u's way in. So an arc
        between tokens exists if it was there for the parts when the newer of the two was made, and
        no gadget closed it."""
        before = 1 << 60
        left, right, time, closed = self.left, self.right, self.time, self.closed
        while True:
            at = closed.get((p, t))
            if at is not None and at < before:
                return False
            a, b = time[p], time[t]
            if a < 0 and b < 0:
                return True
            if b > a:
                before, t = min(before, b), left[t]
            else:
                before, p = min(before, a), right[p]


class Reader:
    """The lazy DFA: pre-split words (bytes) to ids, many words in step."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.length = np.ones(max(automaton.label) + 1, np.int64)
        for i, n in automaton.length.items():
            self.length[i] = n
        self.reset()

    def reset(self) -> None:
        self.arcs: dict[int, bool] = {}
        # What is alive, as numbers: token state (0 at the start, else a token + 1) and trie node.
        self.states: dict[tuple, int] = {(-1, 0): 0}
        self.configs: list[tuple] = [(0,)]
        self.done = array("i", [-1])
        self.column = np.full(512, -1, np.int64)  # symbols to the table's columns, as they turn up
        self.symbols: list[int] = []
        self.table = np.full((1 << 12, 32), -1, np.int32)

    def _step(self, state: int, symbol: int) -> int:
        """The state after `symbol`, made if it is new."""
        a, alive, done = self.a, [], -1
        for config in self.configs[state]:
            q = config >> NODE_BITS
            to = a.trie.get((config & NODE_MASK) << 9 | symbol)
            if to is None:
                continue
            t = a.ends[to]
            if t >= 0 and done < 0:
                known = self.arcs.get(key := q << 20 | t)
                if known is None:
                    known = self.arcs[key] = not q or a.arc(q - 1, t)
                if known:
                    done = t
            if a.inner[to]:
                alive.append(q << NODE_BITS | to)
        if done >= 0:
            alive.append(done + 1 << NODE_BITS)
        to = self.states.setdefault((done, *alive), len(self.configs))
        if to == len(self.configs):
            self.configs.append(tuple(alive))
            self.done.append(done)
        return to

    def _fill(self, state: np.ndarray, column: np.ndarray) -> None:
        for key in np.unique(state.astype(np.int64) << 16 | column).tolist():
            to = self._step(key >> 16, self.symbols[key & 0xFFFF])
            if to >= len(self.table):
                self.table = np.concatenate((self.table, np.full((1 << 15, self.table.shape[1]), -1, np.int32)))
            self.table[key >> 16, key & 0xFFFF] = to

    def read(self, words: list[bytes]) -> list[bytes]:
        if len(self.configs) > STATES_HELD:
            self.reset()
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        size, start = length[order], (np.cumsum(length) - length)[order]
        code = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        code[start + size - 1] += 256
        for symbol in np.unique(code[self.column[code] < 0]).tolist():
            self.column[symbol] = len(self.symbols)
            self.symbols.append(symbol)
        if len(self.symbols) > self.table.shape[1]:
            self.table = np.concatenate((self.table, np.full((len(self.table), max(32, len(self.symbols) - self.table.shape[1])), -1, np.int32)), axis=1)
        code = self.column[code]
        path = np.zeros(len(code), np.int32)
        state = np.zeros(len(size), np.int32)
        running = np.searchsorted(-size, -np.arange(int(size[0])), side="left") if len(size) else []
        for i, n in enumerate(running):  # words are in order of length: the first n have an i-th symbol
            at, column = start[:n] + i, code[start[:n] + i]
            to = self.table[state[:n], column]
            if (miss := np.flatnonzero(to < 0)).size:
                self._fill(state[miss], column[miss])
                to = self.table[state[:n], column]
            path[at] = state[:n] = to
        done = np.frombuffer(self.done, np.int32)
        left, alive, found, count = size.copy(), np.arange(len(size)), [], np.zeros(len(size), np.int64)
        while alive.size:  # follow the labels back from the ends
            t = done[path[start[alive] + left[alive] - 1]]
            found.append((alive, t))
            count[alive] += 1
            left[alive] -= self.length[t]
            alive = alive[left[alive] > 0]
        ends = np.cumsum(count)
        ids = np.zeros(int(count.sum()), "<u4")
        for r, (who, t) in enumerate(found):
            ids[ends[who] - 1 - r] = t
        data, stop, first = ids.tobytes(), np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        stop[order], first[order] = 4 * ends, 4 * (ends - count)
        return [data[i:j] for i, j in zip(first.tolist(), stop.tolist(), strict=True)]


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit) and back to text, in one process.

    Pre-split words never cross white space, so what lies between white space is looked up whole, and
    only what is not held yet is split and read by the automaton.
    """

    def __init__(self, automaton: Automaton, held: int | None = None):
        self.a, self.reader, self.held = automaton, Reader(automaton), held or CHUNKS_HELD
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was held before `chunks` was started anew
        self.pieces = regex.compile(PIECES)
        self.marks = re.compile("|".join(map(re.escape, automaton.special))) if automaton.special else None
        self.special = {s: i.to_bytes(4, "little") for s, i in automaton.special.items()}
        self.unusual = re.compile("[^\x00-\x1b\x20-ԯ‐-‧‰-⁞₠-₵一-龥ぁ-ゖァ-ヺ가-힣]")
        self.library = None

    def _learn(self, chunks: set[str]) -> None:
        """Hold the ids of these chunks."""
        if self.older:
            again = {c for c in chunks if c in self.older}
            self.chunks.update((c, self.older[c]) for c in again)
            chunks = chunks.difference(again)
        alone = [c for c in chunks if c.isalpha()]
        mixed = list(chunks.difference(alone))
        split = [[c[:-1], c[-1]] if c[-1] in ".,;:!?" and c[:-1].isalpha() else self.pieces.findall(c) for c in mixed]
        ids = self.reader.read([w.encode() for w in chain(alone, chain.from_iterable(split))])
        self.chunks.update(zip(alone, ids, strict=False))
        at = len(alone)
        for c, words in zip(mixed, split, strict=True):
            self.chunks[c] = b"".join(ids[at : at + len(words)])
            at += len(words)

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """A text as lists of chunks and, for special tokens, ids."""
        if self.marks is not None and "<|" in text and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += [*self._cut(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
            return [*out, *self._cut(text[at:])]
        if not text.isascii():
            if self.unusual.search(text):
                return [self._split_by_library(text)]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        elif any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the vocabulary
            return [self._split_by_library(text)]
        return [text.lower().split()]

    def _split_by_library(self, text: str) -> bytes:
        """Text with letters that Unicode versions class differently is split by the tokenizers library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.a.spec)
            self.byte = {c: b for b, c in byte_letters().items()}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self.reader.read([bytes(self.byte[c] for c in x) for x, _ in cut]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing here makes cycles, and passes over the caches are slow
        try:
            return self._encode_all(texts)
        finally:
            gc.enable()

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > self.held:
            self.older, self.chunks = self.chunks, {}
        get, new, rows = self.chunks.get, [], []
        for text in texts:  # one look-up a chunk: what is missing is noted, learned together, and filled in
            row: list[tuple[list[str], list, list[int]] | bytes] = []
            for part in self._cut(text):
                if type(part) is list:
                    ids = list(map(get, part))
                    gaps = [i for i, x in enumerate(ids) if x is None]
                    new += [part[i] for i in gaps]
                    part = ([part[i] for i in gaps], ids, gaps)
                row.append(part)
            rows.append(row)
        if new:
            self._learn(set(new))
        out, known = [], self.chunks
        for row in rows:
            data = []
            for part in row:
                if type(part) is tuple:
                    chunks, ids, gaps = part
                    for i, c in zip(gaps, chunks, strict=True):
                        ids[i] = known[c]
                    part = b"".join(ids)
                data.append(part)
            out.append(data[0] if len(data) == 1 else b"".join(data))
        return out

    def decode(self, ids: bytes) -> str:
        """As a tokenizer without a decoder does: labels joined by blanks."""
        return " ".join(map(self.a.label.__getitem__, array("I", ids)))


def worker_encoder(automaton: Automaton, held: int | None = None) -> Encoder:
    """The encoder of this Python worker, with what it holds from earlier tasks."""
    return process_slot(f"{automaton.key}/{held}", lambda: Encoder(automaton, held))


def load(spark, path: str) -> Automaton:
    """Compile the vocabulary file at `path`, once, on the driver; its size is the vocabulary's."""
    with open(path, encoding="utf-8") as f:
        return Automaton(f.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text. Returns id, n_tokens, ids (binary, little-endian
    unsigned 32-bit), decoded (string).

    Null or empty text: no ids and empty decoded text. Rows are judged alone, so repeated rows and
    ties give repeated results; an empty table gives an empty result. Other columns are dropped
    before use. A null id stays null. Memory: batches of 4 MB of text, and bounded caches.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")


def crc(data: bytes) -> int:
    return zlib.crc32(data)
