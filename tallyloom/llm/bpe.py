"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token labels and accepts exactly the token sequences that byte-pair encoding
yields. It starts as one state with a loop for every byte. Merges are then built in, in rank order,
each by a gadget: for the merge ``u v -> t`` an arc ``t`` is added wherever an arc ``u`` leads to a state
with an arc ``v``, ending where that ``v`` ends; and arcs ``u`` are led to a copy of their state that lacks the
arc ``v``, so that ``u`` then ``v`` is no longer a path. As every arc with one label ends in the same state,
a state is named by the label that leads to it, and a copy records just what it lost: ``(u, v)`` at the
merge's rank. An arc that is cut also keeps later tokens that begin with it from being added. So
"is there an arc t after token s" is answered from the records along the right edge of s's merge
tree and the left edge of t's, and answers are kept in a table that fills as pairs are met.

Encoding a pre-split word walks this table: for each place of the word, exactly one token ends there
on an accepted path, and the last one is found from those before. The distinct words of a batch take each
step together, as arrays; a label is found by its hash and the result compared with the words' own bytes.
Decoding emits the labels of the arcs. The tables (two entries a merge) are compiled once on the driver, are
bounded by the vocabulary and broadcast; each text is encoded and decoded where it lies. A worker keeps
tables of fixed size, and nothing that grows with the texts it has seen.

Defined results: null and empty texts have no tokens and decode to the empty text. The special token's
string in a text becomes its id, as the tokenizers library does by default. Bytes that no text gives (a
cut sequence of ids) decode to U+FFFD. Extra columns are not read; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, presplit

#: Entries of the arc tables: for single words, and (bits) for arrays.
ARCS, ARC_BITS = 100_000, 20
#: Longer words are walked one by one.
WIDE = 48
_NEVER = 1 << 60
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Vocabulary files write each byte as one printable character: itself if printable, else the next
    free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Lookup:
    """64-bit keys to numbers from 0 on, for whole arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]  # of several, the last one
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.mask
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


def _hashes(rows: np.ndarray) -> np.ndarray:
    """Running hashes of rows of bytes, one more row than bytes: (place, word)."""
    out = np.zeros((rows.shape[1] + 1, rows.shape[0]), np.uint64)
    values = _BYTES[rows.T]
    for i in range(rows.shape[1]):
        out[i + 1] = out[i] * _BASE + values[i]
    return out


class Automaton:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[int, int, int]], special: dict[str, int]) -> None:
        """merges: (left, right, result) ids in rank order."""
        size = max([*vocabulary.values(), *special.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for label, i in vocabulary.items():
            self.labels[i] = label
        for label, i in special.items():
            self.labels[i] = label.encode()
        self.special = special
        self.left, self.right = array("l", [-1]) * size, array("l", [-1]) * size
        self.made = array("l", [-1]) * size  # rank of the merge that made the token
        self.lost: dict[int, int] = {}  # u << 32 | v -> rank at which arcs v were cut after u
        self.alive = {i for label, i in vocabulary.items() if len(label) == 1}
        self.table: dict[int, bool] = {}
        for rank, (u, v, t) in enumerate(merges):
            self._gadget(rank, u, v, t)
        self.table.clear()
        self.ids = {label: i for label, i in vocabulary.items() if i in self.alive}
        self.longest = max(map(len, self.ids), default=0)
        self.reach: dict[bytes, int] = {}  # the last two bytes of a token -> the longest such token
        for label in self.ids:
            self.reach[label[-2:]] = max(self.reach.get(label[-2:], 0), len(label))

    def _gadget(self, rank: int, u: int, v: int, t: int) -> None:
        if u in self.alive and v in self.alive and t not in self.alive and self._open(u, v):
            self.alive.add(t)
            self.left[t], self.right[t], self.made[t] = u, v, rank
        self.lost.setdefault(u << 32 | v, rank)

    def _open(self, s: int, t: int) -> bool:
        """Is there an arc t in the state that s leads to?"""
        lost, left, right, made = self.lost, self.left, self.right, self.made
        starts, x, until = [], t, _NEVER
        while x >= 0:  # tokens that t begins with, and the rank at which each was taken up
            starts.append((x, until))
            until, x = made[x], left[x]
        x, until = s, _NEVER
        while x >= 0:
            at = x << 32
            for v, taken in starts:
                rank = lost.get(at | v)
                if rank is not None and rank < until and rank <= taken:
                    return False
            until, x = made[x], right[x]
        return True

    def arc(self, s: int, t: int) -> bool:
        """_open, remembered."""
        key = s << 32 | t
        got = self.table.get(key)
        if got is None:
            if len(self.table) >= ARCS:
                self.table.clear()
            got = self.table[key] = self._open(s, t)
        return got

    def _last(self, w: bytes, end: int, known: dict[int, int]) -> int:
        """The token that ends at this place on the accepted path, from the end backwards: mostly the
        longest one that fits."""
        ids, arc = self.ids, self.arc
        for start in range(max(0, end - self.reach.get(w[max(0, end - 2) : end], 1)), end):
            t = ids.get(w[start:end])
            if t is not None:
                if start == 0:
                    break
                s = known.get(start)
                if s is None:
                    s = self._last(w, start, known)
                if arc(s, t):
                    break
        else:
            raise ValueError(f"byte {w[end - 1]} is not in the vocabulary")
        known[end] = t
        return t

    def word(self, w: bytes) -> list[int]:
        """Ids of one pre-split word."""
        whole = self.ids.get(w)
        if whole is not None:
            return [whole]
        n, last = len(w), {}
        if n <= 200:
            self._last(w, n, last)
        else:  # place by place, without recursion
            for end in range(1, n + 1):
                self._last(w, end, last)
        out = []
        while n > 0:
            t = last[n]
            out.append(t)
            n -= len(self.labels[t])
        return out[::-1]


class Walker:
    """The automaton's tables as arrays: words of a batch walk together."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = a = automaton
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (a.left, a.right, a.made))
        self.lost = Lookup(np.array([*a.lost], np.uint64), np.array([*a.lost.values()], np.int32))
        self.sizes = np.array([len(x) for x in a.labels], np.int64)
        self.labels = pa.array(a.labels, pa.large_binary())
        tokens = {**a.ids, **{s.encode(): i for s, i in a.special.items()}}
        keys = {}
        for n in {len(x) for x in tokens}:
            some = [x for x in tokens if len(x) == n]
            keys |= dict(zip(some, _hashes(np.frombuffer(b"".join(some), np.uint8).reshape(-1, n))[n].tolist(), strict=True))
        self.whole = Lookup(np.array([keys[x] for x in tokens], np.uint64), np.array([*tokens.values()], np.int32))
        self.part = Lookup(np.array([keys[x] for x in a.ids], np.uint64), np.array([*a.ids.values()], np.int32))
        self.known, self.answer = np.full(1 << ARC_BITS, ~np.uint64(0)), np.zeros(1 << ARC_BITS, bool)

    def open(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Automaton._open of each pair."""
        out, x, until, live = np.ones(len(s), bool), s.copy(), np.full(len(s), _NEVER), np.arange(len(s))
        while len(live):
            go, y, taken = live, t[live], np.full(len(live), _NEVER)
            while len(go):
                rank = self.lost.get((x[go] << 32 | y).astype(np.uint64)).astype(np.int64)
                out[go[(rank >= 0) & (rank < until[go]) & (rank <= taken)]] = False
                taken, y = self.made[y], self.left[y]
                on = (y >= 0) & out[go]
                go, y, taken = go[on], y[on], taken[on]
            until[live], x[live] = self.made[x[live]], self.right[x[live]]
            live = live[(x[live] >= 0) & out[live]]
        return out

    def arcs(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The same, remembered in a table of fixed size."""
        key = s.astype(np.uint64) << np.uint64(32) | t.astype(np.uint64)
        slot = (key * _MIX >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        out = self.answer[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            found = self.open((pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
            at = (pairs * _MIX >> np.uint64(64 - ARC_BITS)).astype(np.int64)
            self.known[at] = pairs
            self.answer[slot[new]] = out[new] = found[back]
            self.answer[at] = found
        return out

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of binary words (large_binary) one after another, and how many each has."""
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        begins, lengths = offsets[:-1], np.diff(offsets)
        order = np.argsort(lengths, kind="stable")
        word, step, token = [], [], []  # a word's steps count from its last token

        def walk_alone(some: np.ndarray) -> None:
            for i in some.tolist():
                w = data[begins[i] : begins[i] + lengths[i]].tobytes()
                ids = [self.automaton.special[w.decode()]] if w in special else self.automaton.word(w)
                word.append(np.full(len(ids), i))
                step.append(np.arange(len(ids))[::-1])
                token.append(np.array(ids, np.int64))

        special = {x.encode() for x in self.automaton.special}
        wide = np.searchsorted(lengths[order], WIDE, "right")
        at = 0
        while at < wide:
            size = int(lengths[order[at]])
            most = max(64, (1 << 19) // (size * size + 1))
            some = order[at : min(at + most, wide)]
            some = some[lengths[some] <= size + 2]
            at += len(some)
            found, bad = self._walk(data, begins[some], lengths[some])
            for x, y in zip((word, step, token), (some[found[0]], *found[1:]), strict=True):
                x.append(y)
            walk_alone(some[bad])
        walk_alone(order[wide:])
        if not word:
            return np.empty(0, np.uint32), np.zeros(len(distinct), np.int64)
        word, step, token = map(np.concatenate, (word, step, token))
        sizes = np.bincount(word, minlength=len(distinct)).astype(np.int64)
        out = np.empty(len(token), np.uint32)
        out[np.cumsum(sizes)[word] - 1 - step] = token
        return out, sizes

    def _walk(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """(word, step, token) of words of about one length, and the words that a hash misled."""
        n, wide = len(begins), int(lengths.max())
        rows = data[np.minimum(begins[:, None] + np.arange(wide), len(data) - 1)] if len(data) else np.empty((n, 0), np.uint8)
        h = _hashes(rows)
        last = np.full((wide + 1, n), -1, np.int64)
        whole = self.whole.get(h[lengths, np.arange(n)])
        last[lengths, np.arange(n)] = whole
        rest = np.flatnonzero(whole < 0)
        if len(rest):
            h, scale, of = h[:, rest], 1, []
            for size in range(1, min(wide, self.automaton.longest) + 1):
                scale = scale * int(_BASE) & (1 << 64) - 1
                of.append(self.part.get((h[size:] - h[:-size] * np.uint64(scale)).ravel()).reshape(wide + 1 - size, -1))
            mine = np.full((wide + 1, len(rest)), -1, np.int64)
            for end in range(1, wide + 1):
                for size in range(min(end, len(of)), 0, -1):
                    t = of[size - 1][end - size]
                    at = np.flatnonzero((t >= 0) & (mine[end] < 0))
                    if size < end and len(at):
                        s = mine[end - size][at]
                        at, s = at[s >= 0], s[s >= 0]
                        at = at[self.arcs(s, t[at])]
                    mine[end][at] = t[at]
            last[:, rest] = mine
        word, step, token, place, k = [], [], [], lengths.copy(), 0
        on, bad = np.flatnonzero(lengths > 0), np.zeros(n, bool)
        while len(on):
            t = last[place[on], on]
            bad[on[t < 0]] = True
            on, t = on[t >= 0], t[t >= 0]
            place[on] -= self.sizes[t]
            bad[on[place[on] < 0]] = True
            word.append(on)
            step.append(np.full(len(on), k))
            token.append(t)
            on, k = on[place[on] > 0], k + 1
        if not word:
            return (np.empty(0, np.int64),) * 3, np.flatnonzero(bad)
        word, step, token = map(np.concatenate, (word, step, token))
        order = np.lexsort((-step, word))
        word, step, token = word[order], step[order], token[order]
        # the labels must spell the words
        given = np.ones(len(token), bool) if not bad.any() else ~bad[word]
        spelled = self.spell(token[given])
        own = np.repeat(begins[~bad], lengths[~bad]) + _counted(lengths[~bad])
        if len(spelled) != len(own) or not np.array_equal(spelled, data[own]):
            bad[:] = True
        keep = ~bad[word]
        return (word[keep], step[keep], token[keep]), np.flatnonzero(bad & (lengths > 0))

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the labels, one after another."""
        got = self.labels.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64)
        return np.frombuffer(got.buffers()[2] or b"", np.uint8)[: ends[len(ids)]]


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def compile_file(text: str) -> Automaton:
    """From a tokenizers JSON file's content (byte-level BPE)."""
    model = json.loads(text)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    names = model["model"]["vocab"]
    vocabulary = {raw(k): i for k, i in names.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    return Automaton(vocabulary, [(names[a], names[b], names[a + b]) for a, b in pairs], special)


class Encoder:
    """Columns of texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, automaton: Automaton) -> None:
        self.walker, self.special = Walker(automaton), tuple(automaton.special)

    def encode(self, column: pa.Array) -> pa.Array:
        words = presplit.Words(column, self.special)
        return presplit.packed(*presplit.spread(*self.walker.words(words.distinct), words))

    def decode(self, column: pa.Array) -> pa.Array:
        """large_binary ids to text; bytes that are no text become U+FFFD."""
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4")
        got = self.walker.labels.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64)[(offsets - offsets[0]) // 4]
        raw = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(ends)), got.buffers()[2]])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


_ENCODERS: dict[str, Encoder] = {}


def _encoder(sent: Sent) -> Encoder:
    """This worker's encoder for a broadcast file; one is kept."""
    if sent.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[sent.id] = Encoder(sent.value)
    return _ENCODERS[sent.id]


class Sent:
    """A broadcast with a name of its own, by which reused workers know it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._b = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self._b.value


class Tokenizer:
    """A compiled automaton, broadcast; its methods are DataFrame operations."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        with open(path or default_path(), encoding="utf-8") as f:
            self.sent = Sent(spark, compile_file(f.read()))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, ids: binary, little-endian unsigned 32-bit integers."""
        sent = self.sent

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b["id"], _encoder(sent).encode(b["t"]).cast(pa.binary())], names=["doc_id", "ids"])

        return common.mapped(_slim(docs, id_col, text_col), run, "doc_id long, ids binary")

    def decode(self, tokens: DataFrame) -> DataFrame:
        """doc_id, ids, text. Null ids: the empty text."""
        sent = self.sent

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            text = _encoder(sent).decode(b["ids"].fill_null(b"").cast(pa.large_binary()))
            return pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], text.cast(pa.string())], names=["doc_id", "ids", "text"])

        return common.mapped(tokens.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, ids, text: encoded and decoded from these ids in one pass."""
        sent = self.sent

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            e = _encoder(sent)
            ids = e.encode(b["t"])
            return pa.RecordBatch.from_arrays([b["id"], ids.cast(pa.binary()), e.decode(ids).cast(pa.string())], names=["doc_id", "ids", "text"])

        return common.mapped(_slim(docs, id_col, text_col), run, "doc_id long, ids binary, text string")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    common.small_batches(docs.sparkSession)
    out = Tokenizer(docs.sparkSession, path).round_trip(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "documents"))
