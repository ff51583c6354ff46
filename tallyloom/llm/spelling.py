"""Spelling variants: the vocabulary's acceptor, composed with a one-edit transducer and with itself.

*Vocabulary.* Words are maximal runs of letters; counts are combined in each task before they are shuffled. (The
query's vocabulary has seeded typing errors: one occurrence in 199 loses a letter.)

*Composition.* The transducer has two states: no edit made yet, one edit made (insertion, deletion or replacement
of a code point). Composed with a deterministic acceptor on both sides, its first state keeps both acceptors in one
state q, and an edit leads to a pair of states, from where both must accept the same rest. Accepted pairs are
enumerated path by path; a pair of states is worked out once. An inserted code point stands last in its run, so
each pair is accepted once.

*Partitions.* Let h be half the length of the shorter word, rounded down. An edit at or after place h leaves the first h
code points equal; one before it, the last h (read backwards). So the acceptor is built, minimised and composed from
the state reached by h code points of a word or of its reversal, one such initial state at a time: a word is
in at most four partitions, none holds words that don't share half their length, and a word has at most some 120
near words for each code point of its length. Rows of a partition are streamed, sorted by their initial state; only
per-word counts and best forms leave it, never a list of pairs.

*Roots.* A form is at least ``RATIO`` times as frequent as its word, so chains are at most log(n) / log(ratio) long, and
doubling the steps takes a logarithm of that in joins.

Defined results: null and empty texts have no words. A null id counts as empty text in the seed. Repeated rows count
each. Words of one length class may be of any length. Extra columns are not read. No words, no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST, RATIO, ERROR = 6, 5, 5, 199
#: Distinct words that a task counts before it hands them on, and texts (characters) that are matched at once.
HELD, LONG = 400_000, 4_000_000


def counted(doc_id: object, text: bytes, least_length: int, error: int | None) -> Counter:
    """A document's words, its seeded errors made."""
    lowered = text.lower().decode("utf-8", "replace")  # bytes: lowers A-Z only
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")
    found = Counter(runs.findall(lowered) if len(lowered) < LONG else (m.group() for m in runs.finditer(lowered)))
    if error is None:
        return found
    out, seed = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), seed)
        if h % error == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least_length:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST, error: int | None = None) -> DataFrame:
    """word, n: words of at least that many code points and occurrences."""

    def emitted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            for doc_id, text in zip(b["id"].to_pylist(), common.texts(b["text"]), strict=True):
                for word, n in counted(doc_id, text, least_length, error).items():
                    total[word] += n
                if len(total) > HELD:
                    yield emitted(total)
                    total = Counter()
        yield emitted(total)

    common.small_batches(docs.sparkSession)
    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words, built word by word. State 0 upwards; the last is the start."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        known: dict = {}
        path, last = [[False, []]], ""

        def frozen(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = known.setdefault(key, len(known))
            if state == len(self.arcs):
                self.final.append(key[0])
                self.arcs.append(key[1])
            return state

        for word in [*words, ""]:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], frozen(node)))
            path += [[False, []] for _ in word[same:]]
            if word or (words and not words[0]):
                path[-1][0] = True
            last = word
        self.start = frozen(path[0])

    def common(self, p: int, q: int) -> list[str]:
        """What is accepted from both states."""
        out, stack = [], [(p, q, "")]
        while stack:
            p, q, rest = stack.pop()
            if self.final[p] and self.final[q]:
                out.append(rest)
            if p == q:
                stack += [(r, r, rest + a) for a, r in self.arcs[p]]
            elif self.arcs[p] and self.arcs[q]:
                other = dict(self.arcs[q])
                stack += [(r, other[a], rest + a) for a, r in self.arcs[p] if a in other]
        return out


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of the words that differ by one edit, each once: the acceptor, one edit, the acceptor."""
    machine, known = Acceptor(words), {}

    def after(p: int, q: int) -> list[str]:
        if (p, q) not in known:
            known[p, q] = machine.common(p, q)
        return known[p, q]

    stack = [(machine.start, "")]
    while stack:
        state, path = stack.pop()
        arcs = machine.arcs[state]
        for i, (a, p) in enumerate(arcs):
            stack.append((p, path + a))
            for rest in after(state, p):  # a inserted here
                if not rest.startswith(a):
                    yield path + rest, path + a + rest
            for b, q in arcs[i + 1 :]:  # a and b replace each other
                for rest in after(p, q):
                    yield path + a + rest, path + b + rest


def partition_pairs(words: list[str], h: int, backward: bool) -> Iterator[tuple[str, str]]:
    """Pairs that belong to the initial state after the first (backward: last) h code points, which all words share."""
    if backward:
        head, rests = words[0][-h:], sorted(w[:-h][::-1] for w in words)
    else:
        head, rests = words[0][:h], sorted(w[h:] for w in words)
    for x, y in near_pairs(rests):
        if (min(len(x), len(y)) + h) // 2 != h:
            continue
        if not backward:
            yield head + x, head + y
        elif (a := x[::-1] + head)[:h] != (b := y[::-1] + head)[:h]:  # else found forward
            yield a, b


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n_near, form, form_n: for each word (word, n) that has near words, their number and the most frequent one (ties: the
    first in code-point order)."""
    if least_length < 2:
        raise ValueError("words need two code points at least")
    length = F.char_length("word")
    halves = F.array_distinct(F.array(F.floor(length / 2), F.floor(F.greatest(length - 1, F.lit(least_length)) / 2))).cast("array<int>")
    keyed = words.select("word", "n", F.explode(halves).alias("h")).select("word", "n", "h", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    keyed = keyed.withColumn("state", F.when(F.col("backward"), F.expr("right(word, h)")).otherwise(F.expr("left(word, h)")))

    def found(key: tuple, counts: dict[str, int], out: dict[str, list]) -> None:
        for x, y in partition_pairs(list(counts), key[0], key[1]):
            for word, other in ((x, y), (y, x)):
                n, best = counts[other], out.get(word)
                if best is None:
                    out[word] = [1, n, other]
                else:
                    best[0] += 1
                    if (-n, other) < (-best[1], best[2]):
                        best[1:] = n, other

    def emitted(rows: list[tuple[str, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.string()), pa.array([b[0] for _, b in rows], pa.int64()), pa.array([b[1] for _, b in rows], pa.int64()), pa.array([b[2] for _, b in rows], pa.string())],
            names=["word", "n_near", "form_n", "form"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, ready = None, {}, []
        for b in batches:
            for *key, word, n in zip(*(b[c].to_pylist() for c in ("h", "backward", "state", "word", "n")), strict=True):
                if key != now:
                    if len(counts) > 1:
                        found(now, counts, out := {})
                        ready += out.items()
                    now, counts = key, {}
                    if len(ready) > 10_000:
                        yield emitted(ready)
                        ready = []
                counts[word] = n
        if len(counts) > 1:
            found(now, counts, out := {})
            ready += out.items()
        yield emitted(ready)

    dealt = keyed.repartition("h", "backward", "state").sortWithinPartitions("h", "backward", "state").select("h", "backward", "state", "word", "n")
    parts = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))


def variants(words: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of (word, n)."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    near = near_words(words, least_length)
    enough = F.col("form_n") >= ratio * F.col("n")
    each = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    each = common.stored(each, "forms")
    most = each.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)))
    to = common.cut(each.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = common.cut(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return each.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = common.stored(vocabulary(common.read(spark, sf_dir, "documents"), error=ERROR), "vocabulary")
    return variants(words)
