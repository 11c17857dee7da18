"""Scoring of texts by a hashed maximum-entropy model with classes.

Words are counted over all training documents. The commonest words (a bounded number) have ids of their own and lie in
classes and subclasses; all other words are one outcome of the model and share its mass by their counts.
P(word) = P(class | context) P(subclass | class, context) P(word | subclass), where the first softmax has a row of weights
for each hashed feature: the word before, the one before that (a skip), and both together; the second one has a row for each
class with the word before.

Tasks train on their documents from common weights; the rows they have touched are averaged by how often they were
touched, epoch after epoch. What grows with the corpus, counts of rare words above all, stays in Spark tables and meets
the documents by joins; what tasks hold (ids, weights) has a fixed size.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, process_memo, stored
from .folding import folded
from .language import fold

#: Words with ids of their own, and words whose counts tasks know without a join, at most.
HEAD, KNOWN = 65_534, 262_144
#: Ids of all other words together and of the end of a text; words follow.
OTHER, END = 0, 1
CLASSES = SUBCLASSES = 16
#: Rows of weights for classes and for subclasses, as powers of two (at most 16).
BITS = 16
#: Neighbours told apart on each side when words are dealt into classes.
NEIGHBOURS = 16
BATCH = 8192
#: Words a worker remembers before it starts anew; bytes of text it splits at a time; change speed only.
REMEMBERED, PIECE = 200_000, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: What a count is raised by.
EXTRA = 0.1
LN10 = np.log(10.0)


def pieces(raw: bytes):
    """Stretches of a text that end at white space, of bounded size unless a single word is longer."""
    at = 0
    while at < len(raw):
        stop = at + PIECE
        if stop < len(raw):
            space = SPACE.search(raw, stop)
            stop = space.start() if space else len(raw)
        yield raw[at:stop]
        at = stop


def slices(batch, some: int = 1 << 20):
    """(first row, texts as small-letter bytes) for stretches of a batch of bounded size."""
    texts = batch.column("text").cast(pa.binary())
    start, size, out = 0, 0, []
    for row, text in enumerate(texts):
        raw = text.as_py()
        if out and size + len(raw) > some:
            yield start, out
            start, size, out = row, 0, []
        out.append(raw.lower())
        size += len(raw)
    if out:
        yield start, out


def digest(word: bytes) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c): how often every word occurs in the texts, by its 64-bit digest."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array([digest(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        from collections import _count_elements  # what Counter.update calls

        for batch in batches:
            for _, texts in slices(batch):
                for piece in pieces(b"\n".join(texts)):
                    _count_elements(counts, piece.split())
                if len(counts) > REMEMBERED:
                    yield flushed()
        yield flushed()

    return training.select("text").mapInArrow(run, "word BIGINT, c BIGINT").groupBy("word").agg(F.sum("c").alias("c"))


def least_count(words: DataFrame, most: int) -> int:
    """The smallest count, of a fixed set of counts, that at most ``most`` words reach."""
    shift = F.greatest(F.floor(F.log2("c")) - 8, F.lit(0)).cast("int").alias("shift")
    steps = words.select("c", shift).select(F.expr("shiftleft(shiftright(c, shift), shift)").alias("step"))
    reached, least = 0, None
    for step, n in sorted(((r["step"], r["n"]) for r in steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        reached += n
        if reached > most:
            break
        least = step
    return least if least is not None else (1 << 62)


class Codes(dict):
    """word -> id, HEAD + 2 + place among ``counted`` words, or a code from ``first_rest`` on for words that must be joined."""

    def __init__(self, head: dict, counted: dict, first_rest: int) -> None:
        super().__init__()
        self.head, self.counted, self.first_rest, self.rest = head, counted, first_rest, []

    def __missing__(self, word: bytes) -> int:
        h = digest(word)
        code = self.head.get(h)
        if code is None:
            code = self.counted.get(h)
        if code is None:
            code = self.first_rest + len(self.rest)
            self.rest.append(h)
        self[word] = code
        return code

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.rest = []


def encoded(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """(uid, id, held_out, n_tokens, n_known, log_sum, ids, rest, rest_n), one row per document, stored.

    ``ids``: 16-bit ids of all tokens; ``n_known`` and ``log_sum`` (of log10(c + 0.1)) cover all tokens but ``rest``, the
    digests of words whose counts must be joined, each with its number in the document.
    """
    name, known = uuid.uuid4().hex, vocabulary
    kind = docs.schema["id"].dataType.simpleString()
    first_counted = HEAD + 2
    first_rest = first_counted + len(known["counted"])
    logs = np.log10(np.concatenate([[0.0], known["counts"], np.zeros(first_counted - 1 - len(known["counts"])), known["counted_counts"]]) + EXTRA)

    def run(batches):
        memo = process_memo("codes")
        if name not in memo:
            memo.clear()
            memo[name] = Codes({int(h): k + 2 for k, h in enumerate(known["head"])},
                               {int(h): k + first_counted for k, h in enumerate(known["counted"])}, first_rest)
        codes = memo[name]
        code_of = codes.__getitem__
        for batch in batches:
            for start, texts in slices(batch):
                codes.trim()
                made, lengths = [], np.zeros(len(texts), np.int64)
                for k, text in enumerate(texts):
                    for piece in pieces(text):
                        words = piece.split()
                        made.append(np.fromiter(map(code_of, words), np.int32, len(words)))
                        lengths[k] += len(words)
                flat = np.concatenate(made) if made else np.empty(0, np.int32)
                n = len(texts)
                doc = np.repeat(np.arange(n), lengths)
                ends = np.cumsum(lengths + 1) - 1
                ids = np.full(len(flat) + n, END, np.uint16)
                ids[np.arange(len(flat)) + doc] = np.where(flat < first_counted, flat, OTHER)
                far = flat >= first_rest
                near = np.flatnonzero(~far)
                sums = np.bincount(doc[near], logs[flat[near]], n) + logs[END]
                counted = np.bincount(doc[near], minlength=n) + (known["counts"][0] > 0)
                width = max(1, len(codes.rest))
                pair, times = np.unique(doc[far] * width + (flat[far] - first_rest), return_counts=True)
                words = np.array(codes.rest, np.int64)[pair % width] if len(pair) else np.empty(0, np.int64)
                cuts = pa.array(np.searchsorted(pair // width, np.arange(n + 1)).astype(np.int32))
                offsets = np.concatenate([[0], (ends + 1) * 2]).astype(np.int32)
                rows = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), rows.column("held_out"), pa.array(lengths + 1), pa.array(counted), pa.array(sums),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())]),
                    pa.ListArray.from_arrays(cuts, pa.array(words)), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
                    ["id", "held_out", "n_tokens", "n_known", "log_sum", "ids", "rest", "rest_n"])

    rows = docs.mapInArrow(run, f"id {kind}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, log_sum DOUBLE, ids BINARY, "
                                "rest ARRAY<BIGINT>, rest_n ARRAY<INT>")
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "encoded")


def runs_of_ids(batches, most: int = 1 << 20):
    """(first row, rows, ids, index of each row's first id) for stretches of documents of bounded size, ids of whole documents."""
    for batch in batches:
        start, size, out = 0, 0, []
        for row, value in enumerate(batch.column("ids")):
            out.append(value.as_buffer())
            size += out[-1].size // 2
            if size >= most:
                yield batch, start, *joined(out)
                start, size, out = row + 1, 0, []
        if out:
            yield batch, start, *joined(out)


def joined(parts: list) -> tuple[int, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(parts), np.uint16)
    return len(parts), flat, np.concatenate([[0], np.cumsum([p.size // 2 for p in parts])[:-1]]).astype(np.int64)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """32 well-mixed bits of small numbers."""
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def neighbour_counts(training: DataFrame, ids: int) -> np.ndarray:
    """(ids, 2 * NEIGHBOURS): how often an id has a neighbour of each kind before and behind it."""
    every = np.arange(HEAD + 2)
    own = NEIGHBOURS * 2 // 3
    kind = np.where(every < own, every, own + mixed(every, 5) % (NEIGHBOURS - own)).astype(np.int64)
    width, chunk = 2 * NEIGHBOURS, 1024
    chunks = -(-ids // chunk)

    def run(batches):
        process_memo("ids")  # the words of the stage before are forgotten
        total = np.zeros(chunks * chunk * width, np.int64)
        for _, _, _, flat, _ in runs_of_ids(batches):
            at = flat.astype(np.int64) * width
            total += np.bincount(at[1:] + kind[flat[:-1]], minlength=len(total))
            total += np.bincount(at[:-1] + NEIGHBOURS + kind[flat[1:]], minlength=len(total))
        parts = total.reshape(chunks, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["key", "payload"])

    def combine(payloads):
        return np.sum([np.frombuffer(p, np.int64) for p in payloads], axis=0).tobytes()

    out = np.zeros((chunks, chunk * width), np.int64)
    for r in folded(training.select("ids").mapInArrow(run, "key BIGINT, payload BINARY"), combine).collect():
        out[r["key"]] = np.frombuffer(r["payload"], np.int64)
    return out.reshape(-1, width)[:ids]


def classes_of(neighbours: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """Class of every row by its neighbours: nearest of ``groups`` centres, moved to their members' means in turn."""
    x = neighbours / np.maximum(neighbours.sum(axis=0), 1)
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32)
    weight = np.log1p(neighbours.sum(axis=1)).astype(np.float32)
    rng = np.random.default_rng(11)
    centres = [int(np.argmax(weight))]
    far = np.full(len(x), np.inf, np.float32)
    for _ in range(min(groups, len(x)) - 1):
        far = np.minimum(far, np.maximum(2 - 2 * (x @ x[centres[-1]]), 0))
        share = far * weight
        if not share.sum() > 0:
            break
        centres.append(int(rng.choice(len(x), p=(share / share.sum()).astype(float) / (share / share.sum()).astype(float).sum())))
    middle = x[centres]
    for _ in range(rounds):
        own = np.argmax(x @ middle.T, axis=1)
        total = np.zeros_like(middle)
        np.add.at(total, own, x * weight[:, None])
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        middle = np.where(norm > 0, total / np.maximum(norm, 1e-30), middle)
    return np.argmax(x @ middle.T, axis=1)


class Model:
    """Fixed parts (classes, masses) and weights; all of bounded size."""

    def __init__(self, counts: np.ndarray, other_mass: float, groups: np.ndarray) -> None:
        """``counts``: of END and then the words with ids; ``groups``: class of those words, from 1 on."""
        mass = np.concatenate([[other_mass], counts + EXTRA])
        self.one = np.concatenate([[0, 0], groups]).astype(np.int64)
        self.two = np.zeros(len(mass), np.int64)
        self.two[END] = 1
        for c in range(1, CLASSES):
            # Ids fall by count, so subclasses hold words of about the same count.
            members = np.flatnonzero(self.one == c)
            self.two[members] = np.arange(len(members)) * SUBCLASSES // max(1, len(members))
        leaf = self.one * SUBCLASSES + self.two
        total = np.bincount(leaf, mass, CLASSES * SUBCLASSES)
        self.within = np.log(mass / total[leaf])
        with np.errstate(divide="ignore"):
            table = np.maximum(np.log(total.reshape(CLASSES, SUBCLASSES)), -1e9)
        self.bias_two = (table - table.max(axis=1, keepdims=True)).astype(np.float32)
        self.bias_one = np.log(np.maximum(total.reshape(CLASSES, SUBCLASSES).sum(axis=1), 1e-300)).astype(np.float32)
        self.bias_one[total.reshape(CLASSES, SUBCLASSES).sum(axis=1) == 0] = -1e9
        self.bias_one -= self.bias_one.max()
        every = np.arange(HEAD + 2)
        self.salted = [mixed(every, 1000 + 77_777 * k) for k in range(5)]
        self.of_class = mixed(np.arange(CLASSES), 9_999_991)
        self.weights = [np.zeros((1 << BITS, CLASSES), np.float32), np.zeros((1 << BITS, SUBCLASSES), np.float32)]

    def contexts(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids one and two before; in front of a text there are ends."""
        before, skipped = np.full(len(flat), END, np.uint16), np.full(len(flat), END, np.uint16)
        before[1:] = flat[:-1]
        skipped[2:] = flat[:-2]
        before[starts] = skipped[starts] = END
        second = starts + 1
        skipped[second[second < len(flat)]] = END
        return before, skipped

    def rows_one(self, before, skipped) -> list[np.ndarray]:
        s, down = self.salted, np.uint32(32 - BITS)
        pair = (s[2][before] ^ s[3][skipped]) * np.uint32(0x9E3779B1)
        return [(r >> down).astype(np.uint16) for r in (s[0][before], s[1][skipped], pair)]

    def rows_two(self, before, one) -> list[np.ndarray]:
        row = (self.salted[4][before] ^ self.of_class[one]) * np.uint32(0x85EBCA6B)
        return [(row >> np.uint32(32 - BITS)).astype(np.uint16)]

    @staticmethod
    def logits(weights, rows, bias) -> np.ndarray:
        z = weights.take(rows[0], axis=0)
        for r in rows[1:]:
            z += weights.take(r, axis=0)
        z += bias
        # Far below where the exponential runs over.
        return np.minimum(z, 60, out=z)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        np.exp(z, out=z)
        z *= np.reciprocal(np.maximum(z @ np.ones(z.shape[1], np.float32), 1e-30))[:, None]
        return z

    @staticmethod
    def log_share(z: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Logarithm of the softmax at one place of each row."""
        own = z[np.arange(len(z)), of].astype(float)
        return own - np.log(np.maximum(np.exp(z) @ np.ones(z.shape[1]), 1e-30))

    def log_probabilities(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each id."""
        before, skipped = self.contexts(flat, starts)
        out = np.empty(len(flat))
        for at in range(0, len(flat), BATCH):
            w, b, s = flat[at:at + BATCH], before[at:at + BATCH], skipped[at:at + BATCH]
            one = self.one[w]
            first = self.log_share(self.logits(self.weights[0], self.rows_one(b, s), self.bias_one), one)
            second = self.log_share(self.logits(self.weights[1], self.rows_two(b, one), self.bias_two.take(one, axis=0)), self.two[w])
            out[at:at + BATCH] = first + second + self.within[w]
        return out


class Trainer:
    """Gradient steps from the model's weights, each row with a step size of its own."""

    def __init__(self, model: Model, rate: float, calm: float) -> None:
        self.model, self.rate = model, rate
        self.weights = [w.copy() for w in model.weights]
        self.steps = [np.full(len(w), calm, np.float32) for w in self.weights]
        self.touched = [np.zeros(len(w), np.float32) for w in self.weights]

    def update(self, level: int, rows: list[np.ndarray], g: np.ndarray) -> None:
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        row = row[first]
        g = np.add.reduceat(g.take(order % len(g) if len(rows) > 1 else order, axis=0), first, axis=0)
        self.touched[level][row] += np.diff(np.r_[first, len(order)])
        size = self.steps[level][row] + np.einsum("ij,ij->i", g, g)
        self.steps[level][row] = size
        g *= (self.rate / np.sqrt(size))[:, None]
        self.weights[level][row] -= g

    def learn(self, flat: np.ndarray, starts: np.ndarray) -> None:
        m = self.model
        before, skipped = m.contexts(flat, starts)
        for at in range(0, len(flat), BATCH):
            w, b, s = flat[at:at + BATCH], before[at:at + BATCH], skipped[at:at + BATCH]
            one, place = m.one[w], np.arange(len(w))
            rows = m.rows_one(b, s)
            g = m.softmax(m.logits(self.weights[0], rows, m.bias_one))
            g[place, one] -= 1
            self.update(0, rows, g)
            rows = m.rows_two(b, one)
            g = m.softmax(m.logits(self.weights[1], rows, m.bias_two.take(one, axis=0)))
            g[place, m.two[w]] -= 1
            self.update(1, rows, g)


def train(training: DataFrame, model: Model, epochs: int, rate: float, calm: float) -> None:
    """Epochs over all stored documents; weights become the touched rows' means, weighted by touches, over all tasks."""
    chunk = 1024
    per_level = (1 << BITS) // chunk

    def combine(payloads):
        return np.sum([np.frombuffer(p, np.float32) for p in payloads], axis=0, dtype=np.float32).tobytes()

    for _ in range(epochs):
        def run(batches):
            process_memo("ids")  # the words of the stage before are forgotten
            trainer = Trainer(model, rate, calm)
            for _, _, _, flat, starts in runs_of_ids(batches):
                trainer.learn(flat, starts)
            keys, payloads = [], []
            for level in (0, 1):
                n, w = trainer.touched[level], trainer.weights[level]
                for k in range(per_level):
                    cut = slice(k * chunk, (k + 1) * chunk)
                    if n[cut].any():
                        keys.append(level * per_level + k)
                        payloads.append(np.c_[w[cut] * n[cut, None], n[cut]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["key", "payload"])

        for r in folded(training.select("ids").mapInArrow(run, "key BIGINT, payload BINARY"), combine).collect():
            level, k = divmod(r["key"], per_level)
            part = np.frombuffer(r["payload"], np.float32).reshape(chunk, -1)
            hit = np.flatnonzero(part[:, -1])
            model.weights[level][k * chunk + hit] = part[hit, :-1] / part[hit, -1:]


def scored(rows: DataFrame, model: Model, counts: np.ndarray, other_mass: float) -> DataFrame:
    """(uid, id, held_out, n_tokens, n_known, log_sum, fixed): ``fixed`` plus the log sum of all tokens is the model's score.

    Words without ids take the share (c + 0.1) / other_mass of their outcome; as ``log_sum`` holds log10(c + 0.1) of all
    tokens, that of words with ids is taken off here.
    """
    logs = np.log10(np.concatenate([[other_mass], counts + EXTRA]))
    kept = ["uid", "id", "held_out", "n_tokens", "n_known", "log_sum"]
    columns = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for batch, start, n, flat, starts in runs_of_ids(batches):
            fixed = np.add.reduceat(model.log_probabilities(flat, starts) / LN10 - logs[flat], starts)
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, n) for c in kept] + [pa.array(fixed)], kept + ["fixed"])

    return rows.select(*kept, "ids").mapInArrow(run, f"{columns}, fixed DOUBLE")


def corpus_scores(docs: DataFrame, held_out=None, epochs: int = 1, rate: float = 0.8, calm: float = 30.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    ``held_out`` is a condition on ``docs``; what isn't held out is learned from. Scores are base-10 logarithms: ``base_score``
    by smoothed word counts, ``score`` by the model.

    * null or empty text: its end is its only token; null id: as any other, and learned from unless the condition says no
    * A-Z become small letters, words end at ASCII white space; very long texts are split piece by piece
    * repeated rows and ids: each row has its own scores; ties of counts do not matter, as whole counts are taken or left
    * no document to learn from: no word is known, and both scores are 0
    * empty table: no rows; other columns are not looked at

    Words are told apart by 64-bit digests. Outcomes of the model are the words with ids, the end, every other word seen in
    training and one for all that were not; their probabilities sum to one.
    """
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), out.alias("held_out"))
    training = named.where("NOT held_out")
    words = stored(word_counts(training), "words")
    ends = training.count()
    distinct, occurrences = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = occurrences + ends, distinct + (ends > 0)
    least_head, least_known = least_count(words, HEAD), least_count(words, KNOWN)
    top = words.where(F.col("c") >= least_known).toArrow()
    word, c = np.array(top.column("word"), np.int64), np.array(top.column("c"), np.int64)
    order = np.lexsort((word, -c))
    word, c = word[order], c[order]
    heads = int((c >= least_head).sum())
    vocabulary = {"head": word[:heads], "counts": np.concatenate([[ends], c[:heads]]).astype(float), "counted": word[heads:], "counted_counts": c[heads:].astype(float)}
    rows = encoded(named, vocabulary)

    other_mass = occurrences - float(c[:heads].sum()) + EXTRA * (distinct - heads + 1)
    lessons = rows.where("NOT held_out")
    groups = 1 + classes_of(neighbour_counts(lessons, heads + 2)[2:], CLASSES - 1) if heads else np.empty(0, int)
    model = Model(vocabulary["counts"], other_mass, groups)
    if ends:
        train(lessons, model, epochs, rate, calm)
    done = stored(scored(rows, model, vocabulary["counts"], other_mass), "scored")

    # Words that tasks had no count of meet it here; a word of the remaining table is too rare to be a hot key.
    pairs = rows.where("size(rest) > 0").select("uid", F.explode(F.arrays_zip("rest", "rest_n")).alias("p")).select(
        "uid", F.col("p.rest").alias("word"), F.col("p.rest_n").alias("times"))
    rare = words.where(F.col("c") < least_known)
    seen = F.coalesce("c", F.lit(0))
    found = pairs.join(rare, "word", "left").groupBy("uid").agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(seen + EXTRA)).alias("more_log"))
    every = done.join(found, "uid", "left")
    every = every.withColumn("log_sum", F.col("log_sum") + F.coalesce("more_log", F.lit(0.0)))
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(n + EXTRA * (v + 1))))
    return every.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("fixed") + F.col("log_sum") if ends else base).alias("score"))
