"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token ids and are cut only where they are longer than a sequence. Full pieces are sequences of
their own. The rest is dealt into blocks of bounded size; in each block a few islands evolve packings, whose
genes are whole bins: a crossover puts well-filled bins of one parent into the other, dissolves the bins that
hold one of their documents twice and puts the displaced documents back by best fit. Between epochs the best
packing of an island moves to the next island. In the end the emptiest bins of all blocks are packed once more together.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, process_memo, stored, trim_memory

#: Words a worker remembers of late, and as many of before; changes speed only.
REMEMBERED = 250_000
BLOCK_ITEMS = 4096
SPECIAL = "<|endoftext|>"
CONTROLS = re.compile("[\x1c-\x1f]")
#: Below it all Unicode tables agree on what is a letter.
LAST_LETTER = "\u0530"
WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Small Latin letters, each one character in every normal form, and the signs that may stand behind them.
LATIN = "".join(map(chr, [*range(97, 123), *range(223, 247), *range(248, 256)]))
SIGNS = "".join(chr(c) for c in range(33, 127) if chr(c) != "'" and not chr(c).isalnum())


class WordIds:
    """Ids of a text, put together from the ids of its stretches without white space.

    The tokenizer drops white space and never looks across it, so the ids of a text are those of its stretches one
    after the other. Letters and the signs behind them are encoded apart, as the tokenizer parts them too. New
    words go to the tokenizer's model; anything else goes through all its steps, together, parted by a special token.
    """

    def __init__(self, data: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.token_to_id(SPECIAL)
        # How the tokenizer's byte level writes a byte: printable ones as themselves, the others from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_level = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn_words(self, words: list[str]) -> None:
        """Words of letters only are one unit each, so they go straight to the tokenizer's model."""
        tokenize, known = self.tokenizer.model.tokenize, self.known
        for word in words:
            unit = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_level)
            known[word] = array("I", [t.id for t in tokenize(unit)]).tobytes()

    def learn_others(self, words: list[str]) -> None:
        odd = [w for w in words if any(s in w for s in self.special)]
        self.known.update((w, self.plain(w).tobytes()) for w in odd)
        words = [w for w in words if w not in self.known]
        for start in range(0, len(words), 2000):
            part = words[start:start + 2000]
            ids = self.plain(SPECIAL.join(part))
            raw, at = ids.tobytes(), np.flatnonzero(ids == self.mark)
            cuts = np.concatenate([[-1], at, [len(ids)]])
            if len(cuts) != len(part) + 1:  # a stretch that joins with the mark: one by one
                self.known.update((w, self.plain(w).tobytes()) for w in part)
            else:
                self.known.update((w, raw[(a + 1) * 4:b * 4]) for w, a, b in zip(part, cuts.tolist(), cuts[1:].tolist()))

    def learn(self, new: list[str]) -> None:
        letters, others, parted = set(), [], []
        latin = pc.match_substring_regex(pa.array(new, pa.string()), f"^[{LATIN}]+$").to_pylist()
        for word, plain in zip(new, latin):
            if plain:
                letters.add(word)
                continue
            if max(word) >= LAST_LETTER or not (word.isascii() or unicodedata.is_normalized("NFC", word)) or word != word.lower():
                others.append(word)
                continue
            elif word.isalpha():
                parts = (word, "")
            elif (m := WORD_AND_SIGNS.fullmatch(word)) and m[1].isalpha():
                parts = m.groups()
            else:
                others.append(word)
                continue
            letters.add(parts[0])
            if parts[1]:
                parted.append((word, *parts))
                if parts[1] not in self.known:
                    self.known[parts[1]] = self.plain(parts[1]).tobytes()
        self.learn_words(self.unknown(letters))
        self.learn_others(others)
        known = self.known
        for word, a, b in parted:
            known[word] = known[a] + known[b]

    def unknown(self, words) -> list[str]:
        """Which of the words aren't known; those known before become known of late."""
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        if before:
            known.update({w: before[w] for w in new if w in before})
            new = [w for w in new if w not in known]
        return new

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text).

        Words are split and told apart by Arrow, so that only distinct ones are looked up here.
        """
        lower = []
        for text in texts:
            # Lower case first saves work; not where the order of the tokenizer's own steps could show.
            if not ("Σ" in text or "İ" in text or "<|" in text) and unicodedata.is_normalized("NFC", text):
                text = text.lower()
            lower.append(text)
        if any(map(CONTROLS.search, lower)):
            # White space in general includes four control characters that the tokenizer keeps.
            lists = pa.array([t.split() if not CONTROLS.search(t) else re.split("[ \t\n\r]+", t) for t in lower], pa.large_list(pa.large_string()))
        else:
            lists = pc.utf8_split_whitespace(pa.array(lower, pa.large_string()))
        of_text = np.asarray(lists.value_lengths()).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        # Letters and signs behind them are looked up apart: there are fewer of each than of both together.
        stems = pc.utf8_rtrim(distinct, SIGNS)
        parted = pc.match_substring_regex(stems, f"^[{LATIN}]+$")
        stems = pc.if_else(parted, stems, distinct).dictionary_encode()
        signs = pc.if_else(parted, pc.utf8_ltrim(distinct, LATIN), "").dictionary_encode()
        units = stems.dictionary.to_pylist(), signs.dictionary.to_pylist()
        if len(self.known) + 2 * len(units[0]) > REMEMBERED:
            self.before, self.known = self.known, {}
        self.known[""] = b""
        if new := self.unknown([*units[0], *units[1]]):
            self.learn(new)
        parts = [*map(self.known.__getitem__, units[0]), *map(self.known.__getitem__, units[1])]
        pool = np.frombuffer(b"".join(parts), "<u4")
        both = np.stack([np.asarray(stems.indices), np.asarray(signs.indices) + len(units[0])], axis=1).ravel()
        pool, sizes = gathered(pool, np.fromiter(map(len, parts), np.int64, len(parts)) // 4, both)
        ids, size = gathered(pool, sizes.reshape(-1, 2).sum(axis=1), np.asarray(words.indices))
        ends = np.cumsum(size)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of_text)])]
        return ids, np.diff(upto)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.flat(texts)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def gathered(pool: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``pool``, which holds stretches of these sizes, in the order ``at``, and their sizes."""
    size = sizes[at]
    ends = np.cumsum(size)
    first = np.cumsum(sizes) - sizes
    return pool[np.repeat(first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def word_ids(data: str, digest: str) -> WordIds:
    memo = process_memo("word_ids")
    return memo.get(digest) or memo.setdefault(digest, WordIds(data))


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]), one row per piece of at most ``size`` ids.

    A document's ids are those of its text followed by ``end_id``, so a null or empty text has one id.
    """
    data = open(tokenizer_path, encoding="utf-8").read()
    digest = str(zlib.crc32(data.encode()))
    rows = ids_and_texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        coder = word_ids(data, digest)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                stop, some = at, 0
                while stop < batch.num_rows and (stop == at or some < 1_000_000):  # about a MB of text at a time
                    some += len(texts[stop].as_py())
                    stop += 1
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                flat, lengths = coder.flat(texts[at:stop].to_pylist())
                raw, begin = memoryview(flat.tobytes()), 0
                for i, n in enumerate(lengths.tolist(), at):
                    for k in range(0, n + 1, size):
                        cut = raw[(begin + k) * 4:(begin + min(n, k + size)) * 4]
                        closing = end if k + size > n else b""
                        row.append(i)
                        piece.append(k // size)
                        start.append(k)
                        length.append((len(cut) + len(closing)) // 4)
                        crc.append(zlib.crc32(closing, zlib.crc32(cut)))
                        if keep_ids:
                            kept.append(bytes(cut) + closing)
                    begin += n
                columns = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names)
                at = stop
        trim_memory()

    extra = ", ids BINARY" if keep_ids else ""
    out = rows.mapInArrow(run, f"id {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT{extra}")
    return out.withColumnRenamed("id", id_col)


class Bins:
    """Open bins by room left; the best fit is the lowest set bit at or above the item's length."""

    def __init__(self, size: int) -> None:
        self.size, self.members, self.room, self.by_room, self.mask = size, [], [], {}, 0

    def _list(self, k: int) -> None:
        room = self.room[k]
        self.by_room.setdefault(room, []).append(k)
        self.mask |= 1 << room

    def add_bin(self, items: list[int], room: int) -> None:
        self.members.append(items)
        self.room.append(room)
        self._list(len(self.room) - 1)

    def fit(self, item: int, length: int) -> None:
        above = self.mask >> length
        if not above:
            self.add_bin([item], self.size - length)
            return
        room = (above & -above).bit_length() - 1 + length
        stack = self.by_room[room]
        k = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        self.members[k].append(item)
        self.room[k] = room - length
        self._list(k)


def best_fit(order, lengths: list[int], size: int) -> list[list[int]]:
    bins = Bins(size)
    for i in order:
        bins.fit(i, lengths[i])
    return bins.members


def crossover(receiver: list[list[int]], donor: list[list[int]], lengths: list[int], size: int, share: float,
              rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of the donor go into the receiver whole; what they displace is put back by best fit."""
    fill = np.array([sum(lengths[i] for i in b) for b in donor], float)
    take = max(1, int(len(donor) * share))
    chosen = np.argsort(-(fill / size + rng.random(len(donor)) * 0.05))[:take]
    injected = [donor[k] for k in chosen]
    taken = {i for b in injected for i in b}
    bins, displaced = Bins(size), []
    for b in injected:
        bins.add_bin(list(b), size - sum(lengths[i] for i in b))
    for b in receiver:
        if taken.isdisjoint(b):
            bins.add_bin(list(b), size - sum(lengths[i] for i in b))
        else:
            displaced.extend(i for i in b if i not in taken)
    for i in sorted(displaced, key=lambda i: -lengths[i]):
        bins.fit(i, lengths[i])
    return bins.members


def mutate(packing: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Dissolve the emptiest twentieth and put its documents back by best fit."""
    fill = [sum(lengths[i] for i in b) for b in packing]
    order = sorted(range(len(packing)), key=fill.__getitem__)
    cut = max(1, len(packing) // 20)
    bins = Bins(size)
    for k in order[cut:]:
        bins.add_bin(list(packing[k]), size - fill[k])
    loose = [i for k in order[:cut] for i in packing[k]]
    for i in sorted(loose, key=lambda i: -lengths[i]):
        bins.fit(i, lengths[i])
    return bins.members


def fitness(packing: list[list[int]], lengths: list[int], size: int) -> tuple:
    """Fewer bins, then bins filled unevenly: full ones and one that is nearly empty."""
    return -len(packing), sum((sum(lengths[i] for i in b) / size) ** 2 for b in packing)


def evolve(population: list, lengths: list[int], size: int, people: int, generations: int, rng: np.random.Generator) -> list:
    """The population, best first, after some generations or as soon as no packing can have fewer bins."""
    least = -(-sum(lengths) // size)
    longest_first = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while len(population) < people:
        # Sorted with some noise, so that the first packings differ and none is the plain decreasing order.
        noise = rng.random(len(lengths)) * 0.3 + 0.85
        population.append(best_fit(sorted(longest_first, key=lambda i: -lengths[i] * noise[i]), lengths, size))
    rank = lambda p: fitness(p, lengths, size)
    population.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        best, other = population[0], population[1 + int(rng.integers(len(population) - 1))] if len(population) > 1 else population[0]
        share = float(rng.uniform(0.1, 0.4))
        children = [crossover(best, other, lengths, size, share, rng), crossover(other, best, lengths, size, share, rng)]
        children = [mutate(c, lengths, size) for c in children]
        population = sorted(population + children, key=rank, reverse=True)[:people]
    return population


def to_bytes(packing: list[list[int]], n: int) -> bytes:
    where = np.zeros(n, "<i4")
    for k, b in enumerate(packing):
        where[b] = k
    return where.tobytes()


def from_bytes(raw: bytes) -> list[list[int]]:
    bins: list[list[int]] = []
    for i, k in enumerate(np.frombuffer(raw, "<i4").tolist()):
        while len(bins) <= k:
            bins.append([])
        bins[k].append(i)
    return [b for b in bins if b]


def pack_blocks(items: DataFrame, size: int, islands: int = 2, epochs: int = 2, people: int = 4, generations: int = 8) -> DataFrame:
    """(uid, block, bin, room, offset) for ``items`` (uid, block, length), each block packed by its islands.

    ``items`` must be a stored table. A group is one island of one block, so its size is bounded by the block's.
    """
    schema = "block BIGINT, island INT, place INT, bins BIGINT, score DOUBLE, packing BINARY"
    spread = items.select("uid", "block", "length").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))

    def island(key, table, before, epoch: int) -> pa.Table:
        table = table.sort_by("uid")
        lengths = table.column("length").to_pylist()
        rng = np.random.default_rng([int(key[0].as_py()), int(key[1].as_py()), epoch])
        old = [] if before is None else [from_bytes(x) for x in before.sort_by([("place", "ascending")]).column("packing").to_pylist()]
        people_now = evolve(old, lengths, size, people, generations, rng) if lengths else []
        scores = [fitness(p, lengths, size) for p in people_now]
        n = len(people_now)
        return pa.table({
            "block": pa.array([key[0].as_py()] * n, pa.int64()), "island": pa.array([key[1].as_py()] * n, pa.int32()),
            "place": pa.array(range(n), pa.int32()), "bins": pa.array([-s[0] for s in scores], pa.int64()),
            "score": pa.array([s[1] for s in scores], pa.float64()),
            "packing": pa.array([to_bytes(p, len(lengths)) for p in people_now], pa.binary())})

    def first(key, table):
        return island(key, table, None, 0)

    def later(epoch):
        return lambda key, left, right: island(key, left, right, epoch)

    people_df = stored(spread.groupBy("block", "island").applyInArrow(first, schema), "islands")
    for epoch in range(1, epochs):
        elite = people_df.where("place = 0").withColumn("island", ((F.col("island") + 1) % islands).cast("int")).withColumn("place", F.lit(-1))
        arrived = people_df.unionByName(elite)

        people_df = stored(spread.groupBy("block", "island").cogroup(arrived.groupBy("block", "island"))
                           .applyInArrow(later(epoch), schema), "islands")
    best = people_df.where("place = 0").groupBy("block").agg(
        F.max_by("packing", F.struct(-F.col("bins"), "score", -F.col("island"))).alias("packing"))

    def place(key, left, right):
        left = left.sort_by("uid")
        lengths = left.column("length").to_numpy()
        where = np.frombuffer(right.column("packing")[0].as_py(), "<i4")
        order = np.argsort(where, kind="stable")
        total = np.bincount(where, weights=lengths).astype(np.int64)
        run = np.cumsum(lengths[order]) - lengths[order]
        first_run = np.zeros(len(total), np.int64)
        starts = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]])
        first_run[where[order][starts]] = run[starts]
        offset = np.empty(len(where), np.int64)
        offset[order] = run - first_run[where[order]]
        return pa.table({"uid": left.column("uid"), "block": left.column("block"), "bin": pa.array(where.astype(np.int64)),
                         "room": pa.array(size - total[where]), "offset": pa.array(offset)})

    return (items.select("uid", "block", "length").groupBy("block").cogroup(best.groupBy("block"))
            .applyInArrow(place, "uid BIGINT, block BIGINT, bin BIGINT, room BIGINT, offset BIGINT"))


def blocks_of(items: DataFrame, seed: int, first_block: int = 0) -> tuple[DataFrame, int]:
    """``items`` with an evenly dealt block of at most about BLOCK_ITEMS rows, and the number of blocks."""
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    return items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)) + F.lit(first_block)), blocks


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus (sequence_id, offset).

    * repeated rows and ties are separate pieces; empty table: no rows
    * a length above ``size``, null or not positive is refused by a failing job, not dropped
    """
    checked = pieces.withColumn("length", F.expr(
        f"CASE WHEN length BETWEEN 1 AND {size} THEN length ELSE CAST(raise_error('piece length out of range') AS BIGINT) END"))
    rows = stored(checked.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") == size).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = rows.where(F.col("length") < size).select("uid", "length")
    items, blocks = blocks_of(parts, 1)
    # The blocks' placings, then what lies in each block's emptiest bin is packed again over all blocks.
    packed = stored(pack_blocks(items, size), "packed")
    emptiest = packed.groupBy("block").agg(F.max_by("bin", F.struct("room", "bin")).alias("bin"))
    loose = packed.join(emptiest, ["block", "bin"]).select("uid").join(parts, "uid")
    again, _ = blocks_of(stored(loose, "loose"), 2, blocks)
    second = pack_blocks(stored(again, "loose-blocks"), size)
    firm = packed.join(emptiest, ["block", "bin"], "left_anti")
    number = (F.shiftleft("block", 16) + F.col("bin")).alias("sequence_id")
    where = (firm.select("uid", number, "offset").unionByName(second.select("uid", number, "offset")).unionByName(whole))
    return rows.join(where, "uid").drop("uid")


def packed_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, keep_ids: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token pieces in sequences: the columns of ``token_pieces`` plus (sequence_id, offset).

    * null or empty text: one piece of one id; null id: a piece with a null id; repeated rows: packed each
    * empty table: no rows; other columns are not looked at; very long texts: cut into full pieces and a rest
    """
    return pack(token_pieces(docs, tokenizer_path, size, end_id, keep_ids, id_col, text_col), size)
