"""Near copies of documents: minhash bands, then sequential Bayesian verification.

A document's set is its distinct word shingles. Documents with equal sets are one class. Classes whose signatures
agree in a band are candidates; their signatures are compared batch by batch, and a candidate goes as soon as
the posterior probability that its similarity reaches the threshold falls below ``miss``. What survives is
verified on the full sets. Links make components; a document is kept where it is its component's first.

Groups of copies are not expanded. First every member of a bucket is compared with the bucket's head only, the class
that meets most others; what it hasn't reached, with the head among that. Buckets that then lie within one component
are done. In the others all pairs across components are compared, in blocks of bounded size, and verified in place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ids_and_texts, perhaps_among, process_memo, stored
from .components import components

#: Words a worker remembers before it starts anew; changes speed only.
REMEMBERED = 300_000
#: Bands and rows: a pair at similarity 0.8 shares a band but once in 150,000 cases.
BANDS, ROWS = 30, 5
BATCH = 30
BLOCK = 512
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each hashed once per worker as long as it is remembered."""
    import xxhash

    known = process_memo("word_hashes")
    every = set(words)
    new = every.difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = every
    for word in new:
        known[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle digests per text.

    ASCII capitals become small and words end at ASCII white space. A text of fewer words than ``size`` has its whole
    sequence as its only shingle, told apart from longer ones by its length; a text without words has none.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = [len(w) for w in words]
    h = word_hashes([x for w in words for x in w])
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                        0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)
    if size > len(factors):
        raise ValueError(f"shingles of more than {len(factors)} words are not supported")
    joined = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        joined += h[k:k + len(joined)] * factors[k]
    joined = mixed(joined + np.uint64(size))
    sets, start = [], 0
    for n in lengths:
        if n >= size:
            sets.append(np.unique(joined[start:start + n - size + 1]))
        elif n:
            sets.append(mixed(np.array([(h[start:start + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            sets.append(np.empty(0, np.uint64))
        start += n
    return sets


def multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(20_11).integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value under each of many multiplications of the shingle digests, its upper 32 bits."""
    low = np.full(len(factors), MASK)
    for at in range(0, len(values), 1024):
        low = np.minimum(low, (values[None, at:at + 1024] * factors[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, miss: float, k: int = BANDS * ROWS) -> np.ndarray:
    """For each n: the fewest of n matches at which P(similarity >= threshold), after a flat prior, is at least ``miss``."""
    x = np.linspace(0.0005, 0.9995, 2000)
    need = np.zeros(k + 1, int)
    for n in range(1, k + 1):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log(1 - x)
            w = np.exp(logs - logs.max())
            if w[x >= threshold].sum() / w.sum() >= miss:
                need[n] = m
                break
    return need


def signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, class, n_shingles, signature): ``class`` is a digest of the set, null where the set is empty."""
    rows = ids_and_texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    factors = multipliers(BANDS * ROWS)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for at in range(0, batch.num_rows, 128):
                sets = shingle_sets(texts[at:at + 128].to_pylist(), words)
                yield pa.RecordBatch.from_arrays([
                    ids[at:at + 128],
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s, factors).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["id", "class", "n_shingles", "signature"])

    return rows.mapInArrow(run, f"id {kind}, class BINARY, n_shingles BIGINT, signature BINARY")


def banded(classes: DataFrame) -> DataFrame:
    """(class, band, key) with one row per band."""

    def run(batches):
        factors = multipliers(ROWS)
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(n, BANDS, ROWS)
            keys = mixed((sig.astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("class").take(pa.array(np.repeat(np.arange(n), BANDS))),
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys.ravel())], ["class", "band", "key"])

    return classes.select("class", "signature").mapInArrow(run, "class BINARY, band INT, key BIGINT")


def prune(pairs: DataFrame, signatures: DataFrame, need: np.ndarray) -> DataFrame:
    """Of pairs (a, b) those whose signatures, compared batch by batch, leave the threshold likely enough."""
    full = (pairs.join(signatures.select(F.col("class").alias("a"), F.col("signature").alias("sa")), "a")
            .join(signatures.select(F.col("class").alias("b"), F.col("signature").alias("sb")), "b"))

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, int)
            for at in range(0, BANDS * ROWS, BATCH):
                matches[alive] += (left[alive, at:at + BATCH] == right[alive, at:at + BATCH]).sum(axis=1)
                alive = alive[matches[alive] >= need[at + BATCH]]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a BINARY, b BINARY")


def stars(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with its head, the class that shares most buckets with others.

    ``members``: (band, key, class, weight). One pair per member at most, however large a bucket is.
    """
    heads = members.groupBy("band", "key").agg(F.max_by("class", F.struct("weight", "class")).alias("head"))
    return members.join(heads, ["band", "key"]).where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()


def placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` of buckets that hold several components, with ``component`` and that of the bucket's head."""
    named = groups.select(F.col("node").alias("class"), "component")
    rows = stored(members.join(named, "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    several = rows.groupBy("band", "key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.max_by("component", F.struct("weight", "class")).alias("head_component")).where("low <> high")
    out = stored(rows.join(several.select("band", "key", "head_component"), ["band", "key"]), "spread")
    forget(rows)
    return out


def in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """Members of a bucket in blocks of bounded size, once for every pair (low, high) of blocks, so a group holds two at most."""
    sizes = members.groupBy("band", "key").agg(F.expr(f"CAST(ceil(count(1) / {BLOCK}) AS INT)").alias("parts"))
    parts = members.join(sizes, ["band", "key"])
    parts = parts.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    return parts.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class",
        "component", "signature", *columns)


def surviving(key: tuple, table: pa.Table, need: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(-matches, i, j) of the pairs of two blocks across components that survive the comparison of signatures; components.

    A pair that shares several buckets is looked at in that of its first band only.
    """
    band, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(table.num_rows, -1)
    part = table.column("part").to_numpy()
    component = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
    left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
    found = []
    for i in left:
        j = right[(right > i) if low == high else slice(None)]
        j = j[component[j] != component[i]]
        matches = np.zeros(len(j), int)
        for at in range(0, BANDS * ROWS, BATCH):
            matches = matches + (sig[j, at:at + BATCH] == sig[i, at:at + BATCH]).sum(axis=1)
            alive = matches >= need[at + BATCH]
            j, matches = j[alive], matches[alive]
            if not len(j):
                break
        before = (sig[j, :band * ROWS] == sig[i, :band * ROWS]).reshape(len(j), band, ROWS).all(axis=2).any(axis=1)
        j, matches = j[~before], matches[~before]
        found += zip((-matches).tolist(), [int(i)] * len(j), j.tolist())
    return found, component


def likely_across(members: DataFrame, need: np.ndarray) -> DataFrame:
    """Those of ``members`` (band, key, class, component, signature) that are in a surviving pair of their bucket.

    Only signatures travel; the sets are many times as large, and few members need theirs.
    """

    def group(key, table):
        found, _ = surviving(key, table, need)
        rows = np.unique(np.array([(i, j) for _, i, j in found], np.int64))
        return table.select(["band", "key", "class", "component", "signature"]).take(pa.array(rows, pa.int64()))

    shape = "band INT, key BIGINT, class BINARY, component BINARY, signature BINARY"
    rows = in_blocks(members).groupBy("band", "key", "low", "high").applyInArrow(group, shape)
    return rows.dropDuplicates(["band", "key", "class"])


def across(members: DataFrame, need: np.ndarray, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket.

    ``members``: (band, key, class, component, signature, shingles). A bucket is cut into blocks and every pair of its
    blocks is one group, so a group holds two blocks at most. Pairs that survive the comparison of signatures are
    verified in place, likeliest first, unless links found before have joined their components; pairs never leave.
    """

    def group(key, table):
        found, component = surviving(key, table, need)
        root = list(range(int(component.max()) + 1 if len(component) else 0))

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sets = [np.frombuffer(s.as_py(), "<u8") for s in table.column("shingles")]
        out_a, out_b = [], []
        for _, i, j in sorted(found):
            x, y = top(int(component[i])), top(int(component[j]))
            if x != y and alike(sets[i], sets[j], percent):
                root[x] = y
                out_a.append(i)
                out_b.append(j)
        name = table.column("class")
        return pa.table({"a": name.take(pa.array(out_a, pa.int64())), "b": name.take(pa.array(out_b, pa.int64()))})

    return in_blocks(members, "shingles").groupBy("band", "key", "low", "high").applyInArrow(group, "a BINARY, b BINARY")


def alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    at = np.searchsorted(one, other)
    same = int((one[np.minimum(at, len(one) - 1)] == other).sum())
    return 100 * same >= percent * (len(one) + len(other) - same)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int = 256) -> DataFrame:
    """Of stored pairs (a, b) those with 100 * intersection >= percent * union on the full sets (class, shingles).

    The partners of one class are dealt in chunks; a group holds its set and those of one chunk.
    """
    sizes = pairs.groupBy("a").agg(F.expr(f"CAST(ceil(count(1) / {chunk}) AS INT)").alias("chunks"))
    rows = pairs.join(sizes, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    partners = rows.select("a", "chunk", F.col("b").alias("class")).join(sets, "class")
    heads = sizes.select("a", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("a").alias("class")).join(sets, "class")
    together = partners.unionByName(heads)

    def group(key, table):
        names = table.column("class").to_pylist()
        shingles = [np.frombuffer(s.as_py(), "<u8") for s in table.column("shingles")]
        head = key[0].as_py()
        own = shingles[names.index(head)]
        hits = []
        for name, other in zip(names, shingles):
            if name != head and alike(own, other, percent):
                hits.append(name)
        return pa.table({"a": pa.array([head] * len(hits), pa.binary()), "b": pa.array(hits, pa.binary())})

    return together.select("a", "chunk", "class", "shingles").groupBy("a", "chunk").applyInArrow(group, "a BINARY, b BINARY")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(class, shingles) for wanted (class, first_id), from the texts of these documents."""
    rows = perhaps_among(ids_and_texts(docs, id_col, text_col), "id", wanted, "first_id")
    texts = rows.join(wanted.withColumnRenamed("class", "wanted"), F.col("id").eqNullSafe(F.col("first_id")))

    def run(batches):
        for batch in batches:
            classes, texts = batch.column("wanted"), batch.column("text")
            for at in range(0, batch.num_rows, 128):
                sets = shingle_sets(texts[at:at + 128].to_pylist(), words)
                raw = [s.tobytes() for s in sets]
                # An id that stands for several texts meets all of them here.
                hit = [i for i, r in enumerate(raw) if hashlib.blake2b(r, digest_size=16).digest() == classes[at + i].as_py()]
                yield pa.RecordBatch.from_arrays([classes.take(pa.array([at + i for i in hit], pa.int64())),
                                                  pa.array([raw[i] for i in hit], pa.binary())], ["class", "shingles"])

    return texts.select("wanted", "text").mapInArrow(run, "class BINARY, shingles BINARY").dropDuplicates(["class"])


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-4,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    * null or empty text, or white space only: no shingles, linked with nothing, its own component
    * null id: shares the component of its copies; with copies that have ids it isn't kept, without any its component is null
      and it is kept
    * repeated rows: all get the same answer; ties cannot arise, as the smallest id decides
    * empty table: no rows; other columns are not looked at; very long texts are taken whole
    """
    need = least_matches(percent / 100, miss)
    # Signatures lie in one table, buckets in one; what is no longer needed goes at once.
    whole = stored(signed(docs, words, id_col, text_col), "signed")
    classes = stored(whole.where("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("first_id"), F.first("signature").alias("signature")), "classes")
    rows = stored(whole.select("id", "class", "n_shingles"), "rows")
    forget(whole)
    bands = stored(banded(classes), "bands")
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meetings = stored(bands.join(buckets, ["band", "key"]), "meetings")
    forget(bands)
    weights = meetings.groupBy("class").agg(F.sum("n").alias("weight"))
    members = stored(meetings.join(weights, "class").select("band", "key", "class", "weight"), "members")
    forget(meetings)
    # Of the signatures only those of classes in a shared bucket are joined again.
    involved = stored(classes.join(members.select("class").distinct(), "class"), "involved")
    sets = stored(sets_of(docs, involved.select("class", "first_id"), words, id_col, text_col), "sets")

    # Stars: each member with its bucket's head, then those the head hasn't reached with the head among them.
    pairs = stored(prune(stars(members), involved, need), "pairs")
    links = stored(verified(pairs, sets, percent), "links")
    forget(pairs)
    reached = components(links)
    rest = placed(members, reached)
    pairs = stored(prune(stars(rest.where("component <> head_component").select("band", "key", "class", "weight")), involved, need), "pairs")
    before, links = links, stored(links.unionByName(verified(pairs, sets, percent)), "links")
    forget(rest, pairs, before)
    # What buckets still hold several components: all that lies across them.
    reached = components(links)
    rest = placed(members, reached)
    still = rest.select("band", "key", "class", "component").join(involved.select("class", "signature"), "class")
    near = stored(likely_across(still, need), "near")
    before, links = links, stored(links.unionByName(across(near.join(sets, "class"), need, percent)), "links")
    forget(before, members, rest, sets, involved, near)
    final = components(links)

    named = final.join(classes.select(F.col("class").alias("node"), "first_id"), "node")
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(first, "component").select(F.col("node").alias("class"), "component_id")
    owners = stored(classes.join(linked, "class", "left").select(
        "class", F.coalesce("component_id", "first_id").alias("component_id")), "owners")
    forget(classes, links)
    answer = rows.join(owners, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return answer.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))
