"""SentencePiece encoding and decoding with a table of prefixes.

For a stretch of text, ``last[e]`` holds the last token of the encoding of its first ``e`` characters. That
token is unique: of the tokens an automaton finds ending at ``e``, it is the one that starts where another
prefix ends and that merging leaves side by side with that prefix's last token. The ids are read from the
table backwards.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, process_memo

SPACE = "▁"
#: Entries a worker remembers before it starts anew; changes speed only.
REMEMBERED = 250_000
NEVER = float("inf")


def read_model(path: str) -> dict:
    """What the table needs of a BPE model with byte fallback and no text normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    data = open(path, "rb").read()
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    norm = proto.normalizer_spec
    kinds = {p.type for p in proto.pieces}
    if (proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces
            or not kinds <= {1, 2, 3, 6}):
        raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation or user symbols")
    return {
        "digest": hashlib.sha256(data).hexdigest(),
        "pieces": [p.piece for p in proto.pieces], "scores": [p.score for p in proto.pieces],
        "types": [p.type for p in proto.pieces], "unknown": proto.trainer_spec.unk_surface,
        "begin": proto.trainer_spec.bos_id, "end": proto.trainer_spec.eos_id,
    }


def merge_all(text: str, rank: dict) -> tuple[list[str], list[tuple]]:
    """Plain merging: the best-ranked neighbours first, leftmost among equals. Symbols and merges in order."""
    symbols, merges = list(text), []
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], NEVER), i))
        order = rank.get(symbols[best] + symbols[best + 1], NEVER)
        if order == NEVER:
            break
        merges.append((best, len(symbols), order))
        symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols, merges


def edges(piece: str, rank: dict) -> tuple[list, list] | None:
    """How the right and the left end of a piece grow: [(symbol, rank at which it is taken up)].

    None if merging the piece's own characters doesn't lead to the piece, so that it never comes about.
    """
    symbols, merges = merge_all(piece, rank)
    if len(symbols) != 1:
        return None
    right, left = [], []
    now = list(piece)
    wait_right = wait_left = -1
    for at, size, order in merges:
        wait_right, wait_left = max(wait_right, order), max(wait_left, order)
        if at == size - 2:
            right.append((now[-1], wait_right))
            wait_right = -1
        if at == 0:
            left.append((now[0], wait_left))
            wait_left = -1
        now[at:at + 2] = [now[at] + now[at + 1]]
    return right + [(piece, NEVER)], left + [(piece, NEVER)]


class PrefixTable:
    """Encodes and decodes like the library the model is from."""

    def __init__(self, model: dict) -> None:
        import ahocorasick

        pieces, types = model["pieces"], model["types"]
        self.ids = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t == 1}
        # Equal scores are equal ranks: of those, what lies further left is merged first.
        self.rank = {p: -model["scores"][i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types)) if t == 6}
        self.chars = {p for p in self.ids if len(p) == 1}
        # Neighbours that stand together in no piece are never merged across.
        self.together = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.splits_at_space = not any(a != SPACE and b == SPACE for a, b in self.together)
        self.ends: dict[str, tuple] = {}
        automaton = ahocorasick.Automaton()
        for piece in self.ids:
            grown = edges(piece, self.rank)
            if grown:
                self.ends[piece] = grown
                automaton.add_word(piece, piece)
        automaton.make_automaton()
        self.automaton = automaton
        self.fits: dict[tuple, bool] = {}
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.begin, self.end = (int(model[k]).to_bytes(4, "little") for k in ("begin", "end"))
        self.surface = [
            b"" if t == 3 else model["unknown"].encode() if t == 2 else bytes([int(p[3:5], 16)]) if t == 6
            else p.replace(SPACE, " ").encode() for p, t in zip(pieces, types)]
        self.types = types

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay apart when their joined characters are merged."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            right, left = self.ends[a][0], self.ends[b][1]
            i = j = 0
            known = True
            while True:
                (x, until_x), (y, until_y) = right[i], left[j]
                across = self.rank.get(x + y, NEVER)
                if across < until_x and across <= until_y:
                    known = False
                    break
                if until_x == NEVER and until_y == NEVER:
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            self.fits[key] = known
        return known

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch of known characters, by the table of prefixes."""
        known = self.stretches.get(text)
        if known is not None:
            return known
        last: list = [None] * (len(text) + 1)
        for at, piece in self.automaton.iter(text):
            end = at + 1
            if last[end] is None:
                start = end - len(piece)
                if start == 0 or (last[start] is not None and self.compatible(last[start], piece)):
                    last[end] = piece
        out, end = [], len(text)
        while end:
            piece = last[end]
            out.append(self.ids[piece].to_bytes(4, "little"))
            end -= len(piece)
        ids = b"".join(reversed(out))
        if len(text) <= 32:
            if len(self.stretches) >= REMEMBERED:
                self.stretches.clear()
            self.stretches[text] = ids
        return ids

    def word(self, text: str) -> bytes:
        """Ids of any text: cut where nothing merges across; a character no piece has becomes its bytes."""
        known = self.words.get(text)
        if known is not None:
            return known
        out, start, n = [], 0, len(text)
        while start < n:
            if text[start] not in self.chars:
                out.extend(self.bytes[b].to_bytes(4, "little") for b in text[start].encode("utf-8", "surrogatepass"))
                start += 1
                continue
            end = start + 1
            while end < n and text[end - 1:end + 1] in self.together:
                end += 1
            out.append(self.stretch(text[start:end]))
            start = end
        ids = b"".join(out)
        if n <= 64:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers, with begin and end."""
        if not text:
            return self.begin + self.end
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.splits_at_space:
            parts = [SPACE + text.replace(" ", SPACE)]
        elif "  " in text or text[0] == " ":
            parts = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        else:
            parts = [SPACE + w for w in text.split(" ")]
        get, word = self.words.get, self.word
        return b"".join([self.begin, *[get(p) or word(p) for p in parts], self.end])

    def decode(self, ids: bytes) -> str:
        """The library's text for ids: control ids are nothing, the dummy blank goes, bad bytes become U+FFFD one by one."""
        import numpy as np

        numbers = np.frombuffer(ids, "<u4").tolist()
        joined = b"".join(map(self.surface.__getitem__, numbers))
        first = next((i for i in numbers if self.types[i] != 3), None)
        if first is not None and self.types[first] == 1 and joined[:1] == b" ":
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return "".join(c if not 0xDC80 <= ord(c) <= 0xDCFF else "�" for c in joined.decode("utf-8", "surrogateescape"))


def table_of(model: dict) -> PrefixTable:
    memo = process_memo("prefix_table")
    return memo.get(model["digest"]) or memo.setdefault(model["digest"], PrefixTable(model))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids BINARY of little-endian unsigned 32-bit integers, decoded STRING), one row per row.

    * null text: the empty text (begin and end only); null id: a row with a null id
    * repeated rows: one row each; empty table: no rows; other columns are not looked at
    * very long texts are taken whole; runs of blanks, unknown characters and special strings as the library does
    """
    model = read_model(model_path)
    rows = ids_and_texts(docs, id_col, text_col)

    def run(batches):
        table = table_of(model)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for start in range(0, batch.num_rows, 256):
                coded = [table.encode(t) for t in texts[start:start + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids[start:start + 256], pa.array(coded, pa.binary()), pa.array([table.decode(c) for c in coded], pa.string())],
                    ["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids BINARY, decoded STRING").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return encoded.select(
        id_col, F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
