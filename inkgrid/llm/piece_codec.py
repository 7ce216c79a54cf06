"""SentencePiece encoding and decoding on an Aho-Corasick automaton.

The bytes of all pieces form one automaton. A text runs through it once; at each byte the output
links name every piece that ends there, longest first, and each relaxes the best score of that
place: best[end] = max(best[start] + score). The best path from the end gives the ids. A character
that no piece covers costs less than any piece (least score - 10) and is written as byte pieces, or
as the unknown id if the model has none. Equal scores keep the longer last piece.

The encoding is the one of greatest total score over the model's pieces. For a model trained by
merging (BPE) the scores are merge ranks, so the result can differ from replaying the merges;
decoding gives back the text either way. (A U+2581 in a text is the format's own sign for a blank and
comes back as one.)

No piece reaches from a visible character over a blank, and none holds a newline (checked when the
model is loaded), so the best path of a text is those of its chunks in order. Long chunks (scripts
without blanks, base64) are cut again before every character at which the automaton falls back to that
character alone: no piece crosses such a place. Distinct chunks are solved together, position by
position, as matrix rows, and remembered; what has no place to cut for over 256 bytes is solved by
the same recurrence on its own, in time linear in its length. Null text is an empty text, which has no
ids, and an empty table an empty table. Repeated rows, and rows with a null doc_id, are each encoded for
themselves. A kept column with the name of the outcome gives way to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import memory
from .common import apart_from, table, text_or_empty, vocabulary_path
from .encoding import ChunkMemory
from .memory import task

BLANK = "▁"
_PIECES_IN = re.compile(r"\n| +[^ \n]*|[^ \n]+")


class Automaton:
    """Dense byte automaton: ``step[state, byte]``, ``piece`` of a state or -1, ``link`` to the next state with a piece (0: none)."""

    def __init__(self, pieces: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for text, i in pieces.items():
            at = 0
            for byte in text:
                nxt = children[at].get(byte)
                if nxt is None:
                    nxt = len(children)
                    children[at][byte] = nxt
                    children.append({})
                    depth.append(depth[at] + 1)
                at = nxt
            ends[at] = i
        n = len(children)
        self.depth = np.array(depth)
        self.step = np.zeros((n, 256), np.int32)
        self.piece = np.full(n, -1, np.int32)
        self.link = np.zeros(n, np.int32)
        self.piece[list(ends)] = list(ends.values())
        fail = np.zeros(n, np.int32)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, child in children[parent].items():
                    below.append((parent, byte, child))
            if below:
                p, b, c = (np.array(x) for x in zip(*below, strict=True))
                # a child fails to where its parent's failure goes; the root's children fail to the root
                fail[c] = np.where(p == 0, 0, self.step[fail[p], b]) if level != [0] else 0
            rows = np.array(level)
            if level != [0]:
                self.step[rows] = self.step[fail[rows]]
            if below:
                self.step[p, b] = c
                self.link[c] = np.where(self.piece[fail[c]] >= 0, fail[c], self.link[fail[c]])
            level = [child for _, _, child in below]


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = SentencePieceProcessor(model_file=path)
        proto = messages.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, with blanks kept before words, are read")
        self.dummy = spec.add_dummy_prefix
        n = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(n)])
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in usual}
        if any("\n" in x or re.search(f"[^{BLANK}]{BLANK}", x) for x in names.values()):
            raise ValueError("a piece reaches over a blank or a newline")
        self.automaton = Automaton({x.encode(): i for i, x in names.items()})
        self.lengths = np.array([len(names[i].encode()) if i in names else 1 for i in range(n)], np.int64)
        self.unknown = float(self.scores[usual].min()) - 10
        self.unknown_id = model.unk_id()
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.plain: list[bytes] = [b""] * n
        for i, x in names.items():
            self.plain[i] = x.replace(BLANK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.plain[i] = bytes([byte])
        self.memory = ChunkMemory(self._solve)
        # plain numbers for walks byte by byte
        self._depth, self._piece, self._link = (x.tolist() for x in (self.automaton.depth, self.automaton.piece, self.automaton.link))
        self._length, self._score = self.lengths.tolist(), self.scores.tolist()
        self._step = memoryview(self.automaton.step.reshape(-1))
        self.newline = np.uint32(self.byte_ids.get(10, self.unknown_id)).tobytes()

    # -- encoding

    def viterbi(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk (bytes with blanks escaped); rows of one matrix, a column a step."""
        n = len(chunks)
        sizes = np.array([len(c) for c in chunks])
        width = int(sizes.max(initial=0))
        if not width:
            return [np.empty(0, np.uint32)] * n
        order = np.argsort(-sizes, kind="stable")
        text = np.zeros((n, width), np.uint8)
        for row, k in enumerate(order.tolist()):
            text[row, : sizes[k]] = np.frombuffer(chunks[k], np.uint8)
        long = sizes[order]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.full((n, width + 1), -1, np.int64)
        state = np.zeros(n, np.int64)
        starts = np.zeros(n, np.int64)
        auto = self.automaton
        for at in range(width):
            live = int(np.searchsorted(-long, -at, side="left"))  # rows longer than at
            byte = text[:live, at]
            starts[:live] = np.where((byte & 0xC0) != 0x80, at, starts[:live])
            state[:live] = auto.step[state[:live], byte]
            node = np.where(auto.piece[state[:live]] >= 0, state[:live], auto.link[state[:live]])
            rows = np.flatnonzero(node)
            node = node[rows]
            while len(rows):
                piece = auto.piece[node]
                score = best[rows, at + 1 - self.lengths[piece]] + self.scores[piece]
                up = score > best[rows, at + 1]
                best[rows[up], at + 1] = score[up]
                back[rows[up], at + 1] = piece[up]
                node = auto.link[node]
                more = node > 0
                rows, node = rows[more], node[more]
            ends = np.ones(live, bool)
            if at + 1 < width:
                ends = ((text[:live, at + 1] & 0xC0) != 0x80) | (long[:live] == at + 1)
            r = np.flatnonzero(ends)
            score = best[r, starts[r]] + self.unknown
            up = score > best[r, at + 1]
            best[r[up], at + 1] = score[up]
            back[r[up], at + 1] = -2 - starts[r[up]]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * n
        place = long.copy()
        columns: list[np.ndarray] = []
        odd = set()
        while True:
            live = place > 0
            if not live.any():
                break
            step = np.where(live, back[np.arange(n), place], -1)
            odd.update(np.flatnonzero(step < -1).tolist())
            columns.append(step)
            place = np.where(step >= 0, place - self.lengths[np.maximum(step, 0)], np.where(step < -1, -2 - step, 0))
        steps = np.array(columns)[::-1].T
        kept = steps != -1
        counts = kept.sum(axis=1)
        flat = steps[kept]
        cuts = np.cumsum(counts)[:-1]
        for row, ids in enumerate(np.split(flat, cuts)):
            if row in odd:
                ids = self._with_bytes(ids, chunks[order[row]])
            out[order[row]] = ids.astype("<u4")
        return out

    def _with_bytes(self, steps: np.ndarray, chunk: bytes) -> np.ndarray:
        ids: list[int] = []
        for s in steps.tolist():
            if s >= 0:
                ids.append(s)
                continue
            first = -2 - s
            last = first + 1
            while last < len(chunk) and chunk[last] & 0xC0 == 0x80:
                last += 1
            ids += [self.byte_ids[b] for b in chunk[first:last]] if self.byte_ids else [self.unknown_id]
        return np.array(ids)

    def apart(self, data: bytes) -> list[bytes]:
        """The parts of a chunk between the places that no piece crosses."""
        step, depth = self._step, self._depth
        cuts, state, first = [0], 0, 0
        for at, byte in enumerate(data):
            state = step[state << 8 | byte]
            if byte & 0xC0 != 0x80:
                first = at
            if first > cuts[-1] and depth[state] <= at - first + 1 and (at + 1 == len(data) or data[at + 1] & 0xC0 != 0x80):
                cuts.append(first)
        return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]

    def path(self, data: bytes) -> np.ndarray:
        """What ``viterbi`` gives for one chunk, byte by byte."""
        step, piece, link, length, score = self._step, self._piece, self._link, self._length, self._score
        n, worst, unknown = len(data), float("-inf"), self.unknown
        best, back = [0.0] + [worst] * n, [-1] * (n + 1)
        state = start = 0
        for at in range(n):
            byte = data[at]
            if byte & 0xC0 != 0x80:
                start = at
            state = step[state << 8 | byte]
            node = state if piece[state] >= 0 else link[state]
            most, by = worst, -1
            while node:
                i = piece[node]
                found = best[at + 1 - length[i]] + score[i]
                if found > most:
                    most, by = found, i
                node = link[node]
            if (at + 1 == n or data[at + 1] & 0xC0 != 0x80) and best[start] + unknown > most:
                most, by = best[start] + unknown, -2 - start
            best[at + 1], back[at + 1] = most, by
        steps, at = [], n
        while at:
            steps.append(back[at])
            at = at - length[back[at]] if back[at] >= 0 else -2 - back[at]
        steps.reverse()
        return self._with_bytes(np.array(steps), data).astype("<u4")

    def _solve(self, chunks: list[str]) -> dict[str, bytes]:
        parts: list[bytes] = []
        ends = []
        for c in chunks:
            data = c.replace(" ", BLANK).encode()
            parts += [] if c == "\n" else self.apart(data) if len(data) > 64 else [data]
            ends.append(len(parts))
        found: dict[bytes, bytes] = {}
        ordered = sorted(set(parts), key=len)
        short = [x for x in ordered if len(x) <= 256]
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            found.update(zip(part, (ids.tobytes() for ids in self.viterbi(part)), strict=True))
        found.update((x, self.path(x).tobytes()) for x in ordered[len(short) :])
        return {c: self.newline if c == "\n" else b"".join(map(found.__getitem__, parts[a:b])) for c, a, b in zip(chunks, [0, *ends[:-1]], ends, strict=True)}

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if self.dummy:
            text = " " + text
        if "  " in text or "\x01" in text:
            return _PIECES_IN.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts as little-endian unsigned 32-bit bytes."""
        return self.memory.join([self.cut(t) for t in texts])

    # -- decoding

    def decode(self, ids: bytes | np.ndarray) -> str:
        values = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        data = b"".join(map(self.plain.__getitem__, values.tolist()))
        if self.dummy and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


memory.remembers("pieces", _codecs.clear)


def codec(path: str) -> PieceCodec:
    """One codec per worker process and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(documents: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int)."""
    keep = [c for c in keep if c != "ids"]
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = codec(model).encode_many(part.column(len(keep)).to_pylist())
                flat = np.frombuffer(b"".join(got), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in got]))), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=schema.names)

    return documents.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias(apart_from(keep))).mapInArrow(task("pieces")(run), schema)


def decode_documents(encoded: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``text``, from ``ids``."""
    keep = [c for c in keep if c not in ("text", "ids")]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(model).decode(ids.values.to_numpy(zero_copy_only=False)) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*[F.col(f"`{c}`") for c in keep], "ids").mapInArrow(task("pieces")(run), schema)


_DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])


def round_trips(documents: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text where it lies: n_pieces, ids_crc32, decoded_sha256, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("_text").to_pylist()
                got = codec(model).encode_many(texts)
                back = [codec(model).decode(ids) for ids in got]
                cols = [[len(x) // 4 for x in got], [zlib.crc32(x) for x in got], [hashlib.sha256(t.encode()).hexdigest() for t in back], [a == b for a, b in zip(texts, back, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3])], names=_DIGEST.names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(task("pieces")(run), _DIGEST)


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
