"""Byte-level BPE encoding and decoding with a public vocabulary, reusing content-defined chunks."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from sandpiper.llm.tokens import binary, parcels
from sandpiper.session import ship

#: Fixed: the pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space run and the run of other characters after it. A token never spans the place before such a unit.
UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII (or what some engines take for it): texts that have it are encoded in one piece.
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A place that is always between two tokens: ASCII white space after a printable ASCII character.
AGREED = re.compile(rb"(?<=[!-~])[ \t-\r]")
UNIT_MEMO = 300_000
LONG_UNIT = 200
CHUNK_MASK = (1 << 11) - 1
CHUNK_LEAST = 256
CHUNK_MEMO_BYTES = 48 << 20
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes as the vocabulary file's own tokenizer does, without special tokens added."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        for text in self.special:
            ranks.pop(text.encode(), None)
        self.engine = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        table = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        pieces = [table.get(i, b"") for i in range(max(table) + 1)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.units = _Units(self)
        self.chunks: dict[bytes, tuple[int, int, bytes]] = {}
        self.chunk_bytes = 0
        self.reused = 0

    def plain(self, text: str) -> bytes:
        return np.array(self.engine.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit numbers."""
        if self.split is not None and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._units(p) for p in self.split.split(text) if p)
        return self._units(text)

    def _units(self, text: str) -> bytes:
        if WIDE_SPACE.search(text):
            return self.plain(text)
        if len(self.units) > UNIT_MEMO:
            self.units.clear()
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))

    def encode_chunks(self, text: bytes, cuts: np.ndarray) -> bytes:
        """As encode(), chunk by chunk: a chunk met before is not encoded again.

        What lies between a chunk's first and last agreed place is encoded once. Around a join, the text from the last
        agreed place before it to the next one after it is encoded anew; where a chunk has none, the text grows on
        into the next. At both ends the tokens then agree with those of the text as a whole.
        """
        out, held = [], b""
        at = 0
        for end in [*cuts.tolist(), len(text)]:
            chunk = text[at:end]
            at = end
            known = self.chunks.get(chunk)
            if known is None:
                known = self._chunk(chunk)
            else:
                self.reused += 1
            head, tail, ids = known
            if head < 0:
                held += chunk
                continue
            if held or head:
                out.append(self.encode((held + chunk[:head]).decode()))
            out.append(ids)
            held = chunk[tail:]
        if held:
            out.append(self.encode(held.decode()))
        return b"".join(out)

    def _chunk(self, chunk: bytes) -> tuple[int, int, bytes]:
        first = AGREED.search(chunk, 1)
        if first is None:
            known = (-1, -1, b"")
        else:
            head = first.start()
            tail = head
            back = len(chunk)
            while back > head:
                back = max(chunk.rfind(b" ", head, back), chunk.rfind(b"\n", head, back), head)
                if AGREED.match(chunk, back):
                    tail = back
                    break
            known = (head, tail, self.encode(chunk[head:tail].decode()) if tail > head else b"")
        if self.chunk_bytes > CHUNK_MEMO_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[chunk] = known
        self.chunk_bytes += len(chunk) + len(known[2])
        return known

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; special tokens are kept, broken sequences become U+FFFD."""
        n = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.lengths[n]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(n) else 0
        raw = self.bytes[np.repeat(self.offsets[n] - (ends - size), size) + np.arange(total)].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


class _Units(dict):
    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, unit: str) -> bytes:
        ids = self.coder.plain(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = ids
        return ids


_coders: dict[int, Coder] = {}


def coder(vocabulary) -> Coder:
    """The coder of a broadcast vocabulary file, made once in each Python worker."""
    key = vocabulary.id if hasattr(vocabulary, "id") else hash(vocabulary)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(getattr(vocabulary, "value", vocabulary))
    return _coders[key]


def content_cuts(texts: list[bytes]) -> list[np.ndarray]:
    """Places where each text is cut: where a rolling hash of the 16 bytes before has 11 zero bits.

    The same passage is cut alike wherever it stands. Cuts are moved on to a character's start and kept 256 bytes apart.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    found = np.flatnonzero((h >> np.uint32(8)) & np.uint32(CHUNK_MASK) == 0) + 1
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    out, lo = [], 0
    spans = np.searchsorted(found, np.concatenate([[0], ends]), side="right")
    for d, text in enumerate(texts):
        cuts, last = [], 0
        for c in (found[spans[d] : spans[d + 1]] - lo).tolist():
            if c - last >= CHUNK_LEAST:
                while c < len(text) and text[c] & 0xC0 == 0x80:
                    c += 1
                if c < len(text):
                    cuts.append(c)
                    last = c
        out.append(np.array(cuts, np.int64))
        lo = int(ends[d])
    return out


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers), decoded (the text the ids stand for) for every document.

    path: a byte-level BPE file of the tokenizers library, read on the driver and broadcast (its size is the file's).
    A null text counts as empty and has no ids. Repeated rows are encoded each. No rows are shuffled; chunks are
    shared by all documents that a Python worker meets, within a bound of memory. Other columns are not read.
    """
    spark = ship(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        code = coder(vocabulary)
        for batch in parcels(batches):
            texts = binary(batch, "text")
            ids = [code.encode_chunks(t, c) for t, c in zip(texts, content_cuts(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(code.decode, ids), pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
