"""SentencePiece BPE encoding with byte offsets, and decoding.

The normaliser walks the text by longest prefix through the model's compiled character map (a double-array trie) and
records, for each byte it writes, the byte of the text it came from. Each piece is then projected through that record to
the span of original bytes it stands for. Text is cut where no piece of the vocabulary can reach across (before a word
mark that follows something else, around line feeds, before some punctuation), so a unit's pieces depend on the unit alone and
are kept in two bounded tables per Python worker: a full one becomes the older, whose units move back when they are met again.

Cases: null and empty texts give no ids; invalid rows cannot occur (Spark strings are UTF-8); repeated rows give repeated
results, rows with one doc_id or none are rows of their own; very long texts are taken whole, and units beyond 64 characters
are merged anew each time; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
import re
import string
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.llm.common import released, unified

MARK = "▁"
#: spans_sha256: of (first byte, end byte) of each id in the original text, as pairs of little-endian 64-bit numbers.
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, spans_sha256 string, decoded_sha256 string"
#: Kept results per worker; at this many the table becomes the older one.
CACHE_UNITS = 200_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of each field of one protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


def _starts(text: str) -> np.ndarray:
    """First byte of each character, and the number of bytes."""
    raw = text.encode()
    if len(raw) == len(text):
        return np.arange(len(raw) + 1)
    return np.append(np.flatnonzero(np.frombuffer(raw, np.int8) >= -64), len(raw))


class CharacterMap:
    """Compiled normalisation rules: a double-array trie over bytes and the replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]
        #: Bytes with which some rule begins.
        self.begins = np.array([self._begins(b) for b in range(256)])

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        node = self._offset(self.units[0]) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that fits at this byte, and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        node ^= self._offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i - at + 1, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class PieceModel:
    """A SentencePiece BPE model with byte fallback, read from its file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        rules, self.dummy, self.squeeze, self.escape, kind, fallback = b"", True, True, True, 1, False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
                kind, fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
                if trainer.get(24, 0):
                    raise ValueError("models with the word mark as a suffix are not supported")
            elif number == 3:
                norm = dict(_fields(value))
                rules = norm.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
        if kind != 2 or not fallback or 4 in self.kinds or 5 in self.kinds:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are supported")
        self.map = CharacterMap(rules)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unit = re.compile(self._unit_pattern())
        self.names = {p: str(i) for p, i in self.ids.items()}
        if max(map(len, self.pieces), default=0) > 255:
            raise ValueError("pieces of over 255 characters are not supported")
        self.cache: dict[str, tuple[int, str, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, str, bytes]] = {}

    def _unit_pattern(self) -> str:
        """Cuts where no piece can reach across: before a word mark, around a line feed, and between a letter or digit and
        punctuation that no piece has after one, or only after a few others (".": after "²")."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return "(?s).+"
        if any("\n" in p and len(p) > 1 for p in self.ids):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        after = {p[i - 1 : i + 1] for p in self.ids for i in range(1, len(p)) if p[i - 1].isalnum()}
        before = {c: sorted(x[0] for x in after if x[1] == c) for c in string.punctuation}
        cut = re.escape("".join(c for c in sorted(before) if len(before[c]) <= 8))
        joined = "".join(f"|(?<=[{''.join(before[c])}]){re.escape(c)}" for c in sorted(before) if 0 < len(before[c]) <= 8)
        if not cut:
            return f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        return rf"{MARK}*[^{MARK}\n](?:[^{MARK}\n{cut}]|(?<![^\W_])[{cut}]{joined})*|{MARK}+|\n"

    # -- normalising -------------------------------------------------------------------------------------------------
    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the byte of the text it came from."""
        raw = text.encode()
        space = MARK.encode() if self.escape else b" "
        parts: list[tuple[bytes, int, int]] = []
        i = 0
        while i < len(raw):
            rule = self.map.longest(raw, i)
            if rule is None:
                lead = raw[i]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                rule = size, raw[i : i + size]
            parts.append((rule[1], i, i + rule[0]))
            i += rule[0]
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
            while parts and parts[-1][0] == b" ":
                parts.pop()
        if not parts:
            return "", [0]
        out, origin, last_space = bytearray(), [], self.squeeze
        if self.dummy:
            out += space
            origin += [parts[0][1]] * len(space)
        for new, start, _ in parts:
            if self.squeeze:
                while last_space and new.startswith(b" "):
                    new = new[1:]
            if not new:
                continue
            put = new.replace(b" ", space)
            out += put
            origin += [start] * len(put)
            last_space = self.squeeze and new.endswith(b" ")
        origin.append(parts[-1][2])
        return out.decode(), origin

    def origins(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of the text it came from.

        The map is walked where a rule can begin; what lies between is copied in one stretch.
        """
        if self.squeeze or not self.escape:
            normal, origin = self.normalise(text)
            return normal, np.array(origin)[_starts(normal)]
        raw, own = text.encode(), _starts(text)
        parts, origin, at = [MARK if self.dummy and text else ""], [own[:1] if self.dummy and text else own[:0]], 0
        for i in np.flatnonzero(self.map.begins[np.frombuffer(raw, np.uint8)]).tolist():
            rule = self.map.longest(raw, i) if i >= at and raw[i] & 0xC0 != 0x80 else None
            if rule is not None:
                new = rule[1].decode()
                parts += [raw[at:i].decode(), new]
                origin += [own[np.searchsorted(own, at) : np.searchsorted(own, i)], np.full(len(new), i)]
                at = i + rule[0]
        parts.append(raw[at:].decode())
        origin.append(own[np.searchsorted(own, at) :])
        return "".join(parts).replace(" ", MARK), np.concatenate(origin)

    # -- merging -----------------------------------------------------------------------------------------------------
    def merge(self, unit: str) -> list[str]:
        """Pieces of a unit: always the pair with the best score, the leftmost of equals, until none is in the vocabulary."""
        return self._merge_long(unit) if len(unit) > 40 else self._merge_short(unit)

    def _merge_short(self, unit: str) -> list[str]:
        """Costs of all neighbouring pairs in a list: quick for words."""
        cost = self.cost.get
        none = math.inf
        parts = list(unit)
        pairs = [cost(a + b, none) for a, b in itertools.pairwise(unit)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            joined = parts[i] + parts.pop(i + 1)
            parts[i] = joined
            del pairs[i]
            if i < len(pairs):
                pairs[i] = cost(joined + parts[i + 1], none)
            if i:
                pairs[i - 1] = cost(parts[i - 1] + joined, none)
        return parts

    def _merge_long(self, unit: str) -> list[str]:
        """The same with a heap, for units of any length."""
        ids, scores = self.ids, self.scores
        parts = list(unit)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            joined = parts[a] + parts[b]
            k = ids.get(joined)
            if k is not None:
                heapq.heappush(heap, (-scores[k], a, b, joined))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not parts[a] or not parts[b] or right[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [p for p in parts if p]

    def ids_of(self, piece: str) -> list[int]:
        k = self.ids.get(piece)
        return [k] if k is not None else [self.byte_ids[b] for b in piece.encode()]

    def units(self, text: str) -> list[str]:
        return self.unit.findall(self.origins(text)[0])

    def encode(self, text: str | None) -> list[int]:
        return [k for u in self.units(text or "") for p in self.merge(u) for k in self.ids_of(p)]

    def encode_with_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each piece in the original text's UTF-8 bytes; bytes of one character share its span."""
        normal, origin = self.normalise(text or "")
        out, at = [], 0
        for unit in self.unit.findall(normal):
            for piece in self.merge(unit):
                end = at + len(piece.encode())
                out += [(k, origin[at], origin[end]) for k in self.ids_of(piece)]
                at = end
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: word marks become spaces, byte pieces are joined, bytes that form no character become U+FFFD."""
        out, held = [], bytearray()
        for k in [*ids, -1]:
            if k in self.bytes_of:
                held.append(self.bytes_of[k])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if k >= 0 and self.kinds[k] != 3:
                out.append(self.pieces[k])
        if out and (self.dummy or self.squeeze) and ids and ids[0] not in self.bytes_of and out[0].startswith(MARK):
            out[0] = out[0][1:]
        return "".join(out).replace(MARK, " ")

    def digest(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, hash of the ids, hash of their spans in the text, hash of the text decoded from them."""
        normal, origin = self.origins(text or "")
        rows, kept = [], self.cache.get
        for unit in self.unit.findall(normal):
            row = kept(unit)
            if row is None:
                row, kept = self._known(unit), self.cache.get  # a full table has been replaced
            rows.append(row)
        if not rows:
            return (0, *[hashlib.sha256(b"").hexdigest()] * 3)
        sizes, ids, texts, steps = zip(*rows, strict=True)
        step = np.frombuffer(b"".join(steps), np.uint8)
        end = np.cumsum(step, dtype=np.int64)
        at = np.empty((len(step), 2), np.int64)
        at[:, 0] = end - step
        at[:, 1] = at[:, 0] + np.maximum(step, 1)
        spans = hashlib.sha256(origin[at].astype("<i8", copy=False).tobytes()).hexdigest()
        text_out = "".join(texts)
        if (self.dummy or self.squeeze) and text_out[:1] == " ":
            text_out = text_out[1:]
        return sum(sizes), hashlib.sha256(",".join(ids).encode()).hexdigest(), spans, hashlib.sha256(text_out.encode()).hexdigest()

    def _known(self, unit: str) -> tuple[int, str, str, bytes]:
        """The unit's row from the tables, or a new one."""
        row = self.older.get(unit) or self._unit_digest(unit)
        if len(unit) <= 64:
            if len(self.cache) >= CACHE_UNITS:
                self.older, self.cache = self.cache, {}
            self.cache[unit] = row
        return row

    def _unit_digest(self, unit: str) -> tuple[int, str, str, bytes]:
        """Number of ids, the ids joined by commas, their text with spaces for word marks, and the characters that each id
        takes: 0 for a byte that others of its character follow, which has the span of that character."""
        pieces = self.merge(unit)
        names = list(map(self.names.get, pieces))
        if None not in names:
            return len(names), ",".join(names), "".join(pieces).replace(MARK, " "), bytes(map(len, pieces))
        ids, steps = [], []
        for p in pieces:
            own = self.ids_of(p)
            ids += own
            steps += [0] * (len(own) - 1) + [len(p)]
        # a leading byte piece protects the mark that decode() would drop at the start of a text
        out = self.decode([next(iter(self.bytes_of)), *ids])[1:]
        return len(ids), ",".join(map(str, ids)), out, bytes(steps)

    def forget(self) -> None:
        """Empty tables: a worker waits for its next task without them."""
        self.cache, self.older = {}, {}


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids and byte spans of every whole text: doc_id, ids, starts, ends. path names a file present on every executor."""
    path = path or model_path()

    def run(batches):
        model = load(path)
        for pdf in batches:
            rows = [model.encode_with_spans(t if isinstance(t, str) else None) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [[r[0] for r in x] for x in rows], "starts": [[r[1] for r in x] for x in rows], "ends": [[r[2] for r in x] for x in rows]})

    return unified(docs).mapInPandas(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids."""
    path = path or model_path()

    def run(batches):
        model = load(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [model.decode(list(x) if x is not None else []) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids, of their byte spans and of the round trip of every whole text."""
    path = path or model_path()

    def run(batches):
        model = load(path)
        for pdf in batches:
            rows = [model.digest(t if isinstance(t, str) else None) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "spans_sha256": [r[2] for r in rows], "decoded_sha256": [r[3] for r in rows]})
        model.forget()

    return unified(docs).mapInPandas(released(run), SCHEMA)
