"""Token ids of texts by a public byte-level BPE file, with a cache of stretches.

Byte-level BPE never merges across the boundary before a single space that
stands between two other non-space characters, nor between ASCII letters, digits
and signs (an apostrophe may begin a contraction), so a text's ids are those of
such stretches in a row. Stretches repeat: each batch of texts is cut into them
as one byte buffer, Arrow numbers the distinct ones, and only those are looked
up, or given to the tokenizers library when they are new.

Texts that could hold a special token's string go to the library whole, and so
do all texts where the file is no plain byte-level BPE (a normalizer, a space
put first, a split of its own).
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lumenreel.llm.common import trim

END_ID = 2
#: Bytes of text that are cut and numbered together.
CHUNK = 4 << 20
_SIMPLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)\Z|\n\Z")
_loaded: dict[str, "Encoder"] = {}

# Bytes beside which a text may be cut: visible ASCII; letters of two bytes but for U+0080 to U+00BF; of three or four bytes but
# for those beginning with E1, E2 and E3, where Unicode has its other white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_OPENS = _VISIBLE.copy()
_OPENS[0xC3:0xF5] = True
_OPENS[0xE1:0xE4] = False
#: Letters, digits and signs as classes; between two of them there is a boundary, but not behind an apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 4
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_TWO, _THREE, _INNER, _SPACE = (np.zeros(256, bool) for _ in range(4))
_TWO[0xC3:0xE0], _THREE[0xE4:0xF5], _INNER[0x80:0xC0], _SPACE[[9, 10, 11, 12, 13, 32]] = True, True, True, True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def is_plain(path: str) -> bool:
    """Whether the file is a byte-level BPE whose pre-tokens are those of the usual pattern, and nothing else."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    extra = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    return bool(usual and spec.get("normalizer") is None and model.get("type") == "BPE" and not any(extra))


def cuts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where stretches start: those of the texts, white space behind visible characters, what stands behind a line feed or tab alone, changes of class."""
    kind, at = _CLASS[b], np.flatnonzero(b[:-1] == 0xC3)
    at = at[(b[at + 1] & 0xDF) != 0x97]  # letters of U+00C0 to U+00FF, so without the two signs of arithmetic
    kind[at] = kind[at + 1] = 1
    inner = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (b[:-1] != 0x27)) + 1
    space = np.flatnonzero(_SPACE[b])
    space = space[space > 2]
    one, two, three = b[space - 1], b[space - 2], b[space - 3]
    before = space[_VISIBLE[one] | (_INNER[one] & (_TWO[two] | (_INNER[two] & _THREE[three])))]
    single = before[(before < len(b) - 1) & (b[before] != 0x20)]
    behind = single[_OPENS[b[single + 1]]] + 1
    both = np.concatenate([starts, before, behind, inner])
    both.sort()
    return both[np.flatnonzero(np.diff(both, prepend=-1))]


class Encoder:
    #: Entries of each of two cache generations; the older one is let go when the newer one is full.
    CACHE = 400_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.plain = Tokenizer.from_file(path), is_plain(path)
        self.model, self.pre = self.lib.model, self.lib.pre_tokenizer
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in special) or rb"(?!)")
        #: The model's letter of each byte.
        self.letters = {b: self._letter(b) for b in range(256)}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _letter(b: int) -> str:
        """Byte-level BPE shows printable Latin-1 bytes as themselves, the rest as letters from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(b) if b in shown else chr(0x100 + [x for x in range(256) if x not in shown].index(b))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return self.of_array(pa.array(texts, pa.large_string()))

    def of_array(self, texts: pa.Array) -> Iterator[bytes]:
        """The same of an Arrow column of texts without nulls."""
        wide = texts.cast(pa.large_binary())
        _, ends, data = wide.buffers()
        ends = np.frombuffer(ends, np.int64)[wide.offset : wide.offset + len(wide) + 1]
        b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(wide):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
            yield from self._chunk(b[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            lo = hi

    def _whole(self, raw: bytes) -> bytes:
        return array("I", self.lib.encode(raw.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()

    def _chunk(self, b: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        raw = b.tobytes()
        if not self.plain:
            yield from (self._whole(raw[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            return
        whole = {int(np.searchsorted(ends, m.start(), "right")) - 1 for m in self.special.finditer(raw)}
        starts = cuts(b, ends[:-1][np.diff(ends) > 0])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(b)).astype(np.int64)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        _, at, data = coded.dictionary.buffers()
        at, data = np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data is not None else b""
        ids = self._lookup([data[s:e] for s, e in zip(at[:-1], at[1:], strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        which = coded.indices.to_numpy()
        many = sizes[which]
        done = np.concatenate([[0], np.cumsum(many)])
        where = np.repeat(at[which] - done[:-1], many)
        where += np.arange(done[-1])
        out = flat[where].tobytes()
        edges = (4 * done[np.searchsorted(starts, ends)]).tolist()
        for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            yield self._whole(raw[ends[k] : ends[k + 1]]) if k in whole else out[s:e]

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.new) > self.CACHE:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self._add(pieces[i])
        return found

    def _add(self, piece: bytes) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if _SIMPLE.match(piece):  # one pre-token
                tokens = self.model.tokenize(piece.decode("latin-1").translate(self.letters))
            else:
                tokens = [t for p, _ in self.pre.pre_tokenize_str(piece.decode("utf-8", "surrogatepass")) for t in self.model.tokenize(p)]
            found = array("I", [t.id for t in tokens]).tobytes()
        if len(piece) <= 64:
            self.new[piece] = found
        return found


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def bytes_of_ids(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level BPE stands for."""
    encode = encoder(path)
    byte_of, vocabulary = {letter: b for b, letter in encode.letters.items()}, encode.lib.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for letters, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in letters) if all(c in byte_of for c in letters) else letters.encode()
    return out


def encode_batches(batches, tokenizer: str, end_id: int):
    """(doc_ids, ids per document with the end id), some documents at a time; batches are taken together up to a chunk's bytes."""
    encode, end, held, size = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), [], 0

    def encoded():
        ids = [i for b in held for i in b.column(b.schema.get_field_index("doc_id")).to_pylist()]
        found = encode.of_array(pa.concat_arrays([b.column(b.schema.get_field_index("text")).cast(pa.large_string()) for b in held]))
        held.clear()
        for at in range(0, len(ids), 256):
            some = ids[at : at + 256]
            yield some, [next(found) + end for _ in some]

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield from encoded()
            size = 0
    if held:
        yield from encoded()
    trim()


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
