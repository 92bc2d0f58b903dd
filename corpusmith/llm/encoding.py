"""Library encoding with a cache of words: text is cut where the tokenizer itself always cuts.

Both pre-tokenizers of the supported files never join a white-space boundary: a piece is
one optional space with what follows it up to the next white space, or a run of white
space. So each piece is encoded once per worker and remembered; the ids of a text are the
pieces' ids in order. The cache is bounded by entries and bytes and emptied when full. Texts
come in chunks of a bounded size; a longer text is cut where the tokenizer cuts.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS = "\t-\r \x85\xa0  -     　"  # White_Space
PIECE = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
SPLIT_WORD = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?]*)$"
LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?]+")
SAFE_CUT = re.compile(rf"(?<=[^{WS}]) (?=[^{WS}])")
MAX_ENTRIES, MAX_BYTES = 500_000, 64 << 20
CHUNK_BYTES = 6 << 20


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file on this machine; folder overrides the installed package's."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(texts, whether they go on with the text before), each chunk of about limit bytes at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held + size > limit and k > begin:
            yield texts.slice(begin, k - begin), False
            begin, held = k, 0
        held += size
        if size > limit:
            text, at = texts[k].as_py(), 0
            while at < len(text):
                m = SAFE_CUT.search(text, at + limit)
                end = m.start() if m else len(text)
                yield pa.array([text[at:end]]), at > 0
                at = end
            begin, held = k + 1, 0
    if begin < len(texts):
        yield texts.slice(begin), False


class CachedEncoder:
    """ids(text) as Tokenizer.encode(text, add_special_tokens=False).ids, as little-endian uint32 bytes."""

    def __init__(self, name: str, folder: str | None = None, max_entries: int = MAX_ENTRIES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name, folder))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.lower = self.tok.normalizer is not None  # the word-level file folds case and drops white space
        self.max_entries = max_entries
        self.to_chars = {b: c for b, c in byte_chars().items()}
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.odd = "^$|" + "|".join([rf"[{WS}\x1c-\x1f]", *(re.escape(x).replace("<", r"\x{3c}").replace(">", r"\x{3e}") for x in special)])
        self._forget()

    def _library(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, s: str) -> bytes:
        """ids of one pre-token, straight from the library's model."""
        if self.lower:
            s = s.lstrip(" ").lower()
        chars = s.replace(" ", "\u0120") if s.isascii() else "".join(map(self.to_chars.__getitem__, s.encode()))
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def ids(self, text: str) -> bytes:
        """ids of one text, as encode gives them."""
        return self.encode(pa.array([text]))[0].astype("<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts in order (uint32), and the number of each text's ids.

        Texts are split and their distinct words counted in Arrow; Python sees each distinct word
        of a chunk once, and the ids are gathered in numpy. A text with other white space than
        single spaces and line feeds between words, or with special tokens, is cut into pieces by
        a regular expression instead; its pieces are looked up in the same way.
        """
        flats, counts = [], []
        for chunk, joins in _chunks(texts):
            flat, n = self._encode_chunk(chunk)
            if joins:  # a part of a long text: its count belongs to the text before
                counts[-1][-1] += n[0]
            else:
                counts.append(n)
            flats.append(flat)
        if not flats:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(flats), np.concatenate(counts)

    def _encode_chunk(self, chunk: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(chunk, "\n", " \n "), " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        words = parts.flatten().dictionary_encode()
        names, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        feed = pc.index(names, "\n").as_py()
        keys = 2 * codes  # one more for a word that begins a line
        if not self.lower:
            bare = np.zeros(len(codes), bool)
            bare[ends[:-1][ends[:-1] < ends[1:]]] = True
            bare[1:] |= codes[:-1] == feed
            keys += bare
        used = np.zeros(2 * len(names), bool)
        used[keys] = True

        # Most words are letters with marks after them: these are looked up apart.
        split = pc.extract_regex(names, SPLIT_WORD)
        letters, marks = (pc.struct_field(split, k) for k in (0, 1))
        body = pc.coalesce(pc.utf8_lower(letters) if self.lower else letters, names)
        odd = pc.match_substring_regex(names, self.odd).to_numpy(zero_copy_only=False)
        if feed >= 0:
            odd[feed] = False
        spaced, bare = used[::2].copy(), used[1::2].copy()
        for x in (spaced, bare):
            x &= ~odd
            if feed >= 0:
                x[feed] = False
        first, second = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        heads = pc.filter(body, pa.array(spaced))
        heads = heads if self.lower else pc.binary_join_element_wise(" ", heads, "")
        some = pa.concat_arrays([heads, pc.filter(body, pa.array(bare)), pc.fill_null(marks, ""), pa.array(["\n"])])
        places = self._places(some)
        first[::2][spaced] = places[: len(heads)]
        first[1::2][bare] = places[len(heads) : len(some) - len(names) - 1]
        second[::2] = second[1::2] = places[len(some) - len(names) - 1 : -1]
        if feed >= 0:
            first[2 * feed : 2 * feed + 2], second[2 * feed : 2 * feed + 2] = places[-1], 0
        strange = np.repeat(odd, 2)
        first[strange] = second[strange] = 0

        flat, sizes = _gather(self.pool, self.sizes, np.stack([first, second], 1).ravel())
        flat, each = _gather(flat, sizes.reshape(-1, 2).sum(axis=1), keys)
        cum = np.concatenate([[0], np.cumsum(each)])
        counts = cum[ends[1:]] - cum[ends[:-1]]
        if odd.any() and not self._blank_only(names, odd):
            hits = np.concatenate([[0], np.cumsum(strange[keys])])
            whole = np.flatnonzero(hits[ends[1:]] > hits[ends[:-1]])
            read, n = self._whole_texts(chunk.take(pa.array(whole)).to_pylist())
            parts, at, done = [], 0, 0
            for d, size in zip(whole.tolist(), n.tolist(), strict=True):
                parts += [flat[at : cum[ends[d]]], read[done : done + size]]
                at, done = cum[ends[d + 1]], done + size
            flat = np.concatenate([*parts, flat[at:]])
            counts[whole] = n
        return flat, counts

    def _whole_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and their numbers of texts of any kind: cut into pieces here, looked up like others."""
        pieces, sizes = [], []
        for text in texts:
            before = len(pieces)
            for k, part in enumerate(self.special.split(text)):
                pieces += [part] if k % 2 else PIECE.findall(part)
            sizes.append(len(pieces) - before)
        places = self._places(pa.array(pieces, pa.string()))
        flat, each = _gather(self.pool, self.sizes, places)
        cum = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(sizes)
        return flat, cum[ends] - cum[ends - sizes]

    def _blank_only(self, names: pa.Array, odd: np.ndarray) -> bool:
        """Whether empty words alone are odd and mean nothing."""
        return self.lower and names.filter(pa.array(odd)).to_pylist() == [""]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Place of each piece's ids in the pool; new pieces are encoded and put there."""
        pieces = pieces.dictionary_encode()
        names = pieces.dictionary
        if len(self.keys) > self.max_entries or self.keys.nbytes + self.pool.nbytes > MAX_BYTES:
            self._forget()
        at = pc.index_in(names, value_set=self.keys)
        new = names.filter(at.is_null())
        if len(new):
            begin = len(self.keys)
            blobs = [self._letters(x) if LETTERS.fullmatch(x) else self._library(x) for x in new.to_pylist()]
            self.keys = pa.concat_arrays([self.keys, new])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(blobs), "<u4")])
            found = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            found[found < 0] = begin + np.arange(len(new))
        else:
            found = at.to_numpy(zero_copy_only=False).astype(np.int64)
        return found[pieces.indices.to_numpy()]

    def _forget(self) -> None:
        """Empty the cache of pieces but for the empty one at place 0."""
        self.keys, self.sizes, self.pool = pa.array([""]), np.zeros(1, np.int64), np.empty(0, "<u4")


def _gather(pool: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool (of these sizes, one after another) at places, in their order, and their sizes."""
    each = sizes[places]
    cum = np.cumsum(each)
    shift = (np.cumsum(sizes) - sizes)[places] - (cum - each)
    return pool[np.repeat(shift, each) + np.arange(cum[-1] if len(cum) else 0)], each


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(name: str, folder: str | None = None) -> CachedEncoder:
    """One per worker process."""
    key = (name, folder)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(name, folder)
    return _ENCODERS[key]


def crc(data: bytes) -> int:
    return zlib.crc32(data)
