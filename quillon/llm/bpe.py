"""BPE encoding and decoding that reuses content-defined chunks.

A hash of the bytes before each white space cuts each text into chunks of some hundred bytes, so
that passages shared by documents give the same chunks wherever they stand. A task encodes a
chunk it has not met as whole words (runs between ASCII white space) and keeps the result;
the next document that holds the chunk takes it from there. Joining two chunks re-encodes the
words on either side of the cut together, and asks whether both come out as they were: ids and
decoded text of the two must be those of the parts. Where they do not agree, the whole text is
encoded anew at once, which is the library's own result. So chunk reuse never decides what the
ids are.

A word of Latin letters alone is one word to the vocabulary's split, and its letters are
normalised one by one; so it goes to the library's BPE model directly. All other words go through the
whole tokenizer.

Reuse is per task: chunks and words are kept in its worker, bounded in number and bytes
(two generations of at most ``KEPT_`` entries of at most ``LONGEST_`` bytes each), and are only
ever a saving; any task can be run again anywhere. A vocabulary that is not of the form for which words can
be encoded apart (``_apart``) is encoded text by text.

Defined results: a null text counts as empty; an empty or blank text has no tokens; a
special token spelled out in a text is that token, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.kernels import U, mix64, slices, text_buffers, trimmed

VOCABULARY = "word_bpe_49k.json"
#: Entries in a generation of kept words, and of kept chunks.
KEPT_WORDS, KEPT_CHUNKS = 30_000, 4_000
#: Bytes of a word, and of a chunk, that is kept.
LONGEST_WORD, LONGEST_CHUNK = 64, 1024
#: One white space in CUT_RATE is a cut, if the chunk has LEAST bytes by then; WINDOW bytes before it decide.
CUT_RATE, WINDOW, LEAST = 48, 16, 64
# Fixed value: the split of the vocabularies whose words can be encoded apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(rb"[ \t\n\r]+")
#: Between a word and the marks at its end the tokenizer always parts; so the two are looked up apart. The apostrophe is
#: no such mark, since the split reads on after it, nor is what special tokens are made of.
_PARTS = re.compile(rb"[ \t\n\r]+|(?=[.,;:!?#$%&*]+(?:[ \t\n\r]|$))(?:(?<=[a-z0-9])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))")
#: Letters that neither compose with one another nor change by what stands beside them.
LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(192, 256)) if c not in (215, 247)]
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class _Kept:
    """A bounded memo: entries of the last two generations."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.new, self.old = most, longest, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value) -> None:
        if len(key) > self.longest:
            return
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def _apart(tokenizer) -> tuple[bool, bool]:
    """(can the words between white space be encoded apart, is ASCII case ignored) of a tokenizer.

    They can if no step moves text across white space: normalizers that work within a word
    or on white space itself, a split that keeps the matches of a pattern that white space
    cannot match, and plain BPE with neither prefix, post-processor nor decoder; added
    tokens must be of the form <|name|>, which no run of letters or of marks holds.
    """
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or type(tokenizer.model).__name__ != "BPE":
        return False, False
    normal, split = (json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    normal, split = normal.get("normalizers", [normal]), split.get("pretokenizers", [split])
    spaces = [x for x in normal if x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "]
    plain = all(x in spaces or x["type"] in ("NFC", "Lowercase") for x in normal)
    cut = [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["invert"] and split[0]["behavior"] == "Removed"
    if not (plain and cut and split[0]["pattern"] == {"Regex": WORD_PATTERN} and not split[1]["add_prefix_space"] and not split[1]["use_regex"]):
        return False, False
    simple = not tokenizer.model.dropout and tokenizer.post_processor is None and tokenizer.decoder is None
    added = tokenizer.get_added_tokens_decoder().values()
    marked = all(re.fullmatch(r"<\|\w+\|>", t.content) and not t.lstrip and not t.rstrip for t in added)
    return simple and marked, any(x["type"] == "Lowercase" for x in normal)


class Codec:
    """Encoding and decoding of one vocabulary within a task.

    A piece is (number of tokens, decimal ids joined by spaces, decoded text), all of
    whole words; pieces join with a space.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()
        self.apart, self.caseless = _apart(self.tokenizer)
        if self.apart:
            self.model = self.tokenizer.model
            known = self.tokenizer.get_vocab(with_added_tokens=True)
            self.names, self.digits = [""] * (max(known.values()) + 1), list(map(str, range(max(known.values()) + 1)))
            for name, i in known.items():
                self.names[i] = name
            self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))[0][0] for c in LETTERS}
        self.met = self.reused = self.joins = self.disagreed = 0

    def forget(self) -> None:
        """Give up what was kept: the worker outlives the task."""
        self.words, self.chunks = _Kept(KEPT_WORDS, LONGEST_WORD), _Kept(KEPT_CHUNKS, LONGEST_CHUNK)

    def whole(self, text: str) -> tuple[int, str, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, str, str]]:
        found = list(map(self.words.new.get, words))
        if None not in found:
            return found
        other: dict[bytes, list[int]] = {}
        for at in [i for i, f in enumerate(found) if f is None]:
            w = words[at]
            piece = self.words.get(w)
            if piece is None:
                text = w.decode()
                if len(w) > LONGEST_WORD or not _LETTERS.fullmatch(text):
                    other.setdefault(w, []).append(at)
                    continue
                ids = [t.id for t in self.model.tokenize(text.translate(self.letters))]
                piece = (len(ids), " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids]))
                self.words.put(w, piece)
            found[at] = piece
        if other:
            for (w, places), e in zip(other.items(), self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
                ids = e.ids
                piece = (len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False))
                self.words.put(w, piece)
                for at in places:
                    found[at] = piece
        return found

    @staticmethod
    def joined(pieces: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        if not pieces:
            return 0, "", ""
        n, ids, texts = zip(*pieces, strict=True)
        if 0 in n:
            return Codec.joined([p for p in pieces if p[0]])
        return sum(n), " ".join(ids), " ".join(texts)

    def chunk(self, raw: bytes) -> tuple[tuple[int, str, str], bytes, bytes]:
        """(piece, first and last word) of a chunk."""
        self.met += 1
        found = self.chunks.get(raw)
        if found is None:
            words = [w for w in _PARTS.split(raw) if w]
            found = (self.joined(self.encode_words(words)), words[0], words[-1]) if words else ((0, "", ""), b"", b"")
            self.chunks.put(raw, found)
        else:
            self.reused += 1
        return found

    def agree(self, joins: list[tuple[bytes, ...]]) -> bool:
        """Do all joins (words around a cut) encode and decode to what their parts do?"""
        return not self.apart_from(joins)

    def apart_from(self, joins: list[tuple[bytes, ...]]) -> list[int]:
        """The numbers of the joins that do not encode and decode to what their parts do."""
        spans = [b" ".join(w for w in j if w).decode() for j in joins]
        self.joins += len(joins)
        wrong = []
        for k, (join, e) in enumerate(zip(joins, self.tokenizer.encode_batch_fast(spans, add_special_tokens=False), strict=True)):
            ids = e.ids
            n, own, text = self.joined(self.encode_words([w for w in join if w]))
            if len(ids) != n or " ".join(map(str, ids)) != own or self.tokenizer.decode(ids, skip_special_tokens=False) != text:
                wrong.append(k)
        self.disagreed += len(wrong)
        return wrong

    def encode(self, texts: list[bytes], cuts: list[list[int]]) -> Iterator[tuple[int, str, str]]:
        """Texts, each cut at the given places; all joins are tested in one batch before any is given."""
        if not self.apart:
            yield from (self.whole(raw.decode()) for raw in texts)
            return
        made, joins, of = [], [], []
        for d, (raw, places) in enumerate(zip(texts, cuts, strict=True)):
            pieces, before = [], b""
            for a, b in zip([0, *places], [*places, len(raw)], strict=True):
                piece, first, last = self.chunk(raw[a:b])
                pieces.append(piece)
                if before and first:
                    joins.append((before, first))
                    of.append(d)
                before = last or before
            made.append(pieces)
        anew = {of[k] for k in self.apart_from(joins)} if joins else set()
        for d, pieces in enumerate(made):
            yield self.whole(texts[d].decode()) if d in anew else self.joined(pieces)


def cut_places(data: np.ndarray) -> np.ndarray:
    """White space where the hash of the WINDOW bytes before it says to cut."""
    at = np.flatnonzero(_spaces()[data])
    at = at[at >= WINDOW]
    if not len(at):
        return at
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))  # the eight bytes from each place
    return at[(mix64(eight[at - 8] ^ mix64(eight[at - WINDOW])) >> U(40)) % U(CUT_RATE) == 0]


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(b" \t\n\r")] = True
    return table


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def _encoded(codec: Codec, column: pa.Array) -> Iterator[tuple[int, str, str]]:
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        own = data[offsets[a] : offsets[b]]
        cuts = cut_places(own)
        raw = own.tobytes()
        texts, places = [], []
        for d in range(a, b):
            start, end = int(offsets[d] - offsets[a]), int(offsets[d + 1] - offsets[a])
            text = raw[start:end]
            # The tokenizer ignores case, but for the names of its special tokens. It composes before it lowers, and letters
            # of ASCII compose with U+0300 to U+036F alone.
            plain = codec.caseless and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text
            texts.append(text.lower() if plain else text)
            i, j = np.searchsorted(cuts, (start + LEAST, end))
            places.append([])
            last = start
            for c in cuts[i:j].tolist():
                if c - last >= LEAST:
                    places[-1].append(c - start)
                    last = c
        yield from codec.encode(texts, places)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids array<int>."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            counts, ids = [], []
            for n, text, _ in _encoded(codec, batch.column(1)):
                counts.append(n)
                ids.append(np.array(text.split(), np.int32))
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "n_tokens", "ids"])
        codec.forget()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, text, decoded from ``ids``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _codec(path).tokenizer
        for batch in batches:
            texts = [tokenizer.decode(x.as_py() or [], skip_special_tokens=False) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, without moving ids or texts."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = [(n, sha(ids), sha(text)) for n, ids, text in _encoded(codec, batch.column(1))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
