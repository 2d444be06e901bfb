"""BPE encoding and decoding with forced-boundary splitting.

A word is a sequence of byte symbols. A pair of neighbouring bytes that no vocabulary token holds cannot be joined by any
merge, so a cut there is certain: the fragments between such cuts are encoded independently and their ids concatenated.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; repeated rows and null ids
stay as they are; very long texts are encoded whole, and output leaves in batches of bounded size. Only the id and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bomweave.llm.common import map_batches

#: Bytes of words and their ids that a Python worker keeps, about, and what an entry takes beside them.
KEPT_BYTES, KEPT_ENTRY = 48 << 20, 180
#: Symbols from which a fragment is merged with a heap.
LONG_FRAGMENT = 256
NO_MERGE = 1 << 30
#: Bytes of ids and text after which a batch of results leaves the worker.
BATCH_BYTES = 8 << 20

#: Below U+0250 the library's normalizer and classes equal these rules; texts with other characters, or with the
#: separators 0x1C to 0x1F (white space for Python only), go through the library's own normalizer and word splitter.
_UNUSUAL = regex.compile("[\\x1c-\\x1fɐ-\U0010ffff]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordEncoder:
    """Splits texts into pieces as the tokenizers library does with the given file, and keeps what pieces encode to.

    The store holds at most KEPT_BYTES: two halves, of which the younger takes what the older is asked for; when it is full, the
    older half goes. So frequent words stay, and a worker's memory doesn't grow with the words that it has seen.
    """

    def __init__(self, tokenizer_json: str):
        self.library = Tokenizer.from_str(tokenizer_json)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.symbols = dict(enumerate(byte_symbols()))
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode_symbols(self, symbols: str) -> list[int]:
        """The ids of one piece that the word splitter made, given as byte symbols."""
        raise NotImplementedError

    def _keep(self, key: str, ids: bytes) -> None:
        self.held += KEPT_ENTRY + len(key) + len(ids)
        if self.held > KEPT_BYTES // 2:
            self.kept, self.older, self.held = {}, self.kept, 0
        self.kept[key] = ids

    def _piece(self, piece: str, symbols: str | None = None) -> bytes:
        """Little-endian 32-bit ids of one piece, kept in the younger half; symbols are its bytes, where they aren't the piece itself."""
        found = self.kept.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                if symbols is None:
                    symbols = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.symbols)
                found = array("i", self.encode_symbols(symbols)).tobytes()
            self._keep(piece, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        """The same for a chunk without white space that the younger half doesn't hold.

        Letters, and letters with one mark after them, are one and two pieces, and kept as those; other chunks are kept whole.
        """
        word, mark = chunk[:-1], chunk[-1]
        if word.isalpha() and not mark.isalpha():
            return (self.kept.get(word) or self._piece(word)) + (self.kept.get(mark) or self._piece(mark))
        if chunk.isalpha():
            return self._piece(chunk)
        found = self.older.get(chunk)
        if found is None:
            found = b"".join(map(self._piece, _PIECES.findall(chunk)))
        self._keep(chunk, found)
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if _UNUSUAL.search(text):
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
            return b"".join([self._piece(f" {p}", p) for p in pieces])  # a key of its own: these pieces are byte symbols
        chunks = text.lower().split()
        found = [*map(self.kept.get, chunks)]
        if None in found:
            chunk = self._chunk
            found = [chunk(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


class LibraryEncoder(WordEncoder):
    """Pieces encoded by the library's own model: for callers that want ids and no fragments."""

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        self.model = self.library.model

    def encode_symbols(self, symbols: str) -> list[int]:
        return [t.id for t in self.model.tokenize(symbols)]


class Encoder(WordEncoder):
    """Pieces encoded by forced-boundary splitting and merges of our own (byte symbols with a word-end suffix)."""

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        model = json.loads(tokenizer_json)["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.inner, self.final = self.pairs_inside()

    def pairs_inside(self) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
        """Neighbouring symbols inside any token: before a word's end, and as its last two."""
        inner, final = set(), set()
        for token in self.vocabulary:
            ends = token.endswith(self.suffix) and token != self.suffix
            bare = token[: -len(self.suffix)] if ends else token
            found = [*zip(bare, bare[1:], strict=False)]
            if ends and found:
                final.add(found.pop())
            inner.update(found)
        return inner, final

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """The symbols of a word, cut wherever no token holds the pair around the cut."""
        out, start, last = [], 0, len(symbols) - 2
        for i in range(len(symbols) - 1):
            if (symbols[i], symbols[i + 1]) not in (self.final if i == last else self.inner):
                out.append(symbols[start : i + 1])
                start = i + 1
        out.append(symbols[start:])
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Join the pair of the lowest rank, the leftmost of equals, until no pair of parts has a merge."""
        if len(parts) > LONG_FRAGMENT:
            return self.merge_long(parts)
        rank, none = self.merges.get, NO_MERGE
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] += parts[i + 1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and links between parts: n log n steps for a fragment of n symbols."""
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.merges.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been joined to another part since
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (r := self.merges.get((parts[k], parts[m]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return [p for p in parts if p]

    def encode_symbols(self, symbols: str) -> list[int]:
        cut = self.fragments([*symbols])
        cut[-1][-1] += self.suffix
        vocabulary = self.vocabulary
        return [vocabulary[t] for part in cut for t in self.merge(part) if t in vocabulary]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids with a space between, as the library decodes without a decoder; unknown ids are left out."""
        return " ".join([t for t in map(self.tokens.get, ids) if t is not None])


_ENCODERS: dict[tuple[str, type[WordEncoder]], WordEncoder] = {}


def encoder(tokenizer_json: str, kind: type[WordEncoder] = Encoder) -> WordEncoder:
    """The worker's encoder for a tokenizer, built once a process."""
    if (tokenizer_json, kind) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json, kind] = kind(tokenizer_json)
    return _ENCODERS[tokenizer_json, kind]


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text: a few MB whatever the corpus, read on the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _batches(rows: Iterator[tuple[object, bytes, str]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    keys, ids, texts, held = [], [], [], 0
    names = ["id", "ids", "decoded"]

    def out() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.string())], names)

    for key, own, text in rows:
        keys.append(key)
        ids.append(own)
        texts.append(text)
        held += len(own) + len(text)
        if held >= BATCH_BYTES:
            yield out()
            keys, ids, texts, held = [], [], [], 0
    if keys:
        yield out()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its id, the ids of its whole text (array<int>) and the text that these decode to.

    A narrow map: no shuffle, one pass, memory bounded by the batches; the tokenizer file is the only broadcast.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer.value)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes, str]]:
            for key, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = own.encode(text.as_py())
                yield key, ids, own.decode(array("i", ids))

        for batch in batches:
            yield from _batches(rows(batch), batch.schema.field(0).type)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
