"""Byte-pair encoding by walking a trie of the distinct words.

The encoding of a word is fixed by the last token of each of its prefixes: the prefix without
that token is a shorter prefix, whose own last token is known. Distinct words are visited in
trie order (sorted, with a stack of the states on the path), so a prefix that many words share
is worked out once. Encoding a word is then a walk back from its end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

#: How the byte-level tokenizer cuts a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a worker remembers between batches.
REMEMBERED = 400_000
#: Texts that are cut, encoded and given out together, by their total length.
BATCH_CHARS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tables(path: str) -> dict:
    """What a worker needs of a vocabulary file: token bytes by id, merged pairs, special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_letters()
    ids = file["model"]["vocab"]
    tokens = [b""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        tokens[i] = bytes(letters[c] for c in name)
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    pairs = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(c != i for i, (_, _, c) in enumerate(pairs, len(tokens) - len(pairs))):
        raise ValueError("token ids must follow the order of the merges")
    return {"tokens": tokens, "pairs": pairs, "special": special}


class Codec:
    """Encoder and decoder over one vocabulary; remembers the words of recent batches."""

    def __init__(self, tables: dict) -> None:
        self.tokens: list[bytes] = list(tables["tokens"])
        self.special: dict[str, int] = tables["special"]
        self.base = len(self.tokens) - len(tables["pairs"])
        self.left, self.right = {c: a for a, _, c in tables["pairs"]}, {c: b for _, b, c in tables["pairs"]}
        self.joined = {a << 32 | b: c for a, b, c in tables["pairs"]}
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.longest = max(map(len, self.tokens))
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        for name, i in self.special.items():
            self.tokens += [b""] * (i + 1 - len(self.tokens))
            self.tokens[i] = name.encode()

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart when their bytes are encoded together.

        Merges are undone latest first, following the two tokens at the border; they stay
        apart unless some pair at the border would have been merged before one of the two
        went into a larger token. Of equal merges the left one comes first.
        """
        before = len(self.tokens)
        while True:
            merged = self.joined.get(a << 32 | b)
            if merged is not None and merged < before:
                return False
            if max(a, b) < self.base:
                return True
            if a > b:
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words in trie order and remember them."""
        ids, fits, longest = self.ids, self.fits, self.longest
        path: list[int] = [-1]  # path[i]: last token of the first i bytes of the word before
        sizes: list[int] = [0]
        above = b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            n, shared = len(raw), 0
            for x, y in zip(raw, above):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], sizes[shared + 1 :]
            for i in range(shared + 1, n + 1):
                for size in range(min(i, longest), 0, -1):
                    token = ids.get(raw[i - size : i])
                    if token is None:
                        continue
                    if size == i:
                        break
                    pair = path[i - size] << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self.compatible(path[i - size], token)
                    if fit:
                        break
                path.append(token)
                sizes.append(size)
            above, out, i = raw, [], n
            while i:
                out.append(path[i])
                i -= sizes[i]
            out.reverse()
            self.known[word] = tuple(out)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.cut.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut_special.split(text)):
            out += [part] if i % 2 else self.cut.findall(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.fits) > 10 * REMEMBERED:
            self.fits.clear()
        cut = [self.pieces(t) for t in texts]
        self.known.update((s, (i,)) for s, i in self.special.items())
        self.learn(set().union(*cut).difference(self.known))
        get = self.known.__getitem__
        for words in cut:
            yield list(chain.from_iterable(map(get, words)))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def digest(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    """How many tokens, and SHA-256 of their numbers and of the text they decode to."""
    listed = ",".join(map(str, ids))
    return len(ids), sha256(listed.encode()).hexdigest(), sha256(codec.decode(ids).encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def encoded(docs: DataFrame, path: str, emit: Callable[[Codec, list[int]], tuple], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode ``docs.text`` and give out what ``emit(codec, ids)`` makes of each text.

    The result has the columns ``keep`` of ``docs`` and those of ``schema``, a row per row. NULL
    and empty texts have no tokens; texts of any length are encoded whole. There is no
    shuffle: each task keeps a bounded memory of words, and the vocabulary is sent to the
    executors once.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(read_tables(path))
    mark = uuid4().hex
    rows = docs.select(*keep, "text")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    types = spark.createDataFrame([], f"{kept}, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        codec = _codecs.get(mark)
        if codec is None:
            _codecs.clear()
            codec = _codecs[mark] = Codec(tables.value)
        arrow = to_arrow_schema(types)
        for batch in batches:
            at, sizes = 0, batch.column(len(keep))
            lengths = pa.compute.fill_null(pa.compute.utf8_length(sizes), 0).to_pylist()
            while at < batch.num_rows:
                end, total = at, 0
                while end < batch.num_rows and (end == at or total + lengths[end] <= BATCH_CHARS):
                    total += lengths[end]
                    end += 1
                part = batch.slice(at, end - at)
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                made = list(zip(*[emit(codec, ids) for ids in codec.encode(texts)]))
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                columns += [pa.array(values, type=arrow.field(n).type) for n, values in zip(names, made)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                at = end

    return rows.mapInArrow(run, types)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The token ids of every text, as ``ids``."""
    return encoded(docs, path, lambda codec, ids: (ids,), "ids array<int>", keep)
