"""Byte-level BPE: a bounded-lookahead streaming encoder, and an incremental decoder.

From the merge list follows how far to the right of a token anything can still change
it: a pending merge is only ever undone by a merge of lower rank to its right, which
in turn only by one of lower rank still, so that the chains end.  ``lookahead`` finds
the longest such chain in bytes.  A boundary that far from the end of what has been
read is a boundary of the whole text's tokens, whatever follows; so a long piece is
encoded through a window, tokens leave once they are stable, and memory stays
constant.  Pieces are short runs between stable cuts; their tokens are kept in a cache
of bounded size.  Decoding feeds token bytes to an incremental UTF-8 machine.

Defined cases: null text counts as empty and has no tokens; texts of any length go through in
chunks; empty tables give empty results; repeated rows and rows with equal doc_id are encoded
each on its own; of merges of equal rank the leftmost goes first; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import map_rows

QUERY = "op10_bpe_codec"
ORACLE_SQL = None

#: Default vocabulary file; a parameter everywhere.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Pieces kept with their tokens in a worker; then the cache starts afresh.
CACHE_PIECES = 100_000
#: Characters that are cut into pieces at a time, and bytes from which a piece goes through the window.
CHUNK_CHARS, LONG_BYTES = 1 << 16, 256
#: Bytes up to which pieces are merged in step.
SHORT_BYTES = 40

#: White space, and the pattern that splits text into pieces.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHAPE = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
PIECES = regex.compile(SHAPE.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{S}", SPACE))
#: The same pattern with classes written out, for texts of Latin-1 and common punctuation.
COMMON = re.compile(
    SHAPE.replace("{L}", "A-Za-zªµºÀ-ÖØ-öø-ÿ").replace("{N}", "0-9²³¹¼½¾").replace("{S}", "\\t-\\r \x85\xa0")
)
UNCOMMON = re.compile(r"[^\x00-\xff\u2010-\u2027\u2030-\u205e\u20ac]")
#: A cut that no piece spans, whatever stands on either side.
CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def byte_letters() -> dict[str, int]:
    """Letter of each byte in the vocabulary file: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file's contents."""

    def __init__(self, contents: str) -> None:
        model = json.loads(contents)
        letters = byte_letters()
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << 32 | b: r for r, (a, b, _) in reversed(list(enumerate(self.pairs)))}
        self.merged = [c for _, _, c in self.pairs]
        self.first_of, self.merged_of = np.array(self.first), np.array(self.merged)
        keys = np.array([a << 32 | b for a, b, _ in self.pairs])
        self.pair_keys, at = np.unique(keys, return_index=True)
        self.pair_keys, self.pair_ranks = np.append(self.pair_keys, np.iinfo(np.int64).max), np.append(at, len(self.merged))
        self.lookahead = lookahead(self.pairs, self.token_bytes)
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Tokens of bytes: the pair of lowest rank, leftmost first, is merged until none is left."""
        first, get, never = self.first, self.rank.get, len(self.merged)
        ids = [first[b] for b in data]
        ranks = [get(a << 32 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [token] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | token, never)
            if i < len(ranks):
                ranks[i] = get(token << 32 | ids[i + 1], never)
        return ids

    def stream(self, parts: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one piece that comes in parts; each leaves once nothing further on can change it."""
        window, held = max(LONG_BYTES, 2 * self.lookahead), b""
        for part in parts:
            held += part
            while len(held) > window + self.lookahead:
                done = 0
                for token in self.merge(held[: window + self.lookahead]):
                    end = done + len(self.token_bytes[token])
                    if end > window:
                        break
                    yield token
                    done = end
                held = held[done:]
        yield from self.merge(held)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed tokens of short words (2 bytes or more), all merged in step: in each round, every word
        takes its merge of lowest rank, leftmost first, until none has one left."""
        sizes = np.array([len(w) for w in words])
        width, never = int(sizes.max()), len(self.merged)
        ids = np.zeros((len(words), width + 1), np.int64)
        ids[np.arange(width + 1) < sizes[:, None]] = self.first_of[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width) >= sizes[:, None] - 1] = never
        sizes = sizes.copy()
        places = np.arange(width + 1)
        live = np.arange(len(words))
        own, held = ids, ranks
        while live.size:
            at = held.argmin(1)
            row = np.arange(live.size)
            best = held[row, at]
            go = best < never
            if not go.all():
                ids[live[~go], : own.shape[1]] = own[~go]
                live, own, held, at, best = live[go], own[go], held[go], at[go], best[go]
                if not live.size:
                    break
                row = row[: live.size]
            token = self.merged_of[best]
            shift = places[: own.shape[1] - 1] + (places[: own.shape[1] - 1] > at[:, None])
            own = np.take_along_axis(own, shift, 1)
            own[row, at] = token
            held = np.take_along_axis(held, (shift := places[: held.shape[1] - 1] + (places[: held.shape[1] - 1] >= at[:, None])), 1)
            sizes[live] -= 1
            if held.shape[1] == 0:
                ids[live, : own.shape[1]] = own
                break
            has = at > 0
            held[row[has], at[has] - 1] = self._ranks(own[row[has], at[has] - 1], token[has])
            has = at < sizes[live] - 1
            held[row[has], at[has]] = self._ranks(token[has], own[row[has], at[has] + 1])
        flat = ids[places < sizes[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; the number of merges where there is none."""
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.merged))

    def long(self, data: bytes) -> bytes:
        """Packed tokens of a long piece, through the window."""
        parts = (data[i : i + LONG_BYTES] for i in range(0, len(data), LONG_BYTES))
        return np.fromiter(self.stream(parts), "<u4").tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed tokens (little-endian unsigned 32-bit) of a text, chunk by chunk."""
        return (part for _, part in self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, packed tokens) for each chunk of each text, in order; pieces that the
        cache lacks are merged together for about ``CHUNK_CHARS`` characters at a time."""
        block: list[tuple[int, list[str] | bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for pieces in self._pieces(text):
                block.append((i, pieces))
                held += len(pieces)
                if held * 4 >= CHUNK_CHARS:
                    yield from self._packed(block)
                    block, held = [], 0
        yield from self._packed(block)

    def _packed(self, block: list[tuple[int, list[str] | bytes]]) -> Iterator[tuple[int, bytes]]:
        cache = self.cache
        own = set().union(*(p for _, p in block if isinstance(p, list)))
        if len(cache) + len(own) > CACHE_PIECES:
            cache.clear()
        lack = sorted(own.difference(cache), key=len)
        words = [p.encode() for p in lack]
        far: dict[str, bytes] = {}
        todo: list[int] = []
        for k, word in enumerate(words):
            if len(word) == 1:
                cache[lack[k]] = np.array([self.first[word[0]]], "<u4").tobytes()
            elif len(word) <= SHORT_BYTES:
                todo.append(k)
            elif len(word) <= LONG_BYTES:
                cache[lack[k]] = np.array(self.merge(word), "<u4").tobytes()
            else:
                far[lack[k]] = self.long(word)
        for at in range(0, len(todo), 2048):
            some = todo[at : at + 2048]
            for k, packed in zip(some, self.merge_many([words[k] for k in some]), strict=True):
                cache[lack[k]] = packed
        get = cache.__getitem__
        for i, pieces in block:
            if isinstance(pieces, bytes):
                yield i, pieces
            elif far:
                yield i, b"".join([far.get(p) or get(p) for p in pieces])
            else:
                yield i, b"".join(map(get, pieces))

    def _pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """Pieces of a text chunk by chunk; special tokens come as they are packed."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self._plain(text, at, m.start())
            yield np.array([self.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[str]]:
        if at >= end:
            return
        find = PIECES if UNCOMMON.search(text, at, end) else COMMON
        while at < end:
            stop = end
            if end - at > CHUNK_CHARS and (m := CUT.search(text, at + CHUNK_CHARS, end)):
                stop = m.start()
            yield find.findall(text, at, stop)
            at = stop

    def decode(self, packed: Iterator[bytes]) -> Iterator[str]:
        """Text of packed tokens: bytes enter an incremental machine, and characters leave once they are whole."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        token = self.token_bytes.__getitem__
        for part in packed:
            yield machine.decode(b"".join(map(token, np.frombuffer(part, "<u4").tolist())))
        yield machine.decode(b"", final=True)


def lookahead(pairs: list[tuple[int, int, int]], token_bytes: list[bytes]) -> int:
    """Bytes right of a boundary after which it is certain: the longest chain of merges, each of lower
    rank than the last, by which one can be undone from the right, and the longest token.

    Merges are taken by rank.  reach[x]: how far right of token x the merges so far can be undone.
    spine[m]: the same for the tokens at the right edge of what m makes, while they still stood alone.
    """
    reach: dict[int, int] = {}
    spine: dict[int, int] = {}
    most = 0
    for a, b, made in pairs:
        far = len(token_bytes[b]) + max(reach.get(b, 0), spine.get(b, 0))
        spine[made] = max(spine.get(made, 0), reach.get(b, 0), spine.get(b, 0))
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
    return most + max(map(len, token_bytes))


_CODECS: dict[str, Codec] = {}


def codec_of(contents: str) -> Codec:
    """The worker's codec of a vocabulary file's contents."""
    key = hashlib.sha256(contents.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(contents)
    return _CODECS[key]


def digests(codec: Codec, block: list[tuple]) -> Iterator[tuple]:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each (doc_id, text)."""
    parts = codec.encode_many([text for _, text in block])
    ahead = next(parts, None)
    for i, (doc_id, _) in enumerate(block):
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

        def own(i=i, ids=ids) -> Iterator[bytes]:
            nonlocal n, ahead
            while ahead is not None and ahead[0] == i:
                n += len(ahead[1]) // 4
                ids.update(ahead[1])
                yield ahead[1]
                ahead = next(parts, None)

        for part in codec.decode(own()):
            decoded.update(part.encode())
        yield doc_id, n, ids.hexdigest(), decoded.hexdigest()


def bpe_codec(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    The file at ``vocabulary`` (byte-level BPE as the tokenizers library saves it, a few MB at most)
    is read by the driver and broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        contents = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(contents.value)
        block: list[tuple] = []
        held = 0
        for row in rows:
            block.append((row[0], row[1] or ""))
            held += len(block[-1][1])
            if held >= CHUNK_CHARS:
                yield from digests(codec, block)
                block, held = [], 0
        yield from digests(codec, block)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the round trip."""
    return bpe_codec(spark.read.parquet(f"{sf_dir}/documents.parquet"))
