"""Byte-level BPE: Spark higher-order functions fold ranked merges over the distinct words.

Texts are cut into pieces by the vocabulary's pattern. A piece that is a token stands for itself; a
task's other distinct pieces go to the JVM once, after each CHUNK_BYTES of text, where ``aggregate``
folds merges over them. Its state is the word's byte array as a string of one character per token (one
per byte at first). It runs over the merges that the word's bytes can make, in order of rank, and each
replaces its pair of characters, looked up in a literal map from rank to pair, by the merged token's.

That order is the library's, which merges the leftmost pair of the least rank each time: where every
token is itself made by merges of lesser ranks from its own bytes (load_merges checks it), its parts
at its rank are one known pair, and no merge makes room for one of lesser rank. Which merges a word's
bytes can make is read from a trie of the tokens. Then each text's ids are gathered by piece number.
Nothing shuffles, and a lost task is simply run again.

Pieces over LONG_PIECE bytes, whose fold would take quadratic time, are merged by the same rule with a
heap. Decoding concatenates the tokens' bytes.

Defined cases: a null text is empty and has no tokens; special tokens have no meaning in a text; bytes
that aren't UTF-8 are read as U+FFFD; a text of any length is encoded whole; repeated rows and ties give
equal results; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_blocks

CHUNK_BYTES = 4 << 20
#: Words remembered from chunk to chunk of a task; then the numbers start again.
MAX_WORDS = 400_000
LONG_PIECE = 4096
#: Characters from which a text's pieces are taken one by one.
LONG_TEXT = 1 << 18


def load_ranks(lines: list[bytes]) -> list[bytes]:
    """The tokens by id, from the lines of a rank file (base64 token, rank)."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines) if token)
    tokens = [token for _, token in pairs]
    if [rank for rank, _ in pairs] != list(range(len(tokens))) or len(tokens) > 60_000:
        raise ValueError("ranks must run from 0 without a gap, and below 60,000")
    return tokens


def token_char(token: int) -> str:
    """One character for each token id, without surrogates."""
    return chr(0x100 + token if token < 0xD700 else 0x900 + token)


def merge_pairs(tokens: list[bytes]) -> list[tuple[int, int] | None]:
    """The two tokens that each token is made of when its rank's turn comes; None for single bytes."""
    ranks, out = {token: k for k, token in enumerate(tokens)}, []
    for k, token in enumerate(tokens):
        parts = [token[j : j + 1] for j in range(len(token))]
        while len(parts) > 2:
            least, at = min(((ranks.get(parts[j] + parts[j + 1], k), j) for j in range(len(parts) - 1)))
            if least >= k:
                raise ValueError(f"token {k} isn't made by merges of lesser ranks")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None)
    return out


class TokenTrie:
    """The tokens' bytes as a trie in two arrays: from node k, byte b leads to node base[k] + b if parent[base[k] + b] is k."""

    def __init__(self, tokens: list[bytes]) -> None:
        below: dict[bytes, set[int]] = {}
        for token in tokens:
            for j in range(len(token)):
                below.setdefault(token[:j], set()).add(token[j])
        size = 2 * sum(map(len, below.values())) + 4096
        used, base, parent, node_of, first = bytearray(size), np.zeros(size, np.int32), np.full(size, -1, np.int32), {b"": 0}, {}
        used[0] = 1
        for prefix in sorted(below, key=lambda p: (len(p), -len(below[p]))):
            node, steps = node_of[prefix], sorted(below[prefix])
            at = first.get(len(steps), 1)  # nodes of fewer steps may still fit before it
            while any(used[at + b] for b in steps):
                at += 1
                if at + 256 >= len(used):
                    used, base, parent = used + bytes(size), np.r_[base, np.zeros(size, np.int32)], np.r_[parent, np.full(size, -1, np.int32)]
            first[len(steps)], base[node] = at, at
            for b in steps:
                used[at + b], parent[at + b], node_of[prefix + bytes([b])] = 1, node, at + b
        room = int(base.max()) + 258
        self.base, self.parent, self.token = base[:room], parent[:room], np.full(room, -1, np.int32)
        for k, token in enumerate(tokens):
            self.token[node_of[token]] = k

    def merges(self, words: list[bytes]) -> pa.ListArray:
        """For each word the tokens of two bytes and more that stand anywhere in it, in order of rank, each once."""
        n = np.array([len(w) for w in words], np.int64) + 1
        data = np.full(int(n.sum()) + 1, 256, np.int32)  # 256, which no step takes, ends each word
        ends, word = np.cumsum(n) - 1, np.repeat(np.arange(len(words), dtype=np.int64), n)
        inside = np.ones(len(data), bool)
        inside[ends] = inside[-1] = False
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        at = np.flatnonzero(inside)
        node, depth, found = self.base[0] + data[at], 1, []
        while len(at):
            step = self.base[node] + data[at + depth]
            on = self.parent[step] == node
            at, node, depth = at[on], step[on], depth + 1
            token = self.token[node]
            hit = token >= 0
            found.append(word[at[hit]] << 16 | token[hit])
        keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
        cuts = np.searchsorted(keys, np.arange(len(words) + 1, dtype=np.int64) << 16)
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)))


class Vocabulary:
    """The tokens of a rank file by id, and what cuts and decodes need beside them."""

    def __init__(self, data: bytes) -> None:
        self.tokens = load_ranks(data.splitlines())
        self.trie = TokenTrie(self.tokens)
        self.ranks = {token: k for k, token in enumerate(self.tokens)}
        self.chars = np.array([ord(token_char(self.ranks[bytes([b])])) for b in range(256)], "<u2")

    def starts(self, words: list[bytes]) -> pa.Array:
        """The fold's first state of words: a character for each byte."""
        codes = self.chars[np.frombuffer(b"".join(words), np.uint8)]
        width = 1 + (codes >= 0x80) + (codes >= 0x800)
        cuts = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        ends = np.r_[0, np.cumsum(width)][cuts].astype(np.int32)
        return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(codes.tobytes().decode("utf-16-le").encode()))


@functools.lru_cache(maxsize=2)
def _loaded(data: bytes) -> tuple[Vocabulary, list[tuple[int, int] | None]]:
    vocabulary = Vocabulary(data)
    return vocabulary, merge_pairs(vocabulary.tokens)


def load_merges(rank_path: str) -> tuple[Vocabulary, list[tuple[int, int] | None]]:
    """The vocabulary of a rank file and its merge_pairs(), which raises ValueError if tokens aren't made in order of rank."""
    with open(rank_path, "rb") as file:
        return _loaded(file.read())


def load_vocabulary(rank_path: str) -> Vocabulary:
    return load_merges(rank_path)[0]


def fold_merges(word: Column, merges: Column, pairs: list[tuple[int, int] | None]) -> Column:
    """The merged form of a word, a character a token: its bytes' characters, after its ``merges`` in their order."""
    # split() of a literal is folded to a literal array, so the plan holds each table once
    pair = F.split(F.lit(" ".join("-" if p is None else token_char(p[0]) + token_char(p[1]) for p in pairs)), " ")
    merged = F.split(F.lit(" ".join(map(token_char, range(len(pairs))))), " ")
    return F.aggregate(merges, word, lambda state, k: F.replace(state, F.get(pair, k), F.get(merged, k)))


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece, in n log n steps."""
    parts, after, before = [bytes([b]) for b in piece], list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    heap = [(ranks[piece[k : k + 2]], k, 1, 1) for k in range(len(piece) - 1) if piece[k : k + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        right = after[k]
        if len(parts[k]) != a or right >= len(parts) or len(parts[right]) != b:
            continue
        parts[k] += parts[right]
        parts[right], after[k] = b"", after[right]
        if after[k] < len(parts):
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] < len(parts) and (rank := ranks.get(parts[left] + parts[after[left]])) is not None:
                heapq.heappush(heap, (rank, left, len(parts[left]), len(parts[after[left]])))
    return [ranks[p] for p in parts if p]


#: The pattern of byte-level vocabularies, and one that cuts texts of Latin-1 alone in the same way, only quicker.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN, LATIN_NUMBERS, LATIN_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN_PATTERN = f" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_SPACES}{LATIN}{LATIN_NUMBERS}]+|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+"


@functools.cache
def splitter(pattern: str):
    """A function that cuts a text into the pattern's matches."""
    whole = regex.compile(pattern)
    found = whole.findall if not whole.groups else lambda text: [m.group() for m in whole.finditer(text)]
    if pattern != COMMON_PATTERN:
        return found
    quick = re.compile(LATIN_PATTERN).findall

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return found(text)
        return quick(text)

    return cut


def cuts(text: str, cut, pattern: str) -> Iterator[list[str]]:
    """The pieces of a text; those of a long one in lots, found one by one, so that they are never all there at once."""
    if len(text) <= LONG_TEXT:
        yield cut(text)
        return
    found = (m.group() for m in regex.finditer(pattern, text))
    while lot := list(itertools.islice(found, LONG_TEXT)):
        yield lot


class Pieces(dict):
    """Piece -> number: token ids first, then new pieces in order of arrival."""

    def __init__(self, tokens: list[bytes]) -> None:
        super().__init__()
        self.tokens = tokens
        self.forget()

    def __missing__(self, piece: str) -> int:
        self[piece] = number = self.size
        self.size += 1
        self.new.append(piece)
        return number

    def forget(self) -> None:
        self.clear()
        for k, token in enumerate(self.tokens):
            try:
                self[token.decode()] = k
            except UnicodeDecodeError:
                pass
        self.new: list[str] = []
        self.size = len(self.tokens)


CUT = ["doc_id", "number", "word", "merges", "pieces"]


def _cut(shared, pattern: str):
    """Rows of a chunk's new words (number, and word with its merges, or a long piece), then of its texts (doc_id, pieces: numbers).

    Words are numbered on from chunk to chunk of a task, from 0 again after MAX_WORDS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        first = len(vocabulary.tokens)
        cut, pieces, held, size, kind = splitter(pattern), Pieces(vocabulary.tokens), [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            known = pieces.size - len(pieces.new) - first
            for at in range(0, len(pieces.new), 20_000):
                words = [w.encode() for w in pieces.new[at : at + 20_000]]
                long = [w if len(w) > LONG_PIECE else None for w in words]
                words = [w if far is None else b"" for far, w in zip(long, words, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(words), kind), pa.array(np.arange(known + at, known + at + len(words)), pa.int64()), vocabulary.starts(words), vocabulary.trie.merges(words), pa.array(long, pa.binary())], CUT)
            for ids, blobs in held:
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.list_(pa.int32())), pa.array(blobs, pa.binary())], CUT)
            held.clear()
            pieces.new.clear()
            if pieces.size > first + MAX_WORDS:
                pieces.forget()

        for batch in batches:
            kind = batch.column(0).type
            for at, end, texts in text_blocks(batch.column(1)):
                held.append((batch.column(0).slice(at, end - at), [b"".join(np.fromiter(map(pieces.__getitem__, f), dtype="<i4", count=len(f)).tobytes() for f in cuts(t.decode("utf-8", "replace"), cut, pattern)) for t in texts]))
                size += sum(map(len, texts))
                if size >= CHUNK_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _gathered(shared):
    """(doc_id, token_ids) of the texts, from the folded words before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = shared.value.tokens, shared.value.ranks
        ids: list[np.ndarray] = []  # of the words so far, end to end
        counts: list[np.ndarray] = []
        flat = lengths = starts = None
        for batch in batches:
            is_word = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(is_word.astype(np.int8))) + 1
            for at, end in zip([0, *cuts], [*cuts, len(is_word)], strict=True):
                if at == end:
                    continue
                rows = batch.slice(at, end - at)
                if is_word[at]:
                    flat = None
                    if rows.column(1)[0].as_py() == 0:
                        ids, counts = [], []
                    folded = rows.column(2).to_pylist()
                    chars = np.frombuffer("".join(folded).encode("utf-16-le"), "<u2").astype(np.int32)
                    chars -= np.where(chars < 0xD800, 0x100, 0x900).astype(np.int32)
                    n = np.array([len(f) for f in folded], np.int64)
                    if rows.column(4).null_count < len(folded):
                        heads = np.r_[0, np.cumsum(n)]
                        merged = [chars[heads[k] : heads[k + 1]] if long is None else np.array(heap_merges(long, ranks), np.int32) for k, long in enumerate(rows.column(4).to_pylist())]
                        chars, n = np.concatenate(merged), np.array([len(m) for m in merged], np.int64)
                    ids.append(chars)
                    counts.append(n)
                else:
                    if flat is None:
                        lengths = np.concatenate([np.ones(len(tokens), np.int64), *counts])
                        starts = np.cumsum(lengths) - lengths
                        flat = np.concatenate([np.arange(len(tokens), dtype=np.int32), *ids])
                    out = []
                    for blob in rows.column(4).to_pylist():
                        number = np.frombuffer(blob, "<i4")
                        n = lengths[number]
                        ends = np.cumsum(n)
                        out.append(flat[np.repeat(starts[number] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
                    offsets = np.r_[0, np.cumsum([len(o) for o in out])].astype(np.int32)
                    found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out), pa.int32()))
                    yield pa.RecordBatch.from_arrays([rows.column(0), found], ["doc_id", "token_ids"])

    return run


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", then=None, schema: str = "token_ids array<int>") -> DataFrame:
    """(doc_id, token_ids) of every row. ``rank_path`` lies on the driver; its tokens go along with the tasks.

    ``then``, a function over record batches, goes on with that table in the same Python worker; ``schema`` is
    what it returns beside doc_id. A worker of its own would cost each running task some 150 MB.
    """
    vocabulary, pairs = load_merges(rank_path)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    cut = narrow.mapInArrow(_cut(shared, pattern), f"doc_id {kind}, number long, word string, merges array<int>, pieces binary")
    folded = cut.select("doc_id", "number", F.when(F.col("word").isNotNull(), fold_merges(F.col("word"), F.col("merges"), pairs)).alias("word"), F.lit(None).cast("array<int>").alias("merges"), "pieces")
    gather = _gathered(shared)
    return folded.mapInArrow((lambda batches: then(gather(batches))) if then else gather, f"doc_id {kind}, {schema}")


def _each(finish, columns: list[tuple[str, pa.DataType]]):
    """A row of ``columns`` for each row's ids: ``finish`` takes an array of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                lists = rows.column(1)
                heads, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
                found = [finish(ids[a:b]) for a, b in zip(heads[:-1], heads[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([f[c] for f in found], kind) for c, (_, kind) in enumerate(columns))], ["doc_id", *(name for name, _ in columns)])

    return run


def _joined(pool: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join(pool[ids].tolist())


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, decoded: binary) of (doc_id, token_ids)."""
    pool = np.array(load_vocabulary(rank_path).tokens, dtype=object)
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary"
    return encoded.select("doc_id", "token_ids").mapInArrow(_each(lambda ids: (_joined(pool, ids),), [("decoded", pa.binary())]), schema)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digest(rank_path: str):
    """n_tokens, ids_sha256 and decoded_sha256 beside doc_id, as the ``then`` of encode()."""
    tokens = load_vocabulary(rank_path).tokens
    pool, said = np.array(tokens, dtype=object), np.array([b"%d " % k for k in range(len(tokens))])

    def finish(ids: np.ndarray) -> tuple[int, str, str]:
        of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(ids), LONG_TEXT):
            own = ids[at : at + LONG_TEXT]
            text = said[own].tobytes().translate(None, b"\0")  # fixed widths, filled up by zero bytes
            of_ids.update(text if at + LONG_TEXT < len(ids) else text[:-1])
            of_bytes.update(_joined(pool, own))
        return len(ids), of_ids.hexdigest(), of_bytes.hexdigest()

    return _each(finish, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digest(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its ids, decoded again."""
    return encode(df, rank_path, pattern, then=round_trip_digest(rank_path), schema=DIGEST)
