"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model merges, again and again, the adjacent pair whose piece scores best; an agenda of candidate merges gives
that order. With dropout, a candidate that comes up is skipped when a hash, keyed by the seed, of the text, the rank of
the word in it, the candidate's place and its piece falls below the rate. So each occurrence of a word is segmented
anew, a text gets the same ids for the same seed, on any machine and after any retry, and every segmentation decodes to
the text.

No piece of the model holds a space mark after another character, or a line break, so words are encoded apart. A worker
remembers words undropped, with the candidates that came up: where an occurrence skips none of these, its ids are the
remembered ones. All other words of a batch are merged together, a matrix for each length: in every round each row
takes the best candidate of its agenda. A word of more than ``LONGEST`` characters has a heap of its own, whose work
grows with n log n. Characters without a piece become byte pieces; so does a space mark that stands in the text itself,
which plain SentencePiece would turn into a space.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, slices, text_batches

SPACE = "▁"
#: Words that a worker remembers, and characters of the longest that goes into a matrix.
MEMORY, LONGEST = 300_000, 64
#: Characters that one numpy pass handles at once; a longer text is a pass of its own.
PASS_CHARS = 1_500_000
_WORDS = re.compile(r" *[^ \n]+| +|\n+").findall
_NEVER = np.int32(2**31 - 1)
_PLACE, _PIECE, _RANK = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_MASK = 2**64 - 1


def candidate_keys(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * _PLACE + piece.astype(np.uint64) * _PIECE


def _mixed(x: int) -> int:
    """``mix`` of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        raw = [b""] * n
        for piece, i in self.ids.items():
            raw[i] = piece.replace(SPACE, " ").encode()
            if re.search(f"[^{SPACE}]{SPACE}|\n", piece):
                raise ValueError(f"a piece spans words: {piece!r}")
            if any(c not in self.ids for c in piece):
                raise ValueError(f"a piece has a character that is none: {piece!r}")
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = raw
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        # Symbols are piece ids; a character without a piece is -1 less its code point.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = self.ids[SPACE], -1 - ord(SPACE)
        # Pieces rank by score, equal ones alike; a pair of pieces that make one is found by halving.
        own = np.array(list(self.ids.values()))
        _, ranks, counts = np.unique([-self.scores[i] for i in own], return_inverse=True, return_counts=True)
        self.rank, self.at_rank = np.full(n, _NEVER, np.int32), np.full(len(counts), -1, np.int32)
        self.rank[own] = ranks
        alone = counts[ranks] == 1
        self.at_rank[ranks[alone]] = own[alone]  # -1 where several pieces share a rank
        pairs = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys, self.pair_ids = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32)

    def pair_pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ids[at], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, occurrence: np.ndarray | None, bound: np.uint64) -> np.ndarray:
        """Ranks of the candidates that merge two symbols; ``_NEVER`` for pairs that make no piece or are skipped."""
        piece = self.pair_pieces(left, right)
        out = np.where(piece >= 0, self.rank[piece], _NEVER)
        if occurrence is not None:
            where = np.flatnonzero(piece >= 0)
            skip = mix(occurrence[where] + candidate_keys(place[where], piece[where])) < bound
            out[where[skip]] = _NEVER
        return out

    def encode_word(self, word: str, occurrence: int, bound: int) -> list[int]:
        """Ids of one word, whose space marks are spaces, by a heap."""
        symbols, n = [SPACE if c == " " else c for c in word], len(word)
        own = [c == SPACE for c in word]  # space marks of the text itself
        ids, rank = self.ids, self.rank
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []
        gone = [False] * n

        def offer(left: int) -> None:
            right = after[left]
            if right < n and not own[left] and not own[right] and (i := ids.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (int(rank[i]), left, right, symbols[left] + symbols[right]))

        for left in range(n - 1):
            offer(left)
        place, piece_of = int(_PLACE), int(_PIECE)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if gone[left] or gone[right] or after[left] != right or symbols[left] + symbols[right] != piece:
                continue
            if bound and _mixed(occurrence + left * place + ids[piece] * piece_of & _MASK) < bound:
                continue
            symbols[left], gone[right] = piece, True
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out = []
        for s, left_out, mark in zip(symbols, gone, own):
            if left_out:
                continue
            if not mark and (i := ids.get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in (SPACE if mark else s).encode("utf-8", "surrogatepass")]
        return out

    def encode_words(self, words: list[str], occurrence: np.ndarray | None, bound: np.uint64, log: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin and the last end, keys of the candidates taken, where each word's begin)."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        done: list[tuple[np.ndarray, np.ndarray]] = []  # words, and a row of symbols for each
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths[lengths <= LONGEST]).tolist():
            row = np.flatnonzero(lengths == n)
            self._merge(row, symbols[starts[row][:, None] + np.arange(n)], None if occurrence is None else occurrence[row], bound, done, taken if log else None)
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            found = self.encode_word(words[i], 0 if occurrence is None else int(occurrence[i]), 0 if occurrence is None else int(bound))
            done.append((np.array([i]), np.array([found], np.int32)))
        counts = np.zeros(len(words), np.int64)
        for row, m in done:
            counts[row] = m.shape[1]
        begin = np.cumsum(counts) - counts
        ids = np.empty(counts.sum(), np.int32)
        for row, m in done:
            ids[begin[row][:, None] + np.arange(m.shape[1])] = m
        ids, bounds = self._as_bytes(ids, np.append(begin, len(ids)))
        keys, key_bounds = np.zeros(0, np.uint64), np.zeros(len(words) + 1, np.int64)
        if taken:
            owner = np.concatenate([w for w, _ in taken])
            order = np.argsort(owner, kind="stable")
            keys = np.concatenate([k for _, k in taken])[order]
            key_bounds = np.searchsorted(owner[order], np.arange(len(words) + 1))
        return ids.astype(np.uint32), bounds, keys, key_bounds

    def _merge(self, row: np.ndarray, symbols: np.ndarray, occurrence: np.ndarray | None, bound: np.uint64, done: list, taken: list | None) -> None:
        n = symbols.shape[1]
        place = np.broadcast_to(np.arange(n), symbols.shape).copy()

        def ranks(left: np.ndarray, right: np.ndarray, at: np.ndarray, own: np.ndarray | None) -> np.ndarray:
            return self.pair_ranks(left.ravel(), right.ravel(), at.ravel(), own, bound)

        rank = ranks(symbols[:, :-1], symbols[:, 1:], place[:, :-1], None if occurrence is None else np.repeat(occurrence, n - 1)).reshape(len(row), n - 1)
        while n > 1:
            best = rank.argmin(1)
            which = np.arange(len(row))
            least = rank[which, best]
            go = least != _NEVER
            if not go.all():
                done.append((row[~go], symbols[~go]))
                row, symbols, place, rank, best, least, which = row[go], symbols[go], place[go], rank[go], best[go], least[go], which[: go.sum()]
                occurrence = occurrence[go] if occurrence is not None else None
            if not len(row):
                return
            piece = self.at_rank[least]
            tied = np.flatnonzero(piece < 0)
            if len(tied):
                piece[tied] = self.pair_pieces(symbols[tied, best[tied]], symbols[tied, best[tied] + 1])
            if taken is not None:
                taken.append((row, candidate_keys(place[which, best], piece)))
            symbols[which, best] = piece
            stays = np.arange(n) != best[:, None] + 1
            symbols, place = symbols[stays].reshape(len(row), n - 1), place[stays].reshape(len(row), n - 1)
            rank = rank[np.arange(n - 1) != best[:, None]].reshape(len(row), n - 2)
            n -= 1
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < n - 1)
            r, c = np.concatenate([before, after]), np.concatenate([best[before] - 1, best[after]])
            if len(r):
                rank[r, c] = ranks(symbols[r, c], symbols[r, c + 1], place[r, c], occurrence[r] if occurrence is not None else None)
        if len(row):
            done.append((row, symbols))

    def _as_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with those that are no piece, below 0, as byte pieces."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, bounds
        points, which = np.unique(-1 - ids[unknown], return_inverse=True)
        coded = [[self.byte[b] for b in chr(p).encode("utf-8", "surrogatepass")] for p in points.tolist()]
        width = np.ones(len(ids), np.int64)
        width[unknown] = np.array([len(c) for c in coded])[which]
        start = np.append(0, np.cumsum(width))
        out = np.repeat(ids, width)
        out[ranges(start[unknown], width[unknown])] = np.concatenate([coded[w] for w in which.tolist()])
        return out, start[bounds]


class Coder:
    """Encodes and decodes texts; remembers words undropped with the keys of their candidates."""

    def __init__(self, path: str, rate: float, seed: int):
        self.pieces, self.rate, self.seed = Pieces(path), rate, seed
        self.bound = np.uint64(min(int(rate * 2**64), _MASK))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.keys = np.zeros(0, np.uint32), np.zeros(0, np.uint64)
        self.id_bounds, self.key_bounds = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in what is remembered, after what is new there was added."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > MEMORY and self.known:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            ids, bounds, keys, key_bounds = self.pieces.encode_words(new, None, self.bound, self.rate > 0)
            # a word that goes through the heap is encoded anew each time, so its candidates aren't needed
            self.id_bounds = np.append(self.id_bounds, bounds[1:] + len(self.ids))
            self.key_bounds = np.append(self.key_bounds, key_bounds[1:] + len(self.keys))
            self.ids, self.keys = np.append(self.ids, ids), np.append(self.keys, keys)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last end); an empty text has none.

        A text gets a space before it, as the model asks for."""
        parts, sizes = [], []
        for lo, hi in slices(texts, PASS_CHARS):
            ids, counts = self._encode(texts[lo:hi])
            parts.append(ids)
            sizes.append(counts)
        bounds = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), bounds

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def occurrences(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        """A hash for each word of each text, by its rank."""
        seeds = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed) for t in texts], np.uint64)
        return mix(np.repeat(seeds, counts) + ranges(np.zeros(len(texts), np.int64), counts).astype(np.uint64) * _RANK)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [_WORDS(" " + t) if t else [] for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        words = [w for x in lists for w in x]
        number = self._learn(words)
        start, length, source = self.id_bounds[number], self.id_bounds[number + 1] - self.id_bounds[number], self.ids
        if self.rate and len(words):
            occurrence = self.occurrences(texts, counts)
            n = self.key_bounds[number + 1] - self.key_bounds[number]
            skip = mix(np.repeat(occurrence, n) + self.keys[ranges(self.key_bounds[number], n)]) < self.bound
            dropped = np.zeros(len(words), bool)
            dropped[np.repeat(np.arange(len(words)), n)[skip]] = True
            dropped |= np.fromiter(map(len, words), np.int64, len(words)) > LONGEST
            which = np.flatnonzero(dropped)
            ids, bounds, _, _ = self.pieces.encode_words([words[i] for i in which.tolist()], occurrence[which], self.bound)
            start[which], length[which], source = bounds[:-1] + len(source), np.diff(bounds), np.append(source, ids)
        ids = source[ranges(start, length)]
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))]
        return ids, np.diff(ends)

    def raw_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.pieces.raw_bytes[ranges(self.pieces.raw_start[ids], self.pieces.raw_length[ids])]

    def decode(self, ids: np.ndarray) -> str:
        return self.raw_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "surrogatepass")[1:]


def worker_coder(path: str, rate: float, seed: int) -> Coder:
    """The coder of this Python worker; it outlives a task."""
    kept = sys.__dict__.setdefault("_verdigris_coders", {})
    if (path, rate, seed) not in kept:
        kept.clear()
        kept[path, rate, seed] = Coder(path, rate, seed)
    return kept[path, rate, seed]


def _encode(path: str, rate: float, seed: int, batches) -> Iterator:
    import pyarrow as pa

    coder = worker_coder(path, rate, seed)
    for b in text_batches(batches, 1, PASS_CHARS):
        texts = b.column(1).to_pylist()
        ids, bounds = coder.encode_all([t or "" for t in texts])
        missing = np.array([t is None for t in texts], bool)
        lists = pa.ListArray.from_arrays(pa.array(np.where(np.append(missing, False), None, bounds.astype(object)), pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "text", "ids"])


def _decode(path: str, batches) -> Iterator:
    import pyarrow as pa

    coder = worker_coder(path, 0.0, 0)
    for b in batches:
        texts = [None if x is None else coder.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def encode(df: DataFrame, model: str, rate: float = 0.0, seed: int = 0, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, text, ids) of every row; with ``rate`` 0 the ids are SentencePiece's own.

    Null texts give null ids, empty ones none. Equal texts get equal ids, whatever their rows. Very long texts are
    encoded whole. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_encode, model, rate, seed), f"id {kind}, text string, ids array<int>")
    return out.select(F.col("id").alias(row_id), "text", "ids")


def decode(df: DataFrame, model: str, ids: str = "ids", row_id: str = "doc_id") -> DataFrame:
    """(row_id, text) from ids of this model. Null ids give null and no ids the empty text; rows are independent of
    each other, so repeated rows, an empty table and further columns need no rule."""
    bounded_batches(df.sparkSession)
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(partial(_decode, model), f"id {kind}, text string").withColumnRenamed("id", row_id)


def _digest(path: str, rate: float, seed: int, batches) -> Iterator:
    import pyarrow as pa

    coder = worker_coder(path, rate, seed)
    for b in text_batches(batches, 1, PASS_CHARS):
        texts = [t or "" for t in b.column(1).to_pylist()]
        ids, bounds = coder.encode_all(texts)
        ends = np.append(0, np.cumsum(coder.pieces.raw_length[ids]))[bounds].tolist()
        raw, data = coder.raw_bytes(ids).tobytes(), ids.astype("<u4").tobytes()
        same = [raw[lo:hi] == (b" " * bool(t)) + t.encode("utf-8", "surrogatepass") for t, lo, hi in zip(texts, ends, ends[1:])]
        at = (4 * bounds).tolist()
        crcs = [zlib.crc32(data[lo:hi]) for lo, hi in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names=["id", "n_pieces", "ids_crc32", "lossless"])


def encoding_report(df: DataFrame, model: str, rate: float, seed: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, n_pieces, ids_crc32, lossless): what ``encode`` gives and whether it decodes to the text.

    Null texts are empty and have no pieces; equal texts have equal ids; very long ones are encoded whole; an empty
    table gives no rows; other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(partial(_digest, model, rate, seed), f"id {kind}, n_pieces long, ids_crc32 long, lossless boolean").withColumnRenamed("id", row_id)
