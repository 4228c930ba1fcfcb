"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The model file gives the pieces and their scores; the merge agenda is run
here. A candidate is a pair of neighbouring symbols whose joined text is a
piece. The agenda takes the candidate of the highest score, leftmost first,
and a candidate is skipped when a keyed hash of (seed, document, text of the
chunk, its place in the document, place in it, joined piece) falls below the
dropout rate. The decision does not depend on when the candidate comes up, so
a run is repeatable on any partitioning, and another seed gives another
segmentation of the same text. Every occurrence of a word is decided by itself.

No piece holds a space mark after another character, so merges never cross
the start of a run of spaces; nor do they cross a character without a piece,
which becomes byte pieces. Texts are cut there into chunks. The candidates a
chunk can ever have are the pieces among its substrings, so equal chunks of a
block that skip the same ones have the same outcome and are merged once. All
chunks of one length go through the agenda together as rows of a matrix.
Longer chunks use a heap, each occurrence by itself.

The text is not normalised, and a literal space mark (U+2581) is written in
byte pieces, so decoding gives back exactly the encoded text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.llm.common import MASK64, documents, in_blocks, mix64, name_free, prepare

SEED = 20240917
DROPOUT = 0.1
MARK = "▁"
BLOCK_CHARS = 500_000  # texts are encoded in blocks of about so many characters
MATRIX_LENGTH = 32  # longer chunks use the heap
DECODED_IDS = 1 << 18  # ids of a text that are decoded at a time
SKIP_ROWS = 1 << 14  # chunks whose candidates are hashed at a time
_NONE = np.int32(1 << 30)
_FREE = np.int64(-1 << 62)  # no pair's key
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_A, _B, _C = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def mix64_int(x: int) -> int:
    """:func:`intentspark.llm.common.mix64` for one Python integer."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK64
    return x ^ (x >> 31)


class Pieces:
    """The tables of one model file; one instance a worker."""

    _loaded: dict[str, Pieces] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
        by_name = {names[i]: i for i in range(n) if plain[i]}
        if any(MARK in p.lstrip(MARK) for p in by_name):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes_id = np.zeros(256, np.int32)
        self.texts: list[bytes] = [p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(names)]
        n_bytes = 0
        for i in range(n):
            if sp.is_byte(i):
                value = int(names[i][3:5], 16)
                self.bytes_id[value], self.texts[i], n_bytes = i, bytes([value]), n_bytes + 1
        if n_bytes != 256:
            raise ValueError("the model has no byte pieces")
        self.text_bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.text_size = np.array([len(t) for t in self.texts], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.symbol = np.full(0x110000, -1, np.int32)  # piece of a character
        for p, i in by_name.items():
            if len(p) == 1 and p != MARK:
                self.symbol[ord(p)] = i
        self.space = by_name[MARK]
        self.symbol[ord(" ")] = self.space
        order = sorted({sp.get_score(i) for i in by_name.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(order)}
        pairs = {}
        for p, i in by_name.items():
            for k in range(1, len(p)):
                left, right = by_name.get(p[:k]), by_name.get(p[k:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (i, rank[sp.get_score(i)])
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k][0] for k in sorted(pairs)], np.int32)
        self.ranks = np.array([pairs[k][1] for k in sorted(pairs)], np.int32)
        self._fill()
        # hashes of the pieces that merges can make, as encode_block takes them of substrings
        made = sorted(set(self.joined.tolist()))
        texts = [names[i].replace(MARK, " ") for i in made]
        size = np.array([len(t) for t in texts], np.int64)
        run, inverse = _running(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        hashes = _content(run, inverse, np.cumsum(size) - size, size)
        order = np.argsort(hashes)
        self.made_hash, self.made = hashes[order], np.array(made, np.int64)[order]
        self.longest = int(size.max(initial=1))
        self.maybe = np.zeros(1 << 20, bool)  # by a hash's last bits: most substrings are told to be none at once
        self.maybe[hashes & np.uint64((1 << 20) - 1)] = True

    def _fill(self) -> None:
        """The pairs as a hash table with at least three places free of four; a
        taken place sends a pair on to the next one."""
        bits = max(4 * len(self.keys), 1 << 10).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, _FREE)
        self.slot_joined, self.slot_rank = np.full(1 << bits, -1, np.int32), np.full(1 << bits, _NONE)
        left = np.arange(len(self.keys))
        at = self._slots(self.keys)
        while len(left):
            free = self.slot_key[at] == _FREE
            self.slot_key[at[free]] = self.keys[left[free]]  # one of those that want a place gets it
            got = self.slot_key[at] == self.keys[left]
            self.slot_joined[at[got]], self.slot_rank[at[got]] = self.joined[left[got]], self.ranks[left[got]]
            left, at = left[~got], (at[~got] + 1) & self.last

    def _slots(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * _P) >> self.shift).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(joined piece or -1, rank) of neighbouring symbols."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slots(key)
        found = self.slot_key[at]
        hit = found == key
        joined, rank = np.where(hit, self.slot_joined[at], np.int32(-1)), np.where(hit, self.slot_rank[at], _NONE)
        more = np.nonzero(~hit & (found != _FREE))
        at, key = at[more], key[more]
        while len(at):
            at = (at + 1) & self.last
            found = self.slot_key[at]
            hit = found == key
            here = tuple(x[hit] for x in more)
            joined[here], rank[here] = self.slot_joined[at[hit]], self.slot_rank[at[hit]]
            go = ~hit & (found != _FREE)
            more, at, key = tuple(x[go] for x in more), at[go], key[go]
        return joined, rank


def _candidate(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return place.astype(np.uint64) * np.uint64(_A) + piece.astype(np.uint64) * np.uint64(_B)


def _dropped(x: np.ndarray, limit: int) -> np.ndarray:
    return (mix64(x) >> np.uint64(40)) < np.uint64(limit)


def _skipped(key, place, piece, limit: int):
    with np.errstate(over="ignore"):
        return _dropped(key + _candidate(place, piece), limit)


def agenda_matrix(pieces: Pieces, symbols: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The agenda over rows of equally many symbols, one merge a row and step.

    Returns the remaining symbols, row after row, and their number by row."""
    n, width = symbols.shape
    done = np.full((n, width), -1, np.int32)
    rows, s = np.arange(n), symbols.astype(np.int32)
    place = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
    joined, rank = pieces.pairs(s[:, :-1], s[:, 1:])
    x, y = np.nonzero(joined >= 0)
    skip = _skipped(keys[x], place[x, y], joined[x, y], limit)
    rank[x[skip], y[skip]] = _NONE
    while len(rows) and s.shape[1] > 1:
        at = rank.argmin(axis=1)
        go = rank[np.arange(len(rows)), at] < _NONE
        if not go.all():
            done[rows[~go], :s.shape[1]] = s[~go]
            rows, s, place, keys, joined, rank, at = (x[go] for x in (rows, s, place, keys, joined, rank, at))
            if not len(rows):
                break
        r = np.arange(len(rows))
        s[r, at] = joined[r, at]
        # every row loses a place with every merge, so all have the same number left
        stay = np.arange(s.shape[1] - 1) <= at[:, None]
        s, place = np.where(stay, s[:, :-1], s[:, 1:]), np.where(stay, place[:, :-1], place[:, 1:])
        stay = stay[:, :-1]
        joined, rank = np.where(stay, joined[:, :-1], joined[:, 1:]), np.where(stay, rank[:, :-1], rank[:, 1:])
        x, y = np.concatenate([r, r]), np.concatenate([at - 1, at])
        ok = np.flatnonzero((y >= 0) & (y < s.shape[1] - 1))
        x, y = x[ok], y[ok]
        new, order = pieces.pairs(s[x, y], s[x, y + 1])
        hit = np.flatnonzero(new >= 0)
        order[hit[_skipped(keys[x[hit]], place[x[hit], y[hit]], new[hit], limit)]] = _NONE
        joined[x, y], rank[x, y] = new, order
    done[rows, :s.shape[1]] = s
    return done[done >= 0], (done >= 0).sum(axis=1)


def agenda_heap(pieces: Pieces, symbols: list[int], key: int, limit: int) -> list[int]:
    """The same agenda for one chunk of any length."""
    n = len(symbols)
    s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    table = {}
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= n:
            return
        pair = (s[i] << 32) | s[j]
        if pair not in table:
            at = min(int(np.searchsorted(pieces.keys, pair)), len(pieces.keys) - 1)
            table[pair] = (int(pieces.joined[at]), int(pieces.ranks[at])) if pieces.keys[at] == pair else None
        if (found := table[pair]) and mix64_int((key + i * _A + found[0] * _B) & MASK64) >> 40 >= limit:
            heapq.heappush(heap, (found[1], i, j, s[i], s[j], found[0]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, left, right, new = heapq.heappop(heap)
        if s[i] != left or after[i] != j or s[j] != right or j >= n:
            continue
        s[i], s[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in s if x >= 0]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _PINV)):
                _powers[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])
    return _powers[0], _powers[1]


def _running(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which :func:`_content` hashes any substring."""
    power, inverse = _power_tables(len(points) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:len(points)])
    return np.concatenate([[np.uint64(0)], sums]), inverse


def _content(run: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((run[start + length] - run[start]) * inverse[start] + length.astype(np.uint64))


def _candidates(pieces: Pieces, run, inverse, start: np.ndarray, length: np.ndarray) -> tuple:
    """(terms of the candidates' hashes, number by chunk), chunk after chunk:
    every piece that merges may make in a chunk, wherever it stands."""
    chunk, term = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for size in range(2, min(pieces.longest, int(length.max(initial=1))) + 1):
        rows = np.flatnonzero(length >= size)
        n = length[rows] - size + 1
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(rows, n)
        h = _content(run, inverse, start[owner] + place, np.full(len(owner), size))
        some = np.flatnonzero(pieces.maybe[h & np.uint64((1 << 20) - 1)])
        owner, place, h = owner[some], place[some], h[some]
        at = np.minimum(np.searchsorted(pieces.made_hash, h), len(pieces.made) - 1)
        hit = pieces.made_hash[at] == h
        chunk.append(owner[hit])
        term.append(_candidate(place[hit], pieces.made[at[hit]]))
    chunk, term = np.concatenate(chunk), np.concatenate(term)
    return term[np.argsort(chunk, kind="stable")], np.bincount(chunk, minlength=len(start))


def _alike(pieces: Pieces, points, run, inverse, start, length, content, keyed, limit: int) -> tuple:
    """(pick, which): chunks that stand for all, and for each chunk the one that
    has its text and skips the same candidates."""
    _, word, of, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    each = np.arange(len(start))
    if not _same(points, start, length, word, of):  # two texts of one hash
        return each, each
    if not limit:
        return word, of
    short = (length[word] <= MATRIX_LENGTH) & (times > 1)  # the others stand for themselves
    term, count = _candidates(pieces, run, inverse, start[word], np.where(short, length[word], 0))
    first = np.cumsum(count) - count
    n = count[of]
    skipped, pattern = [], np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(start), SKIP_ROWS):
            k, w = n[at:at + SKIP_ROWS], of[at:at + SKIP_ROWS]
            ends = np.cumsum(k)
            which = np.repeat(first[w] - (ends - k), k) + np.arange(int(ends[-1]))
            skip = _dropped(np.repeat(keyed[at:at + SKIP_ROWS], k) + term[which], limit)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(skip, mix64(which.astype(np.uint64) + np.uint64(1)),
                                                                      np.uint64(0)))])
            pattern[at:at + SKIP_ROWS] = sums[ends] - sums[ends - k]
            skipped.append(skip)
        group = np.where(short[of], mix64(content + pattern * np.uint64(_C)), keyed)
    _, pick, which = np.unique(group, return_index=True, return_inverse=True)
    if not _same(points, start, length, pick, which):
        return each, each
    skip, begin = np.concatenate(skipped), np.cumsum(n) - n
    for at in range(0, len(start), SKIP_ROWS):
        k, b = n[at:at + SKIP_ROWS], begin[at:at + SKIP_ROWS]
        here = np.arange(b[0], b[-1] + k[-1])
        if (skip[here + np.repeat(begin[pick[which[at:at + SKIP_ROWS]]] - b, k)] != skip[here]).any():
            return each, each
    return pick, which


def encode_block(pieces: Pieces, texts: list[str], keys: np.ndarray, seed: int, dropout: float,
                 offsets: np.ndarray | None = None) -> tuple:
    """(ids, ids by text) of texts that each start with the space put before a
    document, or that begin ``offsets`` characters into one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    total = len(points)
    if not total:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    limit = int(dropout * (1 << 24))
    sym = pieces.symbol[points]
    first = np.zeros(total, bool)
    starts_of_texts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first[starts_of_texts[sizes > 0]] = True
    first[1:] |= (sym[1:] < 0) | (sym[:-1] < 0) | ((sym[1:] == pieces.space) & (sym[:-1] != pieces.space))
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, total))
    owner = np.searchsorted(starts_of_texts, start, side="right") - 1  # of empty texts the last, so never one
    run, inverse = _running(points)
    content = _content(run, inverse, start, length)
    place = start - starts_of_texts[owner] + (0 if offsets is None else offsets[owner])
    with np.errstate(over="ignore"):
        keyed = mix64(content + keys.astype(np.uint64)[owner] * np.uint64(_C) + np.uint64((seed * _A) & MASK64))
        keyed = mix64(keyed + place.astype(np.uint64) * np.uint64(_B))
    pick, which = _alike(pieces, points, run, inverse, start, length, content, keyed, limit)
    u_start, u_len, u_key = start[pick], length[pick], keyed[pick]
    counts = np.zeros(len(pick), np.int64)
    parts, part_rows = [], []
    for size in np.unique(u_len):
        rows = np.flatnonzero(u_len == size)
        if size == 1:
            known = sym[u_start[rows]] >= 0
            parts.append(sym[u_start[rows[known]]].astype(np.int64))
            part_rows.append((rows[known], np.ones(int(known.sum()), np.int64)))
            for r in rows[~known]:
                raw = np.frombuffer(chr(points[u_start[r]]).encode(), np.uint8)
                parts.append(pieces.bytes_id[raw].astype(np.int64))
                part_rows.append((np.array([r]), np.array([len(raw)])))
        elif size <= MATRIX_LENGTH:
            flat, n = agenda_matrix(pieces, sym[u_start[rows, None] + np.arange(size)], u_key[rows], limit)
            parts.append(flat)
            part_rows.append((rows, n))
        else:
            for r in rows:
                got = agenda_heap(pieces, sym[u_start[r]:u_start[r] + size].tolist(), int(u_key[r]), limit)
                parts.append(np.array(got, np.int64))
                part_rows.append((np.array([r]), np.array([len(got)])))
    order = np.concatenate([x for x, _ in part_rows])
    counts[order] = np.concatenate([n for _, n in part_rows])
    offset = np.zeros(len(pick), np.int64)
    offset[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
    flat = np.concatenate(parts)
    n = counts[which]
    ends = np.cumsum(n)
    ids = flat[np.repeat(offset[which] - (ends - n), n) + np.arange(int(ends[-1]))]
    per_text = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
    return ids.astype(np.int32), per_text


def _same(points, start, length, pick, which) -> bool:
    """Whether every chunk equals the chunk that stands for it."""
    twin = start[pick][which]
    if (length[pick][which] != length).any():
        return False
    shift = np.repeat(twin - start, length)
    return bool((points[np.arange(len(points)) + shift] == points).all())


def segments(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """A long text cut where a run of spaces starts, which no merge crosses."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or text[cut - 1] != " ":
                break
            cut += 1
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def encode_texts(pieces: Pieces, texts: list, keys: list, seed: int = SEED, dropout: float = DROPOUT) -> list:
    """An id array for each text; None for None, no ids for an empty text.
    ``keys``: an integer for each text, which the hash takes for the document."""
    jobs = []
    for i, t in enumerate(texts):
        at = 0
        for part in segments(" " + t) if t else []:
            jobs.append((i, part, at))
            at += len(part)
    out: list = [None if t is None else [] for t in texts]
    at = 0
    while at < len(jobs):
        end, chars = at, 0
        while end < len(jobs) and (end == at or chars + len(jobs[end][1]) <= BLOCK_CHARS):
            chars += len(jobs[end][1])
            end += 1
        part = jobs[at:end]
        ids, n = encode_block(pieces, [x[1] for x in part], np.array([keys[x[0]] for x in part], np.int64), seed, dropout,
                              np.array([x[2] for x in part], np.int64))
        for (i, *_), got in zip(part, np.split(ids, np.cumsum(n)[:-1])):
            out[i].append(got)
        at = end
    return [x if x is None else np.concatenate(x) if x else np.empty(0, np.int32) for x in out]


def decode_ids(pieces: Pieces, ids) -> str:
    """The text of the ids; the space put before a document is taken off again."""
    ids, out = np.asarray(ids, np.int64), []
    for at in range(0, len(ids), DECODED_IDS):
        some = ids[at:at + DECODED_IDS]
        n = pieces.text_size[some]
        ends = np.cumsum(n)
        out.append(pieces.text_bytes[np.repeat(pieces.text_start[some] - (ends - n), n) + np.arange(int(ends[-1]))].tobytes())
    return b"".join(out).decode("utf-8")[1:]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", model: str | None = None,
           seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """``df`` with the column ``out`` (array of piece ids).

    A null text gets null, an empty text an empty array. ``key``
    and the text only go into the hash, so rows that repeat both are encoded
    alike, wherever they stand. An existing column called ``out`` is replaced; all others
    are kept. The work is row by row: no shuffle, and memory is bounded by the
    block size (a longer text is cut where no merge crosses).
    """
    spark = df.sparkSession
    prepare(spark)
    path = model or default_model()
    rest = [c for c in df.columns if c.lower() != out.lower()]
    # the text too, as keys may be null or repeated
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(text))
    src = df.select(*[df[c] for c in rest], df[text].alias(name_free(df, "__text")),
                    hashed.alias(name_free(df, "__key")))

    def run(batches):
        pieces = Pieces.load(path)
        for whole in batches:
            for batch in in_blocks(whole, whole.num_columns - 2, 4 * BLOCK_CHARS):
                got = encode_texts(pieces, batch.column(batch.num_columns - 2).to_pylist(),
                                   batch.column(batch.num_columns - 1).to_pylist(), seed, dropout)
                sizes = np.cumsum([0, *(0 if x is None else len(x) for x in got)])
                flat = np.concatenate([x for x in got if x is not None] or [np.empty(0, np.int32)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat),
                                               mask=pa.array([x is None for x in got]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], ids], [*rest, out])

    schema = T.StructType([*df.select(*[df[c] for c in rest]).schema.fields,
                           T.StructField(out, T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the column ``out``: the text of the ids (null: null)."""
    spark = df.sparkSession
    prepare(spark)
    path = model or default_model()
    rest = [c for c in df.columns if c.lower() != out.lower()]
    src = df.select(*[df[c] for c in rest], df[ids].alias(name_free(df, "__ids")))

    def run(batches):
        pieces = Pieces.load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column(batch.num_columns - 1)
                texts = [None if x is None else decode_ids(pieces, x) for x in
                         (v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in column)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*rest, out])

    schema = T.StructType([*df.select(*[df[c] for c in rest]).schema.fields, T.StructField(out, T.StringType())])
    return src.mapInArrow(run, schema)


def op2_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: the ids and whether the
    decoded text is the text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    back = decode(encode(docs))
    return back.select("doc_id", F.size("ids").alias("n_ids"), F.length("text").alias("n_chars"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
                       F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "ids")
