"""Token ids in canonical, length-limited Huffman code.

File format: a table of blocks (one Parquet row each, so that any store that
Spark reads will do and a lost task's output is never half there) beside a
table with the code. A block is decoded without any other block:

    code table    token (int), bits (int): the length of its code. Codes are
                  canonical: given out in the order of (bits, token).
    block table   bucket, seq  place of the block: blocks are in the order of
                               (bucket, seq), and so are the documents
                  doc_ids      the documents of the block, whole ones
                  n_tokens     tokens of each
                  before       tokens in earlier blocks of the bucket
                  n_ids        tokens in the block
                  every        tokens between checkpoints
                  points       bit offset of every ``every``-th token
                  bits         the code, most significant bit first

Lengths come from the counts of all ids (package-merge, at most 16 bits), so
decoding is a lookup of 16 bits in one table; all stretches between
checkpoints are decoded side by side.
"""

from __future__ import annotations

import re
import string
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, in_blocks, prepare, running_offsets, shuffle_partitions, written

END = 2
MAX_BITS = 16
BLOCK_IDS = 1 << 16
EVERY = 64
TOGETHER = 128  # words that go to the tokenizer in one text, between marks
LETTERS_TOGETHER = 1024  # the same for words of letters only, between spaces
CACHED_WORDS = 1_000_000  # words whose ids a worker keeps
BLOCK_BYTES = 4_000_000  # texts are encoded in blocks of about so many bytes


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# --- the code -----------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    m = len(order)
    # each level: (weight, index): a leaf below m, else the package of two items of the level before
    levels, level, kinds = [], weights, np.arange(m)
    for _ in range(limit - 1):
        levels.append(kinds)
        half = len(level) // 2
        packed = level[0:2 * half:2] + level[1:2 * half:2]
        both = np.concatenate([weights, packed])
        merged = np.argsort(both, kind="stable")
        level, kinds = both[merged], merged
    levels.append(kinds)
    take = 2 * m - 2
    lengths = np.zeros(m, np.int64)
    for kinds in reversed(levels):
        chosen = kinds[:take]
        leaves = chosen[chosen < m]
        lengths[leaves] += 1
        take = 2 * int((chosen >= m).sum())
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next ``limit`` bits."""
    symbol, bits = np.zeros(1 << limit, np.int64), np.ones(1 << limit, np.int64)
    codes = canonical_codes(lengths)
    for s in np.flatnonzero(lengths):
        free = limit - int(lengths[s])
        at = int(codes[s]) << free
        symbol[at:at + (1 << free)], bits[at:at + (1 << free)] = s, lengths[s]
    return symbol, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every ``every``-th id)."""
    n = lengths[ids]
    if (n == 0).any():
        raise ValueError("an id has no code")
    ends = np.cumsum(n)
    start = ends - n
    size = (int(ends[-1]) + 7) // 8 + 3 if len(ids) else 3
    value = codes[ids] << (24 - n - (start & 7))  # up to 16 bits at an offset of up to 7: three bytes
    out = np.zeros(size, np.int64)
    for k in range(3):
        # bits of different ids don't overlap, so adding is or-ing
        out += np.bincount((start >> 3) + k, weights=(value >> (16 - 8 * k)) & 255, minlength=size).astype(np.int64)
    return out.astype(np.uint8).tobytes(), start[::every]


def unpack(bits: bytes, n_ids: int, points: np.ndarray, table: tuple, every: int = EVERY) -> np.ndarray:
    """The ids; all stretches between checkpoints advance together."""
    if not n_ids:
        return np.empty(0, np.int64)
    symbol, length = table
    raw = np.frombuffer(bits, np.uint8).astype(np.int64)
    word = np.zeros(len(raw), np.int64)  # 24 bits from each byte on
    word[:-2] = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = np.array(points, np.int64)
    out = np.zeros((every, len(at)), np.int64)
    for k in range(every):
        if k and len(at) * every > n_ids and (len(at) - 1) * every + k >= n_ids:
            at = at[:-1]  # the last stretch is shorter
        if not len(at):
            break
        peek = (word[at >> 3] >> (8 - (at & 7))) & 0xFFFF
        out[k, :len(at)] = symbol[peek]
        at = at + length[peek]
    return out.T.reshape(-1)[:n_ids]


# --- tokens -------------------------------------------------------------------

class Words:
    """Ids by word. The tokenizer's normaliser and splitter work within runs of
    non-space characters, so a text's ids are those of its words in turn."""

    _loaded: dict[str, Words] = {}

    @classmethod
    def load(cls, path: str) -> Words:
        if path not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer, self.ids = Tokenizer.from_file(path), {b"": b""}
        # any special token will do, as pieces that hold "<|" are not put together
        self.mark_id, self.mark = next(
            (i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())
            if t.special and t.content.startswith("<|"))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers")
        self.plain = self._plain()
        self.ends = np.zeros(1 << 16, bool)  # ids that end a run of letters
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _plain(self):
        """A tokenizer of the same model that only cuts at spaces: for words of
        small ASCII letters, if the normaliser and splitter leave these as they
        are and no added token is made of them. Else None."""
        from tokenizers import Tokenizer, pre_tokenizers
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        probe = "".join(a + b for a in string.ascii_lowercase for b in string.ascii_lowercase)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if (normal is not None and normal.normalize_str(probe) != probe or split is None
                or [x for x, _ in split.pre_tokenize_str(probe)] != [probe] or any(map(_SMALL.fullmatch, added))):
            return None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return plain

    def _ids(self, text: str, plain: bool = False) -> np.ndarray:
        tokenizer = self.plain if plain else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Word i has the ids up to ``ends[i]``; ``gap`` ids stand between two words."""
        data, stop = ids.tobytes(), (2 * ends).tolist()
        start = [0, *(2 * (ends[:-1] + gap)).tolist()]
        self.ids.update(zip(words, map(data.__getitem__, map(slice, start, stop))))

    def _learn(self, words: set) -> None:
        """The ids of new words, many at a call."""
        small, letters, mixed, alone = [], [], [], []
        for w in words:
            (small if self.plain and w.isalpha() and w.islower() else letters if w.decode().isalpha()
             else alone if b"<|" in w else mixed).append(w)
        for some, plain in ((kind[at:at + LETTERS_TOGETHER], kind is small) for kind in (small, letters)
                                for at in range(0, len(kind), LETTERS_TOGETHER)):
            ids = self._ids(b" ".join(some).decode(), plain)
            ends = np.flatnonzero(self.ends[ids]) + 1
            # a word has one run of letters at least, so equal numbers mean one each
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._keep(some, ids, ends, 0)
            else:
                mixed += some
        # the mark between two words is a special token: it ends words and has an id of its own
        for at in range(0, len(mixed), TOGETHER):
            some = mixed[at:at + TOGETHER]
            ids = self._ids(self.mark.join([w.decode() for w in some]))
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer's mark is not kept as a token of its own")
            self._keep(some, ids, np.append(ends, len(ids)), 1)
        for w in alone:  # may hold a special token itself
            self.ids[w] = self._ids(w.decode()).tobytes()

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words; new ones are kept."""
        known = self.ids
        new = set(words).difference(known)
        tailed = {w: w.rstrip(_TAIL) for w in new if w[-1] in _TAIL}
        tailed = {w: stem for w, stem in tailed.items() if stem and b"<|" not in w and stem[-1:].isalnum()}
        parts = new.difference(tailed).union(tailed.values(), (w[len(stem):] for w, stem in tailed.items()))
        self._learn(parts.difference(known))
        known.update((w, known[stem] + known[w[len(stem):]]) for w, stem in tailed.items())
        out = list(map(known.__getitem__, words))
        if len(known) > CACHED_WORDS:  # those learned first are the most frequent, as a rule
            self.ids = dict(islice(known.items(), max(1, CACHED_WORDS // 2)))
        return out

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian 16-bit ids of each text (null: none), without special tokens.

        The words are numbered by Arrow, so that each different one of
        ``texts`` is looked up once; the numbers then pick the ids."""
        lowered = pa.array([_lowered((t or "").encode()) for t in texts], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(lowered)  # an empty word before and after outer spaces: it has no ids
        numbered = split.values.dictionary_encode()
        found = self._of(numbered.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(found), "<u2")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        first = np.cumsum(sizes) - sizes
        word = numbered.indices.to_numpy()
        n = sizes[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[word] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (2 * ends[split.offsets.to_numpy()]).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


_SMALL = re.compile(r"[a-z]+")
#: Marks cut off the end of a word after an ASCII letter or digit, where the tokenizer cuts it anyway.
_TAIL = b".,;:!?|&$*%#"


def _lowered(text: bytes) -> bytes:
    """ASCII capitals lowered, as the tokenizer does, so that it meets fewer
    words. Not in a text with combining marks (U+0300 to U+037F begin with
    these bytes): it composes characters first, and some small letters have a
    composed form that their capitals lack. Nor in one that may hold a special
    token, which is found by its case."""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


def _tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids as bytes): one pass over the texts."""
    end = np.array([END], "<u2").tobytes()

    def run(batches):
        words = Words.load(path)
        for whole in batches:
            for batch in in_blocks(whole, 1, BLOCK_BYTES):
                ids = [x + end for x in words.encode(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def _counts(tokens: DataFrame) -> DataFrame:
    """(token, n) over all documents; a task hands on one row a token at most."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                data = b"".join(batch.column(0).slice(at, 1024).to_pylist())
                total += np.bincount(np.frombuffer(data, "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


_BLOCKS = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                     ("n_tokens", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64()),
                     ("every", pa.int32()), ("points", pa.list_(pa.int64())), ("bits", pa.binary())])
_BLOCKS_DDL = ("bucket int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, before bigint, n_ids bigint, "
               "every int, points array<bigint>, bits binary")


def _block_writer(codes: np.ndarray, lengths: np.ndarray):
    """Rows (bucket, doc_id, ids), in order within a bucket, to blocks of whole
    documents that end once they hold BLOCK_IDS ids."""
    def run(batches):
        bucket, seq, before, docs, ids, held = None, 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal seq, before, docs, ids, held
            flat = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
            bits, points = pack(flat, codes, lengths)
            row = (bucket, seq, docs, [len(x) // 2 for x in ids], before, len(flat), EVERY, points, bits)
            seq, before, docs, ids, held = seq + 1, before + len(flat), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS)], schema=_BLOCKS)

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for b, doc, data in zip(*(c.to_pylist() for c in whole.slice(at, 1024).columns)):
                    if b != bucket:
                        if docs:
                            yield block()
                        bucket, seq, before = b, 0, 0
                    docs.append(doc)
                    ids.append(data)
                    held += len(data) // 2
                    if held >= BLOCK_IDS:
                        yield block()
        if docs:
            yield block()

    return run


def _lengths_from(code: DataFrame, value: str) -> np.ndarray:
    """A column of a table (token, value) as an array; it has one row a token of the vocabulary at most."""
    pdf = code.toPandas()
    out = np.zeros(1 << 16, np.int64)
    out[pdf["token"].to_numpy(np.int64)] = pdf[value].to_numpy(np.int64)
    return out


def write_ids(tokens: DataFrame, name: str = "huffman") -> tuple[DataFrame, DataFrame]:
    """(blocks, code) written to the shared folder and read back. ``tokens``: doc_id, ids (16-bit, as bytes).

    Documents are in ascending doc_id order (null first): dealt into ranges
    of (doc_id, a hash of the ids), a range a bucket, and sorted in it. Rows
    that repeat a doc_id are neighbours in the order of that hash, so a hot
    doc_id spreads over buckets; equal rows are dealt over them by their place.
    """
    import pandas as pd
    spark = tokens.sparkSession
    lengths = code_lengths(_lengths_from(_counts(tokens), "n"))
    used = np.flatnonzero(lengths)
    code = written(spark.createDataFrame(pd.DataFrame({"token": used.astype(np.int32),
                                                       "bits": lengths[used].astype(np.int32)}),
                                         "token int, bits int"), f"{name}-code")
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("at")]
    dealt = (tokens.withColumns({"hash": F.xxhash64("ids"), "at": F.monotonically_increasing_id()})
             .repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
             .select(F.spark_partition_id().alias("bucket"), "doc_id", "ids"))
    blocks = written(dealt.mapInArrow(_block_writer(canonical_codes(lengths), lengths), _BLOCKS_DDL), f"{name}-blocks")
    return blocks, code


def read_ids(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone: each block is decoded by itself."""
    lengths = _lengths_from(code, "bits")
    sizes = blocks.groupBy("bucket").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))  # one row a bucket
    totals = running_offsets(sizes, "bucket", "n", "offset")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        table = decode_table(lengths)
        for whole in batches:
            for at in range(whole.num_rows):
                docs, sizes, before, n_ids, every, points, bits, offset = (
                    c[0].as_py() for c in whole.slice(at, 1).columns)
                data = memoryview(unpack(bits, n_ids, points, table, every).astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(data[4 * int(a):4 * int(b)]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + before + offset), pa.array(sizes, pa.int64()),
                     pa.array(crcs, pa.int64())], names)

    return (blocks.join(F.broadcast(totals), "bucket")
            .select("doc_ids", "n_tokens", "before", "n_ids", "every", "points", "bits", "offset")
            .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def encode_files(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, code) of ``docs`` (doc_id, text, any more).

    A null or empty text holds the end id alone. Repeated rows are written
    as often as they come. An empty table gives an empty pair of tables.
    """
    prepare(docs.sparkSession)
    tokens = written(_tokens(docs, tokenizer or default_tokenizer()), "huffman-tokens", compression="zstd")
    return write_ids(tokens)


def op7_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents written in the file format and read back."""
    blocks, code = encode_files(documents(spark, sf_dir))
    return read_ids(blocks, code)
