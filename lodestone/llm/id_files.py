"""Token-ID files (2): canonical length-limited Huffman coding of token ids from global counts.

A set of files holds one codebook (a code length per id) and frames. A frame is decoded on its own: it has
the documents' ids and token counts, and a bit offset for every 64th token, so that a reader can start at any
of them; the decoder runs all of them in step through one table. Frames lie in ascending doc_id order, within a file and
from file to file, and carry the number of ids before them.

    frame = "LHF1" | u32 documents | u64 ids before | u64 ids | u32 interval | u32 payload bytes | u32 payload crc32
          | u8 has_id x documents | i64 doc_id x documents | u32 ids x documents | u32 bit offset x checkpoints | payload

All numbers are little-endian, the bit stream runs from the most significant bit; bits between the last id before a checkpoint and its offset are void.
Frames are written by Spark as a binary column of Parquet, so that a lost task's frames are never half there.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunks, discard, map_arrow, materialize, slices, text_sizes, texts_of
from .token_counts import load

MAGIC = b"LHF1"
HEAD = struct.Struct("<4sIQQIII")
INTERVAL = 64
LONGEST_CODE = 18
#: Ids of a frame at most; a longer document has a frame of its own.
FRAME_IDS = 1 << 17
#: Ids of a file, about.
FILE_IDS = 1 << 24
#: Bytes of texts that are encoded at once.
SLICE_BYTES = 1 << 19


# --- Huffman ------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LONGEST_CODE) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for symbols that never occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        is_leaf.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        single = int(flags[:take].sum())
        lengths[order[:single]] += 1
        take = 2 * (take - single)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for symbol in order[np.count_nonzero(lengths == 0) :]:
        size = int(lengths[symbol])
        code <<= size - before
        codes[symbol] = code
        code, before = code + 1, size
    return codes


@lru_cache(maxsize=2)
def coder(book: bytes) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(book, dtype=np.uint8)
    return canonical_codes(lengths), lengths.astype(np.int64)


@lru_cache(maxsize=2)
def decode_table(book: bytes) -> tuple[np.ndarray, int]:
    """For each window of the longest code's bits: symbol * 32 + length."""
    codes, lengths = coder(book)
    width = int(lengths.max(initial=1))
    table = np.zeros(1 << width, dtype=np.uint32)
    for symbol in np.flatnonzero(lengths):
        low = int(codes[symbol]) << (width - int(lengths[symbol]))
        table[low : low + (1 << (width - int(lengths[symbol])))] = (int(symbol) << 5) | int(lengths[symbol])
    return table, width


def pack_stream(ids: np.ndarray, book: bytes, interval: int) -> tuple[bytes, np.ndarray]:
    """The bit stream of the ids, and the bit offset of every `interval`-th. Blocks of FRAME_IDS ids begin at a whole 32-bit word."""
    codes, lengths = coder(book)
    stream, marks, before = [], [], 0
    block = max(1, FRAME_IDS // interval) * interval
    for first in range(0, len(ids), block):
        own = ids[first : first + block]
        size = lengths[own]
        ends = np.cumsum(size)
        at = ends - size
        wide = codes[own] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        each = np.flatnonzero(np.diff(word, prepend=-1))  # a code is shorter than 32 bits, so each word has a start
        words = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
        words[:-1] = np.bitwise_or.reduceat((wide >> np.uint64(32)).astype(np.uint32), each)
        low = (wide & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        over = np.flatnonzero(low)
        words[word[over] + 1] |= low[over]
        stream.append(words[: -(-int(ends[-1]) // 32)].astype(">u4").tobytes())
        marks.append((at[::interval] + 8 * before).astype(np.uint32))
        before += len(stream[-1])
        if before >= 1 << 29:
            raise ValueError("a document of more than 512 MiB of coded ids doesn't fit a frame")
    return b"".join(stream), np.concatenate(marks) if marks else np.zeros(0, dtype=np.uint32)


def unpack_stream(payload: bytes, starts: np.ndarray, n: int, interval: int, book: bytes) -> np.ndarray:
    """All ids of a stream: every checkpoint is a lane, and the lanes advance together, those of FRAME_IDS ids at once."""
    table, width = decode_table(book)
    out = np.empty((len(starts), interval), dtype=np.uint32)
    shift, lanes = np.uint32(32 - width), max(1, FRAME_IDS // interval)
    for first in range(0, len(starts), lanes):
        at = starts[first : first + lanes].astype(np.int64)
        low = int(at[0]) >> 3
        high = (int(starts[first + lanes]) >> 3) + 1 if first + lanes < len(starts) else len(payload)
        raw = np.frombuffer(payload[low:high] + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at -= 8 * low
        last = len(window) - 1
        for k in range(interval):
            found = table[(window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift]
            out[first : first + lanes, k] = found >> np.uint32(5)
            at += found & np.uint32(31)
    return out.reshape(-1)[:n]


# --- frames -------------------------------------------------------------------------------------------


def make_frame(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, before: int, book: bytes, interval: int = INTERVAL) -> bytes:
    payload, marks = pack_stream(ids, book, interval)
    return b"".join([
        HEAD.pack(MAGIC, len(doc_ids), before, len(ids), interval, len(payload), zlib.crc32(payload)),
        bytes(x is not None for x in doc_ids), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array(counts, dtype="<u4").tobytes(), marks.astype("<u4").tobytes(), payload,
    ])


def read_frame(frame: bytes, book: bytes) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """(doc ids, their token counts, ids before the frame, all ids)."""
    magic, docs, before, n, interval, room, crc = HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    at = HEAD.size
    has = np.frombuffer(frame, dtype=np.uint8, count=docs, offset=at)
    keys = np.frombuffer(frame, dtype="<i8", count=docs, offset=at + docs)
    counts = np.frombuffer(frame, dtype="<u4", count=docs, offset=at + 9 * docs)
    marks = -(-n // interval)
    starts = np.frombuffer(frame, dtype="<u4", count=marks, offset=at + 13 * docs)
    payload = frame[at + 13 * docs + 4 * marks :]
    if len(payload) != room or zlib.crc32(payload) != crc:
        raise ValueError("a frame's payload is damaged")
    return [int(k) if h else None for k, h in zip(keys, has, strict=True)], counts.astype(np.int64), before, unpack_stream(payload, starts, n, interval, book)


# --- tokens -------------------------------------------------------------------------------------------


#: Byte-level models write each byte as a letter: printable Latin-1 as itself, the other bytes from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def byte_set(of: Iterable[int]) -> np.ndarray:
    """For each byte, whether it is one of these."""
    table = np.zeros(256, dtype=bool)
    table[list(of)] = True
    return table


class WordEncoder:
    """Encodes whole texts by the library, each distinct word once until `room` words are known; then those of the last half are kept.

    Valid for tokenizers whose normalizer and pre-tokenizer never look across a space, ignore spaces, fold A-Z and
    end a run of letters at punctuation; `probe` checks that on strings where others differ, and if it fails
    whole texts are encoded. Words end at spaces, at line feeds and between a letter (small ASCII, or ß to ÿ) and one of
    PUNCTUATION (no apostrophe: contractions); other white space stays inside a word and is left to the library.
    Words of more than LONGEST characters aren't kept, and long texts are taken in parts that end at spaces, so memory has a bound of its own.
    """

    LONGEST = 48
    PART = 1 << 20
    PROBE = ("a b", " a  b\nc ", "don't 's 12 3,4 !? é́ ́x <|endoftext|> y", "A\tB ÅÇ  z q", "THAT*** this,, (x) a.b,c!! ΑΣ Σ, İ, x<|endoftext|>", "re|x a|b |. 'd,'s it's, x'll", "ﬁ, Å, q%%% $$", "é, ñ. ß!! ü***x ÿ|a ÷, Õ% ×.", "straße écoute ñandú þorn ÿ ŵ αβγ ω жук ÀÉÎ ǆ ǅ ª º µ 中文")
    PUNCTUATION = byte_set(b",.!?;:|*#$%&\")")
    SMALL = byte_set(range(97, 123))
    #: Second bytes of the letters from U+00DF to U+00FF.
    SMALL_LATIN = byte_set({*range(0x9F, 0xC0)} - {0xB7})
    FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", b"abcdefghijklmnopqrstuvwxyz ")

    def __init__(self, tokenizer, dtype: str, room: int = 500_000):
        self.tokenizer, self.dtype, self.room, self.known, self.before = tokenizer, dtype, room, {" ": b""}, {}
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.by_word = self.by_model = True
        probe = list(self.PROBE)
        if self.encode(probe) != self.direct(probe):  # the model alone won't do
            self.by_model, self.known = False, {" ": b""}
            self.by_word = self.encode(probe) == self.direct(probe)
        self.known = {" ": b""}

    def parts(self, text: bytes) -> Iterator[bytes]:
        """The text cut at spaces into parts of about PART bytes, the cut before that length, if there is one."""
        at = 0
        while len(text) - at > self.PART and ((end := text.rfind(b" ", at, at + self.PART + 1)) != -1 or (end := text.find(b" ", at + self.PART)) != -1):
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, words: list[str]) -> None:
        """Learns words, the space before one left out. Small letters in composed form are the model's input as they are, byte by byte; the rest goes through all steps."""
        other, tokenize, known, code = [], self.tokenizer.model.tokenize, self.known, self.code
        for key in words:
            w = key[1:] if key[0] == " " else key
            if self.by_model and w.isalpha():
                if w.isascii() and w.islower():
                    known[key] = array(code, [t.id for t in tokenize(w)]).tobytes()
                    continue
                if w == w.lower() and is_normalized("NFC", w):
                    known[key] = array(code, [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
                    continue
            other.append(key)
        for k in range(0, len(other), 5_000):
            known.update(zip(other[k : k + 5_000], self.direct([w.removeprefix(" ") for w in other[k : k + 5_000]]), strict=True))

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after another, each with the space before it, if there is one (the first of a text always has one); and where each text's words begin."""
        plain = np.array([b"<" not in t for t in texts], dtype=bool)  # special strings are told apart by case
        raw = bytearray(b"".join(b" " + (t.translate(self.FOLD) if p else t.replace(b"\n", b" ")) for t, p in zip(texts, plain, strict=True)))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        at = np.frombuffer(raw, dtype=np.uint8)
        lead = np.flatnonzero(at == 0xC3)
        if len(lead):  # capitals of Latin-1 are folded, too, in texts of nothing else, letter by letter, as the library does it
            narrow = plain & (np.maximum.reduceat(at, starts) <= 0xC3)
            after = lead[narrow[np.searchsorted(starts, lead, "right") - 1]] + 1
            at[after[(at[after] <= 0x9E) & (at[after] != 0x97)]] += 32
        space = at == 32
        marks = np.flatnonzero(self.PUNCTUATION[at])
        before = at[marks - 1]  # a text begins with a space
        marks = marks[self.SMALL[before] | (self.SMALL_LATIN[before] & (at[marks - 2] == 0xC3))]
        if not plain.all():
            marks = marks[plain[np.searchsorted(starts, marks, "right") - 1]]
        space[marks] = True
        cuts = np.flatnonzero(space)
        offsets = np.append(cuts, len(raw)).astype(np.int32)
        return pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(raw)), np.searchsorted(cuts, starts)

    def words(self, text: str) -> list[str]:
        return self.cut([text.encode()])[0].to_pylist()

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words."""
        out = [*map(self.known.get, words)]
        missing = [i for i, x in enumerate(out) if x is None]
        if 2 * (len(self.known) + len(missing)) > self.room:  # words in use move on, the others go at the next turn
            self.before, self.known = self.known, {" ": b""} | {w: x for w, x in zip(words, out, strict=True) if x is not None}
        elif self.before:
            for i in missing:
                out[i] = self.before.get(words[i])
            self.known.update((words[i], out[i]) for i in missing if out[i] is not None)
            missing = [i for i in missing if out[i] is None]
        self.single([words[i] for i in missing])
        for i in missing:
            out[i] = self.known.pop(words[i]) if len(words[i]) > self.LONGEST else self.known[words[i]]
        return out

    def column(self, texts: list[bytes], end: bytes) -> pa.Array:
        """Ids of each text, with `end` after them. Python sees each distinct word once; the rest is done on whole columns."""
        if not texts:
            return pa.array([], pa.binary())
        words, first = self.cut(texts)
        found = words.dictionary_encode()
        book = self.learned(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.append(first[1:], len(words))
        which = np.insert(found.indices.to_numpy(), ends, len(book))
        made = pa.array([*book, end], pa.binary()).take(pa.array(which))
        at = np.frombuffer(made.buffers()[1], dtype=np.int32, count=len(which) + 1, offset=4 * made.offset)
        at = np.append(at[:1], at[ends + np.arange(1, len(texts) + 1)])
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), made.buffers()[2]])

    def coded(self, texts: list[bytes], end: bytes = b"") -> pa.Array:
        """Ids of each text, with `end` after them."""
        if not self.by_word:
            return pa.array([x + end for x in self.direct([t.decode() for t in texts])], pa.binary())
        if all(len(t) <= self.PART for t in texts):
            return self.column(texts, end)
        return pa.array([b"".join(self.column([p], b"")[0].as_py() for p in self.parts(t)) + end for t in texts], pa.binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.coded([t.encode() for t in texts]).to_pylist()

    __call__ = encode


@lru_cache(maxsize=2)
def word_encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(load(path), dtype)


def tokenize(docs: DataFrame, chunks: Chunks, tokenizer_path: str, end_id: int, dtype: str, id_col: str, text_col: str) -> DataFrame:
    """(chunk, doc_id, rel, n, ids): tokens of each document with the end id, in ascending doc_id order within each chunk; rel counts the chunk's ids before it."""
    size = np.dtype(dtype).itemsize
    end = np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, rel = word_encoder(tokenizer_path, dtype), None, 0
        names = ["chunk", "doc_id", "rel", "n", "ids"]
        for batch in batches:
            for part in slices(batch, text_sizes(batch.column(2)), SLICE_BYTES):
                ids, rels = encode.coded(texts_of(part.column(2)), end), []
                counts = [n // size for n in text_sizes(ids)]
                for c, n in zip(part.column(0).to_pylist(), counts, strict=True):
                    if c != chunk:
                        chunk, rel = c, 0
                    rels.append(rel)
                    rel += n
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rels, pa.int64()), pa.array(counts, pa.int64()), ids], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.select(chunks.of(F.col("doc_id"), F.col("tie")).alias("chunk"), "doc_id", "text", "tie")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "doc_id", "tie").select("chunk", "doc_id", "text")
    return map_arrow(rows, run, "chunk int, doc_id long, rel long, n long, ids binary")


# --- files --------------------------------------------------------------------------------------------


def write_ids(
    docs: DataFrame, path: str, tokenizer_path: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS,
) -> None:
    """Encodes every whole text and writes the files under `path` (a folder that Spark can write), about `file_ids` ids each.

    Null and empty texts have the end id alone. Rows of the same id lie together, in the order of a hash of
    their texts. An empty table gives an empty codebook and no frames. Null ids come first. Further columns
    aren't read. Ids are made once and kept in the shared folder between counting and coding; counts come
    from all of them. The driver holds one count per vocabulary entry and one per chunk (65,536 of each kind at most).
    """
    spark = docs.sparkSession
    vocab = max(load(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    chunks = Chunks(docs.select(id_col), id_col, 1_000)
    tokens = materialize(tokenize(docs, chunks, tokenizer_path, end_id, dtype, id_col, text_col), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text_sizes(batch.column(0)), SLICE_BYTES):
                total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=dtype), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(vocab, dtype=np.int64)
    for r in map_arrow(tokens.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    book = code_lengths(counts).tobytes()
    base, total = {}, 0
    for r in tokens.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy("chunk").toLocalIterator():
        base[r["chunk"]] = total
        total += r["n"]
    starts = spark.createDataFrame(list(base.items()), "chunk int, base long") if base else None

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        sizes: list[int] = []
        ids: list[bytes] = []
        first = held = 0

        def flush() -> pa.RecordBatch:
            frame = make_frame(keys, sizes, np.frombuffer(b"".join(ids), dtype=dtype), first, book)
            made = pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([held], pa.int64()), pa.array([frame], pa.binary())], ["start", "n_docs", "n_ids", "frame"])
            for x in (keys, sizes, ids):
                x.clear()
            return made

        for batch in batches:
            for part in slices(batch, text_sizes(batch.column(3)), SLICE_BYTES):
                for key, start, n, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if keys and (held + n > FRAME_IDS or start != first + held):  # files that don't follow one another can be read by one task
                        yield flush()
                    if not keys:
                        first, held = start, 0
                    keys.append(key)
                    sizes.append(n)
                    ids.append(found)
                    held += n
        if keys:
            yield flush()

    schema = "start long, n_docs int, n_ids long, frame binary"
    if starts is None:
        made = spark.createDataFrame([], schema)
    else:
        placed = tokens.join(F.broadcast(starts), "chunk").select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n", "ids")  # starts: a row per chunk
        files = -(-total // file_ids)
        made = map_arrow(placed, frames, schema).withColumn("file", F.floor(F.col("start") / file_ids).cast("int"))
        made = made.repartitionById(files, "file").sortWithinPartitions("start").drop("file")
    made.write.option("compression", "uncompressed").parquet(f"{path}/frames")
    spark.createDataFrame([(bytearray(book),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    discard(tokens)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files; ids: unsigned 32-bit little-endian."""
    book = bytes(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()["lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for frame in batch.column(0):
                keys, counts, before, ids = read_frame(frame.as_py(), book)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(counts)
                own = [raw[4 * int(e - n) : 4 * int(e)] for e, n in zip(ends, counts, strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(before + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([bytes(x) for x in own], pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    frames = spark.read.schema("start long, n_docs int, n_ids long, frame binary").parquet(f"{path}/frames")
    return map_arrow(frames.select("frame"), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
