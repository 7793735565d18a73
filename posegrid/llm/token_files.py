"""Token-id files with Elias-Fano coded document boundaries.

A data set is a folder of files in ascending id order; a file is a run of blocks; a block holds
whole documents:

    header  "EFTK", u16 version, u16 bytes per id, u64 documents, u64 ids, i64 first document id,
            u8 flags (1: the document ids are null), u8 low bits of the boundaries, u8 low bits of the document ids
    low and high bits, select samples of the boundaries (documents + 1 values)
    low and high bits, select samples of the document ids less the first
    the ids of all documents, little endian, 2 or 4 bytes each
    one line feed (the row separator of Spark's committed text writer)

Boundaries and document ids cost about two bits more than log2(range / documents) each; no table
of 64-bit offsets exists on disk. ``select(i)`` starts at the sample of every 256th set bit, and so
does ``select_range``, by which readers take the boundaries run by run.

Documents are shuffled by ranges of their id and of their text's first bytes, so that files are in
id order and an id of many rows is not one range; they are tokenised as a stream; a block is closed
at ``block_ids`` ids. The number of ranges follows the bytes of text up to MOST_RANGES, so that the
sample that finds their bounds stays small; files are read whole, so a range's blocks are cut into
files of FILE_BLOCKS blocks. Blocks leave Spark as strings through its text writer, which writes the
bytes of a string as they are, valid UTF-8 or not; reading checks every block's magic and length.

Defined results
  * null text is empty; an empty text has the end id alone;
  * rows that repeat an id are kept, in the order of their text; null ids come last;
  * no documents give a folder without blocks and an empty result;
  * texts of any length are encoded whole; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posegrid.llm._common import bounded

MAGIC = b"EFTK"
HEADER = struct.Struct("<4sHHQQqBBB")
SAMPLE = 256
MOST_RANGES = 20_000
FILE_BLOCKS = 16


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``top``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def low_width(n: int, top: int) -> int:
        return max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)

    @staticmethod
    def sizes(n: int, low_bits: int, top: int) -> tuple[int, int, int]:
        """Bytes of low bits, high bits and samples."""
        return (n * low_bits + 7) // 8, (n + (top >> low_bits) + 8) // 8, 4 * ((n + SAMPLE - 1) // SAMPLE)

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> "EliasFano":
        n = len(values)
        values = values.astype(np.uint64)
        width = cls.low_width(n, top)
        sizes = cls.sizes(n, width, top)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(sizes[1] * 8, np.uint8)
        unary[ones] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombuffer(cls, data, at: int, n: int, low_bits: int, top: int) -> tuple["EliasFano", int]:
        a, b, c = cls.sizes(n, low_bits, top)
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + c

    def _low(self, i: int) -> int:
        start, end = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[start // 8 : (end + 7) // 8].tobytes(), "little")
        return (part >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        seen = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        seen[: at % 8] = 0
        while left >= (ones := int(seen.sum())):
            left -= ones
            byte += 1
            seen = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        at = byte * 8 + int(np.flatnonzero(seen)[left])
        return ((at - i) << self.low_bits) | (self._low(i) if self.low_bits else 0)

    def select_range(self, start: int, stop: int) -> np.ndarray:
        """The values from the ``start``-th to before the ``stop``-th: only the samples around them are decoded."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.int64)
        k, after = start // SAMPLE, -(-stop // SAMPLE)
        first = int(self.samples[k]) // 8
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[first:end], bitorder="little")
        bits[: int(self.samples[k]) - first * 8] = 0
        ones = np.flatnonzero(bits)[start - k * SAMPLE : stop - k * SAMPLE] + first * 8
        out = (ones - np.arange(start, stop)) << self.low_bits
        if self.low_bits:
            at = start * self.low_bits
            low = np.unpackbits(self.low[at // 8 : (stop * self.low_bits + 7) // 8], bitorder="little")[at % 8 :]
            low = low[: (stop - start) * self.low_bits].reshape(stop - start, self.low_bits)
            out |= low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def values(self) -> np.ndarray:
        return self.select_range(0, self.n)


def pack_block(ids: list[int | None], docs: list[np.ndarray], width: int) -> bytes:
    """One block of whole documents; the ids are ascending, all given or all null."""
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    null = ids[0] is None
    first = 0 if null else int(ids[0])
    names = np.zeros(len(docs), np.uint64) if null else np.array([i - first for i in ids], np.uint64)
    total, span = int(ends[-1]), int(names[-1])
    bounds, keys = EliasFano.encode(ends, total), EliasFano.encode(names, span)
    head = HEADER.pack(MAGIC, 1, width, len(docs), total, first, int(null), bounds.low_bits, keys.low_bits)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    # the span of the document ids is needed to size their high bits
    return head + struct.pack("<Q", span) + bounds.tobytes() + keys.tobytes() + flat.astype(f"<u{width}").tobytes()


class Block:
    """A block in a buffer: ``doc_id(i)``, ``offset(i)`` and ``ids(i)`` reach one document each."""

    def __init__(self, data, at: int):
        magic, version, self.width, self.n, self.total, self.first, flags, low, key_low = HEADER.unpack_from(data, at)
        if magic != MAGIC or version != 1:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        (span,) = struct.unpack_from("<Q", data, at)
        self.null = bool(flags & 1)
        self.bounds, at = EliasFano.frombuffer(data, at + 8, self.n + 1, low, self.total)
        self.keys, at = EliasFano.frombuffer(data, at, self.n, key_low, span)
        self.flat = np.frombuffer(data, f"<u{self.width}", self.total, at)
        self.end = at + self.total * self.width + 1

    def doc_id(self, i: int) -> int | None:
        return None if self.null else self.first + self.keys.select(i)

    def offset(self, i: int) -> int:
        return self.bounds.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.offset(i) : self.offset(i + 1)]

    def runs(self, documents: int = 16 * SAMPLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document ids less the first, boundaries with the end) of runs of documents."""
        for i in range(0, self.n, documents):
            end = min(self.n, i + documents)
            yield self.keys.select_range(i, end), self.bounds.select_range(i, end + 1)


def blocks(data) -> Iterator[Block]:
    at = 0
    while at < len(data):
        block = Block(data, at)
        yield block
        at = block.end


#: Pieces begin at these characters; a line feed is a piece of its own.
CUTS = (" ", ",", ".", "\n")


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer, each distinct piece of text once.

    A text is cut before spaces, commas, full stops and line feeds, and after line feeds.
    Byte-level pre-tokenisation cuts there too, unless white space meets white space or a comma or
    full stop follows something that is no letter or digit; a text with such a place is encoded as
    a whole. Pieces are remembered up to ``limit`` of them; then those that came again just now are
    kept and the others forgotten.
    """

    def __init__(self, path: str, limit: int = 600_000, width: int = 4):
        from tokenizers import Tokenizer

        self.width, self.kind = width, f"<u{width}"
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.opens[i] = word.startswith("Ġ")  # the byte-level sign of a space
        if (len(self.opens) - 1) >> (8 * width):
            raise ValueError(f"the vocabulary's ids need more than {width} bytes")
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes() if text else b""

    def _learn(self, new: list[str]) -> None:
        spaced = [p for p in new if p[:1] == " " and not p[1:2].isspace()]
        for i in range(0, len(spaced), 2000):
            part = spaced[i : i + 2000]
            (found,) = self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids, size = np.array(found.ids, self.kind), self.width
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):  # not a token that opens with a space for each piece
                self.known.update((p, self.whole(p)) for p in part)
                continue
            raw, ends = ids.tobytes(), [*(starts[1:] * size).tolist(), len(ids) * size]
            self.known.update(zip(part, (raw[a:b] for a, b in zip((starts * size).tolist(), ends, strict=True)), strict=True))
        other = [p for p in new if p not in self.known]
        for i in range(0, len(other), 2000):
            part = other[i : i + 2000]
            found = self.tok.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((p, np.array(f.ids, self.kind).tobytes()) for p, f in zip(part, found, strict=True))

    @staticmethod
    def _kinds(pieces, start: int, stop: int | None) -> np.ndarray:
        """Of each piece's first or last character: 1 white space, 2 comma or full stop, 4 letter or digit."""
        import pyarrow.compute as pc

        chars = pc.utf8_slice_codeunits(pieces, start, stop).dictionary_encode()
        kinds = [1 * c.isspace() + 2 * (c in (",", ".")) + 4 * c.isalnum() for c in chars.dictionary.to_pylist()]
        return np.array(kinds, np.int8)[chars.indices.to_numpy()]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow array, and where each text's ids end. Null is empty."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        marked = texts
        for c in CUTS:
            marked = pc.replace_substring(marked, c, "\0" + c + "\0" * (c == "\n"))
        cut = pc.split_pattern(marked, "\0")
        bounds = cut.offsets.to_numpy()
        bounds = bounds - bounds[0]
        pieces = cut.flatten().dictionary_encode()
        codes, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        known = self.known
        new = [p for p in distinct if p not in known]
        if len(known) + len(new) > self.limit:
            self.known = known = {p: known[p] for p in distinct if p in known}
        self._learn(new)
        units = list(map(known.__getitem__, distinct))
        size = np.fromiter(map(len, units), np.int32, len(units)) // self.width
        begins, closes = self._kinds(pieces.dictionary, 0, 1), self._kinds(pieces.dictionary, -1, None)
        bad = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        bad = bad | self._odd(codes, bounds, size, begins, closes)
        if bad.any():
            # such a text is one unit: its first piece stands for all of it
            codes = codes.copy()
            codes[np.repeat(bad, np.diff(bounds))] = len(units)
            which = np.flatnonzero(bad)
            codes[bounds[which]] = len(units) + 1 + np.arange(len(which))
            units = [*units, b"", *(self.whole(texts[int(i)].as_py()) for i in which)]
            size = np.fromiter(map(len, units), np.int32, len(units)) // self.width
        start = np.cumsum(size, dtype=np.int32) - size
        flat = np.frombuffer(b"".join(units), self.kind)
        n = size[codes]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(start[codes] - ends + n, n)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], ends[bounds[1:] - 1] if len(texts) else ends

    @staticmethod
    def _odd(codes, bounds, size, begins, closes) -> np.ndarray:
        """Which texts have a cut that pre-tokenisation would not make."""
        # only a piece that begins with a comma, a full stop or white space beside white space can be odd;
        # an empty piece stands between two cuts at one place, so the piece before the last full one counts
        there = np.flatnonzero((size > 0)[codes])
        x, y = codes[there[:-1]], codes[there[1:]]
        left, right = closes[x], begins[y]
        odd = there[1:][((left == 1) & (right == 1)) | ((right == 2) & (left != 4))]
        owner = np.searchsorted(bounds, odd, side="right") - 1
        out = np.zeros(len(bounds) - 1, bool)
        # the piece before may belong to the text before
        first = np.searchsorted(there, bounds[owner])
        out[owner[there[np.minimum(first, len(there) - 1)] != odd]] = True
        return out


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, width: int) -> PieceEncoder:
    """One for each Python worker."""
    if (path, width) not in _encoders:
        _encoders[path, width] = PieceEncoder(path, width=width)
    return _encoders[path, width]


def chunks(batches, text_bytes: int = 4 << 20):
    """Slices of Arrow batches of (id, text) with about ``text_bytes`` of text."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 50)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + text_bytes)))
            yield batch.slice(at, end - at)
            at = end


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    width: int = 2, block_ids: int = 1 << 20, file_bytes: int = 64 << 20,
) -> None:
    """Encode the documents and write them below ``path``. ``width``: 2 if all ids are below 65,536."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, min(MOST_RANGES, -(-size // file_bytes)), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer, width)
        tail = np.array([end_id], enc.kind)
        ids, parts, held = [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([pack_block(ids, parts, width)], pa.binary())], names=["block"])

        for some in chunks(batches):
            flat, ends = enc.encode(some.column(1))
            before = 0
            for i, end in zip(some.column(0).to_pylist(), ends.tolist(), strict=True):
                if ids and (held >= block_ids or (i is None) != (ids[-1] is None)):
                    yield close()
                    ids, parts, held = [], [], 0
                ids.append(i)
                parts.append(np.append(flat[before:end], tail))
                held += end - before + 1
                before = end
        if ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    first = F.substring(F.col("text").cast("binary"), 1, 16)  # sorts as texts do; a sample of it goes to the driver
    placed = docs.repartitionByRange(int(n), order[0], first).sortWithinPartitions(*order)
    placed.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids), file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, before = memoryview(content.as_buffer()), 0
                for block in blocks(data):
                    for names, ends in block.runs():
                        raw = memoryview(block.flat[ends[0] : ends[-1]].astype("<u4").tobytes())
                        at = ((ends - ends[0]) * 4).tolist()
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                        n = len(names)
                        ids = pa.nulls(n, pa.int64()) if block.null else pa.array(names + block.first, pa.int64())
                        cols = [ids, pa.array(ends[:-1] + before, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array([name.as_py()] * n, pa.string())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])
                    before += block.total

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def with_global_start(found: DataFrame) -> DataFrame:
    """``start`` counted over all files. ``found``: a written result of ``read``. One window orders the files, a short row each."""
    part = F.struct(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)", 1).cast("long"))
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("before"))
    return found.join(bounded(files), "file").withColumn("start", F.expr("start + before")).drop("before", "file")
