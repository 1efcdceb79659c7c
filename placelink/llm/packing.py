"""Token ids as fixed-width bit-packed binary files with block offsets.

A file holds ``header | packed blocks | index | trailer``.  Each id takes the
least bits that hold the vocabulary; a block holds ``block`` ids (the last one
fewer), its offset is in the index, so any range of ids is read by seeking to
its blocks and unpacking them with numpy.  The index also lists the documents
of the file in order, with their numbers of ids.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.llm.common import open_store, prepare, shared_path, table

MAGIC = b"PLBITS1\n"
HEADER = struct.Struct("<8sBI")  # magic, bits of an id, ids of a block
TRAILER = struct.Struct("<QQQ8s")  # offset of the index, ids, documents, magic
BLOCK = 8_192
#: Entries of a generation of a worker's cache of encoded pieces of words.
PARTS = 200_000
#: Code points of a slice of a long text; short texts are encoded together up to four times as many bytes.
SLICE = 1 << 20
_BLANK = re.compile("[ \t\n\r\v\f]+")


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` one after another, ``bits`` each, least significant bit first."""
    ids = np.asarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(lanes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    lanes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = lanes
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(n)


class Writer:
    """Packs ids into an open binary file; memory holds one block and the index."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.offsets: list[int] = [HEADER.size]
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        out.write(HEADER.pack(MAGIC, bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(np.asarray(ids, "<u4"))
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= 64 * self.block:
            self._flush(whole_only=True)

    def _flush(self, whole_only: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) - len(ids) % self.block if whole_only else len(ids)
        for at in range(0, end, self.block):
            data = pack(ids[at : min(end, at + self.block)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole_only=False)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.offsets[-1], self.n_ids, len(self.docs), MAGIC))


class Reader:
    """Random access to a packed file; only asked blocks are read."""

    def __init__(self, file, size: int):
        self.file = file
        magic, self.bits, self.block = HEADER.unpack(self._at(0, HEADER.size))
        index, self.n_ids, self.n_docs, end = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a packed token file")
        blocks = -(-self.n_ids // self.block)
        at = index + 8 * (blocks + 1)
        self.offsets = np.frombuffer(self._at(index, 8 * (blocks + 1)), "<u8")
        missing = np.frombuffer(self._at(at, self.n_docs), np.uint8)
        docs = np.frombuffer(self._at(at + self.n_docs, 8 * self.n_docs), "<i8").tolist()
        self.doc_ids = [None if m else d for m, d in zip(missing, docs, strict=True)]
        self.counts = np.frombuffer(self._at(at + 9 * self.n_docs, 8 * self.n_docs), "<u8").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the file."""
        if not n:
            return np.zeros(0, "<u4")
        a, b = first // self.block, (first + n - 1) // self.block
        data = self._at(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        base, parts = int(self.offsets[a]), []
        for k in range(a, b + 1):
            held = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, held))
        return np.concatenate(parts)[first - a * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.counts[k]))


#: The rule under which a text's ids are its words' ids: what is no white space is kept in runs and nothing looks beyond it.
_RULE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def words_apart(told: dict) -> bool:
    """Whether a tokenizer file encodes what stands between ASCII white space word by word."""
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].split() == [t["content"]] for t in told.get("added_tokens") or [])
    return added and not told.get("truncation") and not told.get("padding") and all(told.get(k) == v for k, v in _RULE.items())


#: Words with other characters than these, or with what may be a special token, go to the library.
_ODD = "[^!-~¡-©«-±´¶-¸»¿-ÿ]|<\\|"
_PIECES = re.compile("\n|'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\n0-9a-zß-öø-ÿ]+")
#: Stands for the end of a word among packed ids.
_END = b"\xff\xff\xff\xff"


class WordEncoder:
    """The tokenizers library on whole texts; each distinct word of a slice of texts is encoded once.

    Arrow splits the texts at ASCII white space and numbers the words, and
    numpy gathers the ids of the distinct ones into those of the texts.  Words
    of common Latin characters are split by ``_RULE`` here, all in one pass,
    and their pieces merged by the tokenizer's model, unless they are cached;
    all others go to the tokenizer.  Where the tokenizer file has another rule
    the library gets the texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.apart = words_apart(json.load(file))
        self.young: dict[str, bytes] = {"\n": _END}
        self.old: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.letters = {b: b if b in printable else next(spare) for b in range(256)}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _part(self, part: str) -> bytes:
        """The packed ids of a piece; the cache forgets what was not asked for while ``PARTS`` others came."""
        found = self.young.get(part) or self.old.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if len(part) <= 64:
            if len(self.young) >= PARTS:
                self.old, self.young = self.young, {"\n": _END}
            self.young[part] = found
        return found

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that ``_RULE`` splits here, and how many each one has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        pieces = _PIECES.findall(joined.lower())
        held = list(map(self.young.get, pieces))
        for k, found in enumerate(held):
            if found is None:
                held[k] = self._part(pieces[k])
        ids = np.frombuffer(b"".join([*held, _END]), np.uint32)
        ends = np.flatnonzero(ids == 0xFFFFFFFF)
        return ids[ids != 0xFFFFFFFF], np.diff(ends, prepend=-1) - 1

    def _others(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that go to the library."""
        ids, n = array("I"), []
        for at in range(0, len(words), 1_024):  # an encoding holds far more than its ids
            for made in self.tokenizer.encode_batch_fast(words[at : at + 1_024].to_pylist(), add_special_tokens=False):
                ids.extend(made.ids)
                n.append(len(made.ids))
        return np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), np.array(n, np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each one's end."""
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        held = split.flatten().dictionary_encode()
        odd = pc.match_substring_regex(held.dictionary, _ODD)
        plain, others = self._plain(held.dictionary.filter(pc.invert(odd))), self._others(held.dictionary.filter(odd))
        ids = np.concatenate([plain[0], others[0]])
        odd = odd.to_numpy(zero_copy_only=False)
        width, first = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
        width[~odd], width[odd] = plain[1], others[1]
        first[~odd], first[odd] = np.cumsum(plain[1]) - plain[1], len(plain[0]) + np.cumsum(others[1]) - others[1]
        at = held.indices.to_numpy()
        last = np.concatenate([[0], np.cumsum(width[at])])
        spot = np.arange(last[-1]) + np.repeat(first[at] - last[:-1], width[at])
        return ids[spot], last[ends[1:] - ends[0]]

    def _long(self, text: str) -> np.ndarray:
        """Ids of one text, cut at white space into slices."""
        parts, at = [], 0
        while at < len(text):
            cut = _BLANK.search(text, at + SLICE)
            end = cut.end() if cut else len(text)
            parts.append(self._slice(pa.array([text[at:end]], pa.string()))[0])
            at = end
        return np.concatenate(parts)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each of ``texts``, none of them null."""
        if not self.apart:
            for text in texts:
                yield np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
            return
        size = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(texts):
            end, held = at + 1, int(size[at])
            if held > 4 * SLICE:
                yield self._long(texts[at].as_py())
            else:
                while end < len(texts) and held + int(size[end]) <= 4 * SLICE:
                    held += int(size[end])
                    end += 1
                ids, ends = self._slice(texts.slice(at, end - at))
                yield from np.split(ids, ends[:-1])
            at = end


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(df: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode every whole text and write packed files into ``folder``.

    Returns the manifest ``(shard, uri, n_docs, n_ids, first_id)``, one row a
    file; files in order of ``shard`` hold the documents in ascending id (null
    first, ties by text).  Each attempt of a task writes a file of its own name;
    the manifest lists those of the attempts that were committed, so nothing is
    renamed or replaced and what a lost attempt left is never read.  A null
    text counts as empty: only its end id is written.
    """
    spark = df.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    open_store(folder)[0].create_dir(open_store(folder)[1], recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, writer = TaskContext.get(), None
        encode = word_encoder(path)
        fs, at = open_store(folder)
        name = f"shard-{task.partitionId():07d}-{task.taskAttemptId()}.bin"
        for batch in batches:
            if writer is None:
                out = fs.open_output_stream(f"{at}/{name}")
                writer = Writer(out, bits_for(max(encode.vocabulary, end_id + 1)), block)
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                writer.add(doc, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "uri": [f"{folder}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    manifest = table(dealt.mapInArrow(store, "shard int, uri string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, from the files."""
    return _scan(manifest, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids: ids.tolist())


def checksums(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    return _scan(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _scan(manifest: DataFrame, schema: str, made) -> DataFrame:
    spark = manifest.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = schema.rsplit(", ", 1)[1].split(" ")[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_store(row["uri"])
                with fs.open_input_file(at) as file:
                    held = Reader(file, file.size())
                    for k in range(0, held.n_docs, 256):
                        span = range(k, min(held.n_docs, k + 256))
                        ids = held.ids(int(held.starts[k]), int(held.starts[span[-1] + 1] - held.starts[k]))
                        base = int(held.starts[k])
                        own = [made(ids[int(held.starts[j]) - base : int(held.starts[j + 1]) - base]) for j in span]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([held.doc_ids[j] for j in span], pa.int64()), "start": pa.array([int(held.starts[j]) + row["first_id"] for j in span], pa.int64()), "n_tokens": pa.array([int(held.counts[j]) for j in span], pa.int64()), last: pa.array(own, pa.list_(pa.int64()) if "array" in schema else pa.int64())})

    return manifest.select("shard", "uri", "first_id").repartition(n, "shard").mapInArrow(scan, schema)


def round_trip(df: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the packed files of ``df`` into the shared folder and read them back."""
    return checksums(write(df, path, end_id, shared_path(df.sparkSession, "packed")))
