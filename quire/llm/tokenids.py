"""Token ids as fixed-width bits: written in id order by Spark, read back at any place.

Rows are dealt by range of their ids, tokenised where they land, and packed into files of about SEGMENT
ids, each whole documents and at least one. Spark's text writer carries a file as its single line, whose
end is the last byte, so files are committed as any of Spark's output and can lie in any store it knows.

A file is little-endian: MAGIC; the bits of an id, the ids of a block, the number of blocks, of documents and
of ids, the part and the number of ids before it in that part (uint64 each); the offset of each block from
the first (uint64); the first id's number of each document in the file (uint64), its doc_id (int64) and
whether that is null (uint8); the blocks, each from a byte's start; one line end. An id takes the
least bits that hold the vocabulary, the lowest first.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, discard, scratch_path

MAGIC = b"QTIDS\x00\x00\x01"
HEAD = struct.Struct("<7Q")
#: Ids of a file, about, and of a block; pieces that a task remembers; bytes of text that are taken at once, and characters that the tokenizer is given at once.
SEGMENT, BLOCK, REMEMBERED, AT_ONCE, GIVEN = 8 << 20, 4096, 1 << 20, 2 << 20, 1 << 18
END = 0
#: What some rule counts as white space, or joins to what stands beside it. A single space between other characters starts a byte-level word, whatever surrounds it.
SPACE = r"\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2060\ufeff"
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
INSIDE = re.compile(f"[^{SPACE}]+")
#: Letters, digits, signs and line ends that byte-level words never mix.
RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-鿿가-힣]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: the printable ones stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


LETTERS = _byte_letters()
SPACED = LETTERS[32]


def vocabulary_path() -> str:
    """The default vocabulary's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a tokenizer, which sees each distinct piece once.

    Texts are cut before single spaces inside them, where byte-level words start anew whatever
    surrounds them; the pieces' ids are remembered, up to REMEMBERED pieces. Of a new piece, runs of
    letters, digits or signs are words, which go to the tokenizer's model; a piece with anything else goes to the tokenizer
    whole. Texts for a tokenizer of another kind are not cut.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        kind = json.loads(definition)
        words = kind.get("pre_tokenizer") or {}
        self.cuts = kind.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.added = re.compile("|".join(re.escape(x["content"]) for x in kind.get("added_tokens", [])) or "(?!)")
        self._forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        # what the tokenizer returns takes over a hundred bytes an id, so it is given few texts at once
        ends = itertools.accumulate(map(len, texts))
        groups = itertools.groupby(zip(texts, ends, strict=True), key=lambda x: x[1] // GIVEN)
        return [np.array(e.ids, "<u4") for _, some in groups for e in self.tokenizer.encode_batch([t for t, _ in some], add_special_tokens=False)]

    def _forget(self) -> None:
        #: Packed ids of a field that follows a space, of any other piece, and of a word.
        self.fields = Fields(self)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encoded(self, word: str) -> bytes:
        """By the tokenizer's model: printable ASCII stands for itself in a byte-level vocabulary."""
        letters = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after_space(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.model.tokenize(SPACED + letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is None:
            known = self.words[word] = self._encoded(word)
        return known

    def field(self, field: str) -> bytes | None:
        """Ids of a field that can be cut off at its spaces, to be remembered; None for any other, and for one that the tokenizer is to be given."""
        if field.isascii() and field.isalpha() and not self.added.search(field):
            return self._after_space(field)
        if not field or not INSIDE.match(field[0]) or not INSIDE.match(field[-1]):
            return None
        runs = RUN.findall(field)
        if sum(map(len, runs)) != len(field) or "\n\n" in field or self.added.search(field):
            self.whole.add(field)
            return None
        first = runs[0]
        if len(runs) == 1:
            return self._after_space(field)
        if (known := self.fields.get(first)) is None:  # a field by itself as well
            known = self.fields[first] = self._after_space(first)
        return b"".join([known, *map(self._word, runs[1:])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return self._ids(texts)
        if len(self.fields) + len(self.pieces) + len(self.words) > REMEMBERED:
            self._forget()
        self.whole: set[str] = set()
        known = self.fields
        firsts, out = [], []
        for text in texts:
            first, *fields = text.split(" ")
            firsts.append(first)
            out.append(list(map(known.__getitem__, fields)))
        whole = list(self.whole)
        for field, ids in zip(whole, self._ids([f" {f}" for f in whole]), strict=True):
            known[field] = ids.tobytes()
        loose: dict[str, None] = {}
        for k, (text, first, found) in enumerate(zip(texts, firsts, out, strict=True)):
            if found and (None in found or not first or not INSIDE.match(first[-1])):
                fields = text.split(" ")
                found[:] = [x if x is not None else known.get(f) for f, x in zip(fields[1:], found, strict=True)]
                if None in found or not first or not INSIDE.match(first[-1]):
                    first, *others = CUT.split(text)
                    found[:] = [x if (x := known.get(p)) is not None else f" {p}" for p in others]
                    loose.update((x, None) for x in found if isinstance(x, str))
                    firsts[k] = first
            loose[first] = None
        unseen = [p for p in loose if p not in self.pieces]
        for piece, ids in zip(unseen, self._ids(unseen), strict=True):
            self.pieces[piece] = ids.tobytes()
        pieces = self.pieces
        for first, found in zip(firsts, out, strict=True):
            if str in set(map(type, found)):
                found[:] = [x if type(x) is bytes else pieces[x] for x in found]
        return [np.frombuffer(b"".join([pieces[first], *found]), "<u4") for first, found in zip(firsts, out, strict=True)]


class Fields(dict):
    """Packed ids of the fields that an encoder remembers; it is asked for those that are missing."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.ask = encoder.field

    def __missing__(self, field: str) -> bytes | None:
        if (known := self.ask(field)) is not None:
            self[field] = known
        return known


@functools.cache
def _encoder(definition: str) -> Encoder:
    """One a worker process, so that what it learned serves its later tasks."""
    return Encoder(definition)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, the lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & 1
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8, -(-count * bits // 8)), bitorder="little")[: count * bits].reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def head_of(data: bytes) -> tuple[int, ...]:
    """(bits, ids of a block, blocks, documents, ids, part, ids before it in the part) of a file."""
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + HEAD.size:
        raise ValueError("not a file of token ids")
    return HEAD.unpack_from(data, len(MAGIC))


def build(names: list[int | None], ids: list[np.ndarray], bits: int, part: int, before: int, block: int = BLOCK) -> bytes:
    """A file's bytes, its line end aside, of documents with their ids."""
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    blocks = [pack(flat[at : at + block], bits) for at in range(0, len(flat), block)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1]
    firsts = np.cumsum([0, *map(len, ids)])[:-1]
    head = HEAD.pack(bits, block, len(blocks), len(names), len(flat), part, before)
    numbers = np.array([0 if n is None else n for n in names], "<i8"), np.array([n is None for n in names], np.uint8)
    return b"".join([MAGIC, head, offsets.astype("<u8").tobytes(), firsts.astype("<u8").tobytes(), *(x.tobytes() for x in numbers), *blocks])


class TokenFile:
    """A file's documents, and any stretch of its ids, of which only the blocks that hold it are unpacked."""

    def __init__(self, data: bytes):
        self.bits, self.block, blocks, docs, self.n_ids, self.part, self.before = head_of(data)
        self.data = memoryview(data)
        at = len(MAGIC) + HEAD.size
        sizes = [blocks * 8, docs * 8, docs * 8, docs]
        places = list(itertools.accumulate(sizes, initial=at))
        if len(data) < places[-1]:
            raise ValueError("a file of token ids is cut short")
        self.offsets, firsts, names = (np.frombuffer(data, t, n // 8, p) for t, n, p in zip(("<u8", "<u8", "<i8"), sizes, places, strict=False))
        none = np.frombuffer(data, np.uint8, docs, places[3])
        self.body = places[4]
        self.names = [None if gone else name for name, gone in zip(names.tolist(), none.tolist(), strict=True)]
        self.firsts = [*firsts.tolist(), self.n_ids]
        last = self.n_ids - (blocks - 1) * self.block if blocks else 0
        end = self.body + (int(self.offsets[-1]) + -(-last * self.bits // 8) if blocks else 0)
        if len(data) < end or data[end:] not in (b"", b"\n"):
            raise ValueError("a file of token ids is cut short or goes on after its end")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from number start to before stop."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"ids {start} to {stop} of {self.n_ids}")
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            first = b * self.block
            whole = unpack(self.data[self.body + int(self.offsets[b]) :], self.bits, min(self.block, self.n_ids - first))
            out.append(whole[max(start - first, 0) : stop - first])
        return np.concatenate([*out, np.zeros(0, np.uint32)])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, number of the first id in the file, ids) of each document."""
        for name, start, stop in zip(self.names, self.firsts, self.firsts[1:], strict=False):
            yield name, start, self.ids(start, stop)


def _batches(rows: Iterator[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_token_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end: int | None = END, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Write the token ids of docs(doc_id, text) to path, in ascending doc_id order.

    vocabulary is a file of the tokenizers library that the driver reads; special tokens that a text spells out
    get their ids, as by the library's default, and none are added. end follows each document,
    None for nothing. A null text is empty; a null doc_id comes first; rows of one doc_id follow each
    other, dealt out by a hash of their texts, so that they may fill many files. A document's ids are held whole by its task.
    """
    from tokenizers import Tokenizer

    with open(vocabulary or vocabulary_path(), encoding="utf-8") as file:
        definition = file.read()
    bits = max(1, (Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True) - 1).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary, whatever the documents

    def run(batches):
        encoder, part, before = _encoder(shared.value), TaskContext.get().partitionId(), 0
        names, held, size = [], [], 0
        last = np.array([] if end is None else [end], np.uint32)

        def body():
            return pa.RecordBatch.from_arrays([pa.array([build(names, held, bits, part, before, block)], pa.binary())], ["body"])

        rows = ((n, t or "") for batch in batches for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for some in _batches(rows):
            for (name, _), ids in zip(some, encoder.encode([t for _, t in some]), strict=True):
                if names and size + len(ids) + len(last) > segment:
                    yield body()
                    before += size
                    names, held, size = [], [], 0
                names.append(name)
                held.append(np.concatenate([ids, last]))
                size += len(held[-1])
        if names:
            yield body()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text")
    bodies = dealt.mapInArrow(run, "body binary")
    bodies.select(F.col("body").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids_crc32, and ids on demand) of each document, from the files below path.

    start counts the ids before it in its part. A file is held whole by its task.
    """
    kinds = [("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = "doc_id long, part long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if not data:
                    continue
                file = TokenFile(data)
                documents = file.documents()
                while some := list(itertools.islice(documents, 1000)):
                    rows = [(n, file.part, file.before + s, len(i), zlib.crc32(i.astype("<u4").tobytes()), *([i.astype(np.int64)] * with_ids)) for n, s, i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, before, n_ids) of each file below path, written beside them once and read after that."""
    place = f"{path}/_index"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    schema = "file string, part long, before long, n_ids long"

    def run(batches):
        for batch in batches:
            heads = [head_of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([h[i] for h in heads], pa.int64()) for i in (5, 6, 4))], ["file", "part", "before", "n_ids"])

    if not done.getFileSystem(conf).exists(done):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
        heads = files.select("path", F.substring("content", 1, len(MAGIC) + HEAD.size).alias("head"))
        heads.mapInArrow(run, schema).write.mode("overwrite").parquet(place)
    return spark.read.schema(schema).parquet(place)


def _starts(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ids before each part, of (part, ids)."""
    parts = sorted(counts)
    return [(part, before) for (part, _), before in zip(parts, itertools.accumulate((n for _, n in parts), initial=0), strict=False)]


def read_stretch(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids number start to before stop of all files. By the index, only the files that hold them are opened."""
    index = index_files(spark, path)
    # as many numbers as Spark had partitions
    parts = _starts([(r.part, r.n) for r in index.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()])
    place = F.col("begins") + F.col("before")
    found = index.join(F.broadcast(spark.createDataFrame(parts, "part long, begins long")), "part").filter((place < stop) & (place + F.col("n_ids") > start))
    out = [np.zeros(0, np.uint32)]
    for r in found.select("file", place.alias("at"), "n_ids").orderBy("at").collect():  # as many as hold the stretch
        data = spark.read.format("binaryFile").load(r.file).select("content").first()[0]
        out.append(TokenFile(bytes(data)).ids(max(start - r.at, 0), min(stop - r.at, r.n_ids)))
    return np.concatenate(out)


def round_trip(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write the token ids of docs(doc_id, text), read them back, and tell each document's place.

    A row for each row of docs, repeated ones and those of a null doc_id or text included; see write_token_ids.
    Other columns are ignored, and an empty table gives an empty result. The files stay if a path is given.
    """
    spark, own = docs.sparkSession, path is None
    path = path or scratch_path(spark, "tokens")
    write_token_ids(docs, path, vocabulary)
    described = cut(read_token_ids(spark, path))
    if own:
        discard(spark, path)
    # as many numbers as Spark had partitions
    offsets = _starts([(r.part, r.n) for r in described.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()])
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    return described.join(starts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
