"""Token ids as Arrow IPC files of equal-length sequences.

Documents are put in ascending order of doc_id, dealt to shards of neighbouring ids, tokenized and followed by an end id. Each
shard becomes one Arrow file whose rows are sequences of ``seq_len`` ids (fixed-size list of the narrowest unsigned type
that holds the vocabulary), a mask (fixed-size list of booleans, false on the padding that ends a shard) and the
documents that end in the sequence with their end places. Files are written under a temporary name and renamed; a manifest
names those that count, with their SHA-1, and readers go by it, so a task that runs twice does no harm. ``TokenFile`` maps a file into memory:
a sequence is a view of it, found by its number alone.

Nulls and odd rows: a null text is an empty one and holds the end id only; null ids come first; rows of one id are ordered by
a hash of their text, repeated rows are written as often as they occur; an empty table gives no file. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Hashed, range_bounds, range_shard, read_committed, shuffle_partitions


@dataclass(frozen=True)
class TokenParams:
    """tokenizer: path of a tokenizer file, readable on every executor; shard_bytes: text in a shard."""

    tokenizer: str
    seq_len: int = 2048
    end_id: int = 1
    shard_bytes: int = 32 << 20


#: White space on which Python and the tokenizers' patterns may disagree.
_UNUSUAL = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Beyond these characters (ASCII, Latin, basic Greek and Cyrillic, common punctuation) Unicode versions, composition or context may decide.
_ODD = re.compile("[^\x00-\x7f\xa1-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03a9\u03ac-\u03ce\u0400-\u0481\u2013\u2014\u2018-\u201d\u2026\u20ac]")


def _word_pattern(spec: dict) -> str | None:
    """The pattern that cuts a tokenizer file's text into words, if the file says that a word's ids depend on the word alone:
    composed, white space made one space, lower-cased; words are the matches of a pattern, written byte by byte, and byte
    pairs are merged inside a word. None for any other tokenizer."""
    plain = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    found = cuts[0].get("pattern", {}).get("Regex")
    by_match = len(cuts) == 2 and cuts[0] == {"type": "Split", "pattern": {"Regex": found}, "behavior": "Removed", "invert": True}
    by_byte = cuts[-1].get("type") == "ByteLevel" and not cuts[-1].get("add_prefix_space") and cuts[-1].get("use_regex") is False
    exact = all(not t.get(x) for t in spec.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip", "normalized"))
    merges = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
    return found if (spec.get("normalizer") or {}).get("normalizers") == plain and by_match and by_byte and exact and merges else None


class _Recent(dict):
    """Remembers ``make(key)``: of up to 2 ``limit`` keys, those that were asked for lately."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class _Encoder:
    """Texts to ids of the narrowest type, each text followed by the end id.

    If ``_word_pattern`` knows the tokenizer's steps, a group of texts is lower-cased and cut into words column-wise, and each
    distinct word goes to the model once; odd pieces and texts go to the whole tokenizer. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.type = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.code, self.model = "H" if self.type is np.uint16 else "I", self.whole.model
        self.pattern = _word_pattern(spec)
        self.cut = regex.compile(self.pattern).findall if self.pattern else None
        self.special = "|".join([_UNUSUAL, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])
        self.words = _Recent(self._word, 100_000)

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _odd(self, text: str) -> bytes:
        """Ids of a text that holds something odd."""
        if self.cut is None or re.search(self.special, text):
            return self._encode(text)
        return b"".join([self._encode(p) if _ODD.search(p) else b"".join(map(self.words.__getitem__, self.cut(p.lower()))) for p in text.split()])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces without white space, and how many each has. Each distinct word is looked up once."""
        quoted = pc.match_substring(pieces, "'")
        spaced = pc.replace_substring_regex(pieces, r"([^\s\p{L}\p{N}']+|\p{N})", r" \1 ")
        # whether an apostrophe begins a word is left to the pattern
        own = [" ".join(self.cut(x)) for x in pieces.filter(quoted).to_pylist()]
        words = pc.split_pattern(pc.replace_with_mask(spaced, quoted, pa.array(own, pa.string())), " ")
        coded = words.flatten().dictionary_encode()
        out, counts = _spread([self.words[w] if w else b"" for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(), self.type)
        upto = np.concatenate(([0], np.cumsum(counts)))
        return out, np.diff(upto[words.offsets.to_numpy()])

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has."""
        if self.cut is None:
            odd, plain = np.arange(len(texts)), pa.array([""] * len(texts))
        else:
            strange = pc.match_substring_regex(texts, f"{_ODD.pattern}|{self.special}")
            odd = np.flatnonzero(strange.to_numpy(zero_copy_only=False))
            plain = pc.utf8_lower(pc.if_else(strange, "", texts) if len(odd) else texts)
        cut = pc.ascii_split_whitespace(plain)
        coded = cut.flatten().dictionary_encode()
        found, sizes = self._pieces(coded.dictionary)
        ends = cut.offsets.to_numpy().astype(np.int64)[1:]
        # the ids of an odd text are one entry, the end id another
        more = [self._odd(texts[i].as_py()) for i in odd.tolist()] + [np.array([end_id], self.type).tobytes()]
        held = np.concatenate([found, np.frombuffer(b"".join(more), self.type)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, more), np.int64, len(more)) // held.itemsize])
        new = np.concatenate([len(coded.dictionary) + np.arange(len(odd)), np.full(len(ends), len(sizes) - 1)])
        entries = np.insert(coded.indices.to_numpy(), np.concatenate([ends[odd], ends]), new)
        out, each = _gather(held, sizes, entries)
        last = ends + np.arange(len(ends)) + np.searchsorted(odd, np.arange(len(ends)), side="right")
        return out, np.diff(np.cumsum(each)[last], prepend=0)


def _gather(held: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries' parts of ``held``, one after the other, and their sizes."""
    starts, each = np.cumsum(sizes) - sizes, sizes[entries]
    shift = starts[entries] - (np.cumsum(each) - each)
    return held[np.repeat(shift, each) + np.arange(each.sum())], each


def _spread(known: list[bytes], entries: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    held = np.frombuffer(b"".join(known), kind)
    return _gather(held, np.fromiter(map(len, known), np.int64, len(known)) // held.itemsize, entries)


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    """One for all tasks of a worker: what it remembers is worth most of the time."""
    return _Encoder(path)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


def _schema(p: TokenParams, kind) -> pa.Schema:
    ends = pa.list_(pa.struct([("doc_id", pa.int64()), ("end", pa.int32())]))
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), p.seq_len)), ("mask", pa.list_(pa.bool_(), p.seq_len)), ("ends", ends)])


class _Writer:
    """One shard's file; ``add`` documents in order, then ``close``."""

    ROWS = 256

    def __init__(self, root: str, shard: int, p: TokenParams, kind):
        self.p, self.kind, self.shard = p, np.dtype(kind), shard
        self.schema = _schema(p, kind).with_metadata({"shard": str(shard)})
        self.out = Hashed(root, f"tokens-{shard:07d}.arrow")
        self.ipc = pa.ipc.new_file(pa.PythonFile(self.out, mode="w"), self.schema)
        self.held, self.ends, self.written, self.docs, self.tokens = [], [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in order: all their ids, and how many each has."""
        self.docs += len(doc_ids)
        self.ends.append((doc_ids, self.tokens + np.cumsum(counts)))
        self.tokens += len(ids)
        self.held.append(ids)
        rows = sum(map(len, self.held)) // self.p.seq_len
        if rows >= self.ROWS:
            self._write(rows - rows % self.ROWS)

    def _write(self, rows: int) -> None:
        """The first rows of what is held, in batches of ROWS; a document ends in the sequence that holds its last id."""
        n, ids = self.p.seq_len, np.concatenate(self.held)
        names, ends = pa.chunked_array([d for d, _ in self.ends], pa.int64()).combine_chunks(), np.concatenate([e for _, e in self.ends])
        for at in range(0, rows, self.ROWS):
            count = min(self.ROWS, rows - at)
            own = ids[at * n : (at + count) * n]
            mask = np.arange(count * n) < len(own)
            first = self.written * n
            done = int(np.searchsorted(ends, first + len(own), side="right"))
            place = ends[:done] - 1 - first
            items = pa.StructArray.from_arrays([names[:done], pa.array((place % n + 1).astype(np.int32))], names=["doc_id", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(place // n, np.arange(count + 1)).astype(np.int32)), items)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.pad(own, (0, count * n - len(own)))), n), pa.FixedSizeListArray.from_arrays(pa.array(mask), n), lists]
            self.ipc.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.written += count
            names, ends = names[done:], ends[done:]
        self.held, self.ends = [ids[rows * n :]], [(names, ends)]

    def close(self) -> tuple[int, str, int, int, int, str]:
        """The file's row of the manifest."""
        if left := sum(map(len, self.held)):
            self._write(-(-left // self.p.seq_len))
        self.ipc.close()
        return self.shard, self.out.file, self.docs, self.tokens, self.written, self.out.commit()


MANIFEST = "shard long, file string, docs long, tokens long, sequences long, sha1 string"


def _runs(shards: np.ndarray, texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of one shard and of about ``size`` bytes at most, unless one text is longer."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(shards):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        end = min(max(end, start + 1), int(np.searchsorted(shards, shards[start], side="right")))
        yield start, end
        start = end


def write_tokens(docs: DataFrame, root: str, params: TokenParams) -> DataFrame:
    """Write ``docs`` (doc_id: integer, text) below ``root``; returns the manifest (shard, file, docs, tokens, sequences, sha1), a row a file."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(math.ceil(size / params.shard_bytes), shuffle_partitions(spark))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # null ids are the lowest; rows of one id stand by a hash of their text
    key, tie = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    placed = given.select(range_shard(spark, key, tie, range_bounds(given, key, tie, shards)).alias("shard"), "doc_id", "text")
    placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            encoder = _encoder(params.tokenizer)
            for start, end in _runs(batch.column(0).to_numpy(), batch.column(2)):
                shard = batch.column(0)[start].as_py()
                if writer is None or writer.shard != shard:
                    done += [writer.close()] if writer else []
                    writer = _Writer(root, shard, params, encoder.type)
                writer.add(batch.column(1)[start:end], *encoder.ids(batch.column(2)[start:end], params.end_id))
        done += [writer.close()] if writer else []
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for other stages' tasks
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ([],) * 6, kinds)], names=["shard", "file", "docs", "tokens", "sequences", "sha1"])

    placed.mapInArrow(write, MANIFEST).write.parquet(f"{root}/files")
    return spark.read.schema(MANIFEST).parquet(f"{root}/files")


def _documents(data: pa.Buffer) -> Iterator[tuple]:
    """(doc_id, first place in the shard, ids as unsigned 32-bit) of a file's documents, in order."""
    file = pa.ipc.open_file(data)
    place, carry = 0, []
    for b in range(file.num_record_batches):
        batch = file.get_batch(b)
        ids = batch.column(0).flatten().to_numpy()
        n = file.schema.field("ids").type.list_size
        ends = batch.column(2)
        at = np.asarray(ends.flatten().field("end")).astype(np.int64) + np.repeat(np.arange(len(ends)) * n, np.diff(ends.offsets.to_numpy()))
        start = 0
        for doc_id, stop in zip(ends.flatten().field("doc_id").to_pylist(), at.tolist()):
            own = np.concatenate([*carry, ids[start:stop]]).astype("<u4")
            yield doc_id, place, own
            place, start, carry = place + len(own), stop, []
        if start < len(ids):
            carry.append(ids[start:].copy())


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The documents of all files that the manifest below ``root`` names: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/files")
    # one row a file: a window over the manifest alone
    base = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = files.select("file", "sha1", base.alias("base"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha1, base in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(doc_id, base + place, len(ids), zlib.crc32(ids)) for doc_id, place, ids in _documents(read_committed(root, name, sha1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(parse, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenFile:
    """Random access to a local file's sequences without a copy."""

    def __init__(self, path: str):
        self._file = pa.ipc.open_file(pa.memory_map(path))
        self._starts = np.cumsum([0] + [self._file.get_batch(i).num_rows for i in range(self._file.num_record_batches)])

    def __len__(self) -> int:
        return int(self._starts[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids (a view of the file) and the mask of sequence i."""
        b = int(np.searchsorted(self._starts, i, side="right")) - 1
        batch = self._file.get_batch(b)
        return batch.column(0)[i - int(self._starts[b])].values.to_numpy(), batch.column(1)[i - int(self._starts[b])].values
