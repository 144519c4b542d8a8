"""Token ids as Arrow files of fixed-size-list batches.

``write_token_files`` tokenizes whole texts, packs them in ascending key order
into sequences of equal length and writes, per range partition, two Arrow files
in the shared folder:

* ``seq-NNNNN.arrow``: record batches with ``ids fixed_size_list<uint16|uint32>[L]``
  and ``mask fixed_size_list<bool>[L]`` (false on the padding that fills the
  file's last sequence). Rows have equal byte length, so a memory map gives any
  sequence by offset without copying or parsing.
* ``doc-NNNNN.arrow``: ``key, start, n_tokens``: where each document's ids lie
  in the file's flat id stream (a document may span sequences).

Defined cases: a null text counts as empty and yields just the end id; null keys
come first; rows that repeat (same key, same text) are all kept; rows of equal key
are next to each other in an order of their own; special strings in a text become their
ids, as the library does by default; columns beyond key and text are ignored; an empty
table writes no file and returns no row. Memory: a task holds one record batch of
sequences, some documents' ids, and a bounded number of remembered words; few of them stay
in the worker.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from demandflow.llm.alignment import byte_alphabet
from demandflow.llm.common import release
from demandflow.session import ship_package

MANIFEST = "part int, n_docs long, n_tokens long, n_sequences long"
#: Words that a task remembers, the repeated ones that a worker keeps for its next task (some
#: 20 MB), and characters of new words that are encoded together.
CACHE_WORDS, KEPT_WORDS, RUN_CHARS = 450_000, 120_000, 8_000


class _Places(dict):
    """Places 1, 2, ... of words in the order of first use; ``new`` lists the latest."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    Byte-level BPE never merges across the start of a space or line feed that
    follows a visible character, so a text whose white space is single spaces and
    line feeds is the concatenation of its words' ids. Each word is encoded once and
    its ids kept in one array; a text is gathered from that array by index. Texts with
    other white space or special strings are given to the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int | None = None, pieces: bool = True, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        special = self.tok.get_added_tokens_decoder().values()
        self.special = [t.content for t in special]
        byte = byte_alphabet()
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.length = np.array([len(x) if all(c in byte for c in x) else len(x.encode()) for x in names], np.int64)
        self.pieces, self.end, self.cache_words = pieces, [] if end_id is None else [end_id], cache_words
        self._clear()

    def _clear(self) -> None:
        """Word 0 is the end of a document."""
        self.known = _Places()
        self.size, self.ids = [np.array([len(self.end)])], [np.array(self.end, self.dtype)]
        self.met = np.zeros(1, np.int64)

    def shrink(self, most: int = KEPT_WORDS) -> None:
        """Forget all words but the most frequent ones met more than once."""
        size, ids = (np.concatenate(x) for x in (self.size, self.ids))
        met = self.met[1:]
        keep = np.flatnonzero(met > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-met[keep], kind="stable")[:most]])
        words, known = list(self.known), _Places()
        known.update((words[i], n) for n, i in enumerate(keep.tolist(), 1))
        keep = np.r_[0, keep + 1]
        start, n = (np.cumsum(size) - size)[keep], size[keep]
        flat = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.known, self.size, self.ids, self.met = known, [n], [ids[flat]], np.ones(len(keep), np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        runs, run, chars = [], [], 0
        for w in words:
            run.append(w if w[:1] == "\n" else " " + w)
            chars += len(w) + 1
            if chars >= RUN_CHARS:
                runs.append(run)
                run, chars = [], 0
        runs.append(run)
        for at in range(0, len(runs), 32):
            some = runs[at:at + 32]
            for run, ids in zip(some, self._ids(["".join(r) for r in some])):
                ids = np.array(ids, np.int64)
                ends, cut = np.cumsum(self.length[ids]), np.cumsum([len(w.encode()) for w in run])
                place = np.searchsorted(ends, cut)
                if len(run) and (place[-1] >= len(ends) or not (ends[place] == cut).all()):
                    parts = self._ids(run)  # a vocabulary with other joins: word by word
                    self.size.append(np.array([len(x) for x in parts]))
                    ids = np.array([i for x in parts for i in x], np.int64)
                elif len(run):
                    self.size.append(np.diff(place, prepend=-1))
                self.ids.append(ids.astype(self.dtype))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, each with the end id, and their numbers."""
        if len(self.known) > self.cache_words:
            self.shrink(min(KEPT_WORDS, self.cache_words // 2))
        places, alone = [], []
        for s in texts:
            flat = s.replace("\n", " ")
            plain = self.pieces and "  " not in flat and flat.isprintable() and not any(x in s for x in self.special)
            part = s.replace("\n", " \n").split(" ") if plain else [s]
            alone.append(part[0])
            places.append(np.fromiter(map(self.known.__getitem__, part[1:]), np.int64, len(part) - 1))
        self._learn(self.known.new)
        self.known.new = []
        size, ids = (np.concatenate(x) for x in (self.size, self.ids))
        self.size, self.ids = [size], [ids]
        # heads and whole texts follow the remembered words, for this call only
        heads = self._ids(alone)
        size = np.concatenate([size, np.array([len(x) for x in heads], np.int64)])
        ids = np.concatenate([ids, *[np.array(x, self.dtype) for x in heads]])
        first = len(self.known) + 1
        place = np.concatenate([np.zeros(0, np.int64), *[x for k, p in enumerate(places) for x in ([first + k], p, [0])]])
        count = np.array([len(p) + 2 for p in places], np.int64)
        met = np.bincount(place, minlength=first)[:first]
        met[:len(self.met)] += self.met
        self.met = met
        n, start = size[place], np.cumsum(size) - size
        flat = np.repeat(start[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return ids[flat], np.add.reduceat(n, np.cumsum(count) - count) if len(texts) else count


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


class _Packer:
    """Streams ids into fixed-length sequences, one record batch at a time."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int, batch_seqs: int):
        self.dtype, self.len, self.batch = dtype, seq_len, batch_seqs
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)),
                                 ("mask", pa.list_(pa.bool_(), seq_len))])
        self.writer = ipc.new_file(sink, self.schema)
        self.held, self.n, self.sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.len * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.held])
        step, at = self.len * self.batch, 0
        while len(flat) - at >= step or (last and at < len(flat)):
            part = flat[at:at + step]
            n = -(-len(part) // self.len)
            ids = np.zeros(n * self.len, dtype=self.dtype)
            ids[:len(part)] = part
            mask = np.arange(n * self.len) < len(part)
            self.writer.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), self.len) for x in (ids, mask)],
                schema=self.schema))
            self.sequences += n
            at += len(part)
        self.held, self.n = [flat[at:].copy()], len(flat) - at

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pafs.LocalFileSystem(), folder)


def _writer(folder: str, vocabulary: str, end_id: int, seq_len: int, batch_seqs: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        ctx = TaskContext.get()
        part, tag = ctx.partitionId(), f"{ctx.stageId()}-{ctx.taskAttemptId()}"
        enc = encoder(vocabulary, end_id)
        temp = {k: f"{base}/_tmp-{k}-{part:05d}-{tag}" for k in ("seq", "doc")}
        packer = docs = None
        n_docs = start = 0
        doc_schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):  # few texts at a time are Python strings
                some = [t or "" for t in texts.slice(at, 256).to_pylist()]
                if packer is None:
                    fs.create_dir(base, recursive=True)
                    sinks = {k: fs.open_output_stream(v) for k, v in temp.items()}
                    packer = _Packer(sinks["seq"], enc.dtype, seq_len, batch_seqs)
                    docs = ipc.new_file(sinks["doc"], doc_schema)
                ids, size = enc.encode(some)
                packer.add(ids)
                ends = start + np.cumsum(size)
                docs.write_batch(pa.record_batch([keys.slice(at, 256), pa.array(ends - size), pa.array(size)],
                                                 schema=doc_schema))
                start, n_docs = int(ends[-1]), n_docs + len(some)
        if packer is not None:
            packer.close()
            docs.close()
            for k, sink in sinks.items():
                sink.close()
                fs.move(temp[k], f"{base}/{k}-{part:05d}.arrow")  # a retried task replaces whole files
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([start]),
                                   pa.array([packer.sequences])],
                                  names=["part", "n_docs", "n_tokens", "n_sequences"])
        enc.shrink()
        del packer
        release()
    return write


def write_token_files(df: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id",
                      text: str = "text", seq_len: int = 2048, batch_seqs: int = 512) -> list:
    """Write the files and return the manifest: one row per file in key order
    (as many rows as range partitions, never as many as documents)."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", "text")
    made = ordered.mapInArrow(_writer(folder, vocabulary, end_id, seq_len, batch_seqs), MANIFEST)
    return sorted(made.collect(), key=lambda r: r.part)


class TokenFile:
    """Random access to one pair of files: equal-length sequences, masks and documents.

    Over a local or mounted path the file is memory-mapped and every array is a
    view of the map."""

    def __init__(self, folder: str, part: int):
        fs, base = _place(folder)
        opened = {}
        for k in ("seq", "doc"):
            path = f"{base}/{k}-{part:05d}.arrow"
            opened[k] = ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem)
                                      else fs.open_input_file(path))
        self.file, self.docs = opened["seq"], opened["doc"]
        self.seq_len = self.file.schema.field("ids").type.list_size
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.per_batch = first  # all batches but the last have as many sequences

    def _column(self, batch: int, name: str) -> pa.Array:
        return self.file.get_batch(batch).column(name).flatten()

    def sequence(self, i: int) -> np.ndarray:
        """Sequence ``i`` (a view)."""
        at = (i % self.per_batch) * self.seq_len
        return self._column(i // self.per_batch, "ids").slice(at, self.seq_len).to_numpy()

    def mask(self, i: int) -> np.ndarray:
        at = (i % self.per_batch) * self.seq_len
        return self._column(i // self.per_batch, "mask").slice(at, self.seq_len).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the flat stream (a view within a batch)."""
        step, out = self.per_batch * self.seq_len, []
        while n > 0:
            batch, at = divmod(start, step)
            take = min(n, step - at)
            out.append(self._column(batch, "ids").slice(at, take).to_numpy())
            start, n = start + take, n - take
        return out[0] if len(out) == 1 else np.concatenate(out)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, part_start long"


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(folder, part)
                for k in range(file.docs.num_record_batches):
                    docs = file.docs.get_batch(k)
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    first = int(starts[0]) if len(starts) else 0
                    flat = memoryview(file.ids(first, int(sizes.sum())).astype("<u4")).cast("B")
                    at = (starts - first) * 4
                    crc = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + sizes * 4).tolist())]
                    yield pa.record_batch(
                        [docs.column(0), pa.array(starts + base), docs.column(2), pa.array(crc, pa.int64()),
                         pa.array(np.full(len(crc), part, np.int32)), pa.array(starts)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "part_start"])
    return read


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """One row per document, from the files: its place in the whole id stream, its
    number of ids and their checksum."""
    ship_package(spark)
    base, rows = 0, []
    for m in manifest:
        rows.append((m.part, base))
        base += m.n_tokens
    table = spark.createDataFrame(rows, "part int, base long").repartition(max(1, len(rows)))
    return table.mapInArrow(_reader(folder), READ)
