"""Alignment of two tokenizers by interval coalescing.

Tokens of a byte-level BPE (A, over a space and the text) and of a piece model (B, over
the text; it adds the space itself) are intervals over the same bytes. All tokens are
lexsorted by start, ``maximum.accumulate`` runs over their ends, and a group ends where a
start reaches the running maximum; every A token of a group is linked with every B token
of it. A pair of ids counts the documents that hold it linked; a document reports how many
of its links are their A id's most frequent pair, and the sum of its links' counts.

How it scales. Documents are cut into chunks of bounded length, in place. Neither tokenizer
joins bytes across a single space or line feed between visible characters, so a task
encodes and coalesces each distinct word once (a bounded number is remembered); other texts
(runs of spaces, tabs, control characters) are encoded whole. Chunks are written to the
shared folder with the distinct pairs they hold and in how many documents each occurs; only
those pairs are exchanged, by pair for the counts and then back to their chunk. Nothing is
collected; the best count of every A id (at most a row per id of the vocabulary) is
broadcast, and the counts of all pairs where they are at most ``SENT_PAIRS``.

Defined cases: a text that is null, empty, or whose joined token bytes differ from the
space and the text has no tokens: zeros and an empty digest; null keys are kept; repeated
rows are documents of their own, in the result and in the counts; an empty table gives no
row; other columns are ignored. Memory: a chunk, or one longer document; within a group,
repeated ids are one entry with a number, so a group of many tokens costs its distinct
pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from demandflow.llm.common import release, stored
from demandflow.session import ship_package

#: Characters of a chunk of documents (a longer document is a chunk of its own).
CHUNK_CHARS = 4_000_000
#: Characters of the words that go through a tokenizer at a time.
RUN_CHARS = 8_000
#: Distinct words whose tokens are held at a time.
PIECES = 16_384
#: Distinct words whose groups a task remembers from chunk to chunk.
REMEMBERED = 250_000
#: Distinct pairs up to which their counts are sent to every task (16 bytes each); more are joined by exchange.
SENT_PAIRS = 1_000_000
CHUNKS = ("chunk long, codes array<long>, docs_with array<int>, sizes array<int>, piece_at binary, piece_pair binary, piece_links binary, "
          "doc_at binary, doc_piece binary, doc_times binary, "
          "docs array<struct<key: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha256: string>>")
RESULT = "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes for 256, 257, ... in ascending order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # special strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        byte = byte_alphabet()
        self.a_bytes = []
        for i in range(self.a.get_vocab_size()):
            token = self.a.id_to_token(i) or ""
            self.a_bytes.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.text = [np.array([sep + str(i) for i in range(max(len(names), len(self.a_bytes)))], object)
                     for sep in ("", ",", "|", ";")]
        # words may be encoded alone if no piece crosses the start of a space or holds a line feed
        self.words = not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        self.space = self.b.piece_to_id("▁")

    def words_of(self, text: str) -> list[str] | None:
        """The space and the text, cut where neither tokenizer joins bytes; None if it must stay whole."""
        flat = text.replace("\n", " ")
        if not self.words or "  " in flat or flat[0] == " " or flat[-1] == " " or not flat.isprintable():
            return None
        return [p if p[0] == "\n" else " " + p for p in text.replace("\n", " \n").split(" ")]

    def encode(self, pieces: list[str], alone: list[bool]) -> tuple[list, list, np.ndarray]:
        """Flat ids of both sides, the pieces in order; whether each piece's token bytes are its
        own (else it has none). Words go through the tokenizers joined; ``alone`` marks the others."""
        words = [i for i, x in enumerate(alone) if not x]
        runs, at = [], 0
        while at < len(words):
            run, size = [], 0
            while at < len(words) and size < RUN_CHARS:
                run.append(words[at])
                size += len(pieces[words[at]])
                at += 1
            runs.append(run)
        runs += [[i] for i, x in enumerate(alone) if x]
        ids, sizes, good = ([], []), ([], []), np.zeros(len(pieces), bool)
        while runs:
            some, runs = runs[:16], runs[16:]  # few encodings at a time
            texts = ["".join([pieces[i] for i in run]) for run in some]
            # a line feed at the beginning would follow B's own space: a word in front takes it
            texts = [" a" + t if t[0] == "\n" else t for t in texts]
            sides = ([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                     self.b.encode([t[1:] for t in texts], num_threads=1))
            for run, text, a, b in zip(some, texts, *sides):
                parts = [pieces[i].encode() for i in run]
                front = 2 if text[:2] == " a" and pieces[run[0]][:1] == "\n" else 0
                data = text.encode()
                ends = np.cumsum([len(x) for x in parts]) + front
                found = []
                for tokens, table, length in ((a, self.a_bytes, self.a_len), (b, self.b_bytes, self.b_len)):
                    tokens = np.array(tokens, np.int64)
                    end = np.cumsum(length[tokens])
                    found.append((tokens, end, b"".join([table[i] for i in tokens.tolist()]) == data
                                  and bool(np.isin(ends, end, assume_unique=True).all())))
                if not all(f[2] for f in found):
                    if len(run) > 1:  # some word's bytes are not its own: find it among fewer words
                        runs += [run[:len(run) // 2], run[len(run) // 2:]]
                    continue
                good[run] = True
                for side, (tokens, end, _) in enumerate(found):
                    cut = np.searchsorted(end, np.r_[front, ends], "right")
                    ids[side].append(tokens[cut[0]:])
                    sizes[side].append((run, np.diff(cut)))
        return [self._by_piece(i, n, len(pieces)) for i, n in zip(ids, sizes)], good

    @staticmethod
    def _by_piece(ids: list, sizes: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, piece of each) in the order of the pieces."""
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        piece = np.concatenate([np.zeros(0, np.int64), *[np.repeat(run, size) for run, size in sizes]])
        order = np.argsort(piece, kind="stable")
        return flat[order], piece[order]


_PAIRS: dict[tuple, Pair] = {}


def pair(byte_level: str, piece_model: str) -> Pair:
    """One pair of tokenizers per Python worker."""
    if (byte_level, piece_model) not in _PAIRS:
        _PAIRS[byte_level, piece_model] = Pair(byte_level, piece_model)
    return _PAIRS[byte_level, piece_model]


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and the group of each in that order: a group breaks
    where a start reaches the running maximum of the ends."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(fresh) - 1


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), then those of first[1], ..."""
    at = np.cumsum(count) - count
    return np.repeat(first - at, count) + np.arange(int(count.sum()))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their numbers."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


def _weighted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights


class Aligned:
    """Groups and links of a list of pieces. ``good`` marks the pieces whose token bytes are
    theirs; the arrays n_a, n_b, n_groups, n_links and the texts of the groups go by piece;
    ``link_piece``, ``link_code`` (a << 32 | b) and ``link_n`` list the links of each piece."""

    def __init__(self, two: Pair, pieces: list[str], alone: list[bool]):
        sides, self.good = two.encode(pieces, alone)
        ids, piece = [list(x) for x in zip(*sides)]
        size = [length[i] for i, length in zip(ids, (two.a_len, two.b_len))]
        self.n_a, self.n_b = (np.bincount(p, minlength=len(pieces)) for p in piece)
        # all pieces on one axis of bytes: both sides cover it without gaps
        end = np.concatenate([np.cumsum(s) for s in size])
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        order, group = coalesce(end - np.concatenate(size), end, side)
        ids, side, piece = np.concatenate(ids)[order], side[order], np.concatenate(piece)[order]
        place = np.lexsort((np.arange(len(ids)), side, group))
        ids, side, piece, group = ids[place], side[place], piece[place], group[place]
        n = int(group[-1]) + 1 if len(group) else 0
        of_group = np.zeros(n, np.int64)
        of_group[group] = piece
        self.n_groups = np.bincount(of_group, minlength=len(pieces))
        na, nb = np.bincount(group[side == 0], minlength=n), np.bincount(group[side == 1], minlength=n)
        self.n_links = np.bincount(of_group, weights=(na * nb).astype(np.float64), minlength=len(pieces)).astype(np.int64)
        self._texts(two, ids, side, piece, group, len(pieces))
        # distinct ids of each group and side with their numbers; each side's number of ids as factor
        va, vb = len(two.a_bytes), len(two.b_bytes)
        ka, ca = _counted(group[side == 0] * va + ids[side == 0])
        kb, cb = _counted(group[side == 1] * vb + ids[side == 1])
        ga, gb = ka // va, kb // vb
        first, many = np.searchsorted(gb, ga), np.bincount(gb, minlength=n)[ga]
        of_a, of_b = np.repeat(np.arange(len(ga)), many), _ranges(first, many)
        link = (of_group[ga[of_a]] * va + ka[of_a] % va) * vb + kb[of_b] % vb
        link, self.link_n = _weighted(link, ca[of_a] * cb[of_b])
        self.link_piece = link // (va * vb)
        self.link_code = ((link // vb % va) << 32) | (link % vb)

    def _texts(self, two: Pair, ids, side, piece, group, n: int) -> None:
        sep = np.zeros(len(ids), np.int64)
        sep[1:] = np.where(piece[1:] != piece[:-1], 0, np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1)))
        said = np.empty(len(ids), object)
        for k in range(4):
            said[sep == k] = two.text[k][ids[sep == k]]
        said = said.tolist()
        cuts = np.searchsorted(piece, np.arange(n + 1)).tolist()
        self.texts = ["".join(said[s:e]) for s, e in zip(cuts, cuts[1:])]


class Words:
    """What a task knows of the words it met: their numbers, and by number the arrays of
    :class:`Aligned`, links from ``link_at[i]`` to ``link_at[i + 1]``."""

    FIELDS = ("good", "n_a", "n_b", "n_groups", "n_links")

    def __init__(self, two: Pair):
        self.two, self.number, self.alone, self.texts = two, _Numbers(), set(), []
        self.fields = {n: [] for n in self.FIELDS}
        self.codes, self.counts, self.sizes = [], [], []

    def learn(self) -> None:
        """Align the words met since the last call, ``PIECES`` at a time."""
        new = self.number.new
        done = len(self.number) - len(new)
        for at in range(0, len(new), PIECES):
            some = new[at:at + PIECES]
            al = Aligned(self.two, [x if isinstance(x, str) else " " + x[0] for x in some],
                         [done + at + i in self.alone for i in range(len(some))])
            for n in self.FIELDS:
                self.fields[n].append(getattr(al, n))
            self.texts += al.texts
            self.codes.append(al.link_code)
            self.counts.append(al.link_n.astype(np.int32))
            self.sizes.append(np.bincount(al.link_piece, minlength=len(some)))
        self.number.new = []
        for held in (*self.fields.values(), self.codes, self.counts, self.sizes):
            held[:] = [np.concatenate(held)] if held else []

    def table(self) -> SimpleNamespace:
        none = np.zeros(0, np.int64)
        get = lambda held: held[0] if held else none
        return SimpleNamespace(**{n: get(v) for n, v in self.fields.items()}, texts=self.texts, codes=get(self.codes),
                               counts=get(self.counts), link_at=np.r_[0, np.cumsum(get(self.sizes))])


class _Numbers(dict):
    """Numbers 0, 1, ... in the order of first use; ``new`` lists the latest keys."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


def _packed(x: np.ndarray) -> pa.Buffer:
    """Differences of neighbours as compressed 32-bit integers: ascending or equal numbers get small."""
    return pa.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, n * 4, "zstd"), "<i4").astype(np.int64))


def _chunk(words: Words, number: int, keys: list, held: list[np.ndarray]) -> pa.RecordBatch:
    words.learn()
    al = words.table()
    count = np.array([len(x) for x in held], np.int64)
    piece = np.concatenate([np.zeros(0, np.int32), *held])
    doc = np.repeat(np.arange(len(held)), count)
    bad = np.bincount(doc[~al.good[piece]], minlength=len(held)) > 0 if len(piece) else np.zeros(len(held), bool)
    docs = []
    sums = [np.bincount(doc, weights=v[piece].astype(np.float64), minlength=len(held)).astype(np.int64)
            for v in (al.n_a, al.n_b, al.n_groups, al.n_links)]
    for i, (key, own) in enumerate(zip(keys, held)):
        none = bad[i] or not len(own)
        sha = "" if none else hashlib.sha256(";".join([al.texts[w] for w in own.tolist()]).encode()).hexdigest()
        docs.append({"key": key, "sha256": sha} | {
            n: 0 if none else int(s[i]) for n, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums)})
    # words of the chunk, numbered within it, and the words of each document with their numbers
    piece, doc = piece[~bad[doc]], doc[~bad[doc]]
    used = _counted(piece)[0]
    both, times = _counted(doc * max(1, len(used)) + np.searchsorted(used, piece))
    doc, piece = both // max(1, len(used)), both % max(1, len(used))
    many = (al.link_at[1:] - al.link_at[:-1])[used]
    links = _ranges(al.link_at[:-1][used], many)
    codes = _counted(al.codes[links])[0]
    link_pair = np.searchsorted(codes, al.codes[links])
    link_at = np.r_[0, np.cumsum(many)]
    # documents that hold each pair linked: distinct (document, pair)
    own = _ranges(link_at[:-1][piece], many[piece])
    both = _counted(np.repeat(doc, many[piece]) * max(1, len(codes)) + link_pair[own])[0]
    docs_with = np.bincount(both % max(1, len(codes)), minlength=len(codes)).astype(np.int32)
    doc_at = np.searchsorted(doc, np.arange(len(held) + 1))
    arrays = (link_at, link_pair, al.counts[links], doc_at, piece, times)
    row = [number, codes, docs_with, [len(x) for x in arrays], *[_packed(x) for x in arrays], docs]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA)], schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("codes", pa.list_(pa.int64())), ("docs_with", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
    *[(n, pa.binary()) for n in ("piece_at", "piece_pair", "piece_links", "doc_at", "doc_piece", "doc_times")],
    ("docs", pa.list_(pa.struct([("key", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                                 ("sha256", pa.string())])))])


def _chunks(byte_level: str, piece_model: str, chunk_chars: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(byte_level, piece_model)
        number, chars = TaskContext.get().partitionId() << 32, 0
        keys, held, words = [], [], Words(two)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts at a time are Python strings
                for key, text in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist()):
                    some = two.words_of(text) if text else []
                    if some is None:  # encoded whole; a key of its own keeps it apart from the words
                        words.alone.add(words.number[text, None])
                        some = [(text, None)]
                    keys.append(key)
                    held.append(np.fromiter(map(words.number.__getitem__, some), np.int32, len(some)))
                    chars += len(text or "") + 100
                    if chars >= chunk_chars:
                        yield _chunk(words, number, keys, held)
                        keys, held, chars, number = [], [], 0, number + 1
                        if len(words.number) > REMEMBERED or words.alone:
                            words = Words(two)
        if keys:
            yield _chunk(words, number, keys, held)
        del keys, held, words
        release()
    return make


#: Bits below a pair's place in its chunk: number of documents (35), whether it is its A id's best (1).
FACT_BITS = 36


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk with the counts of its pairs, to one row per document."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(n)[at] for n in batch.schema.names}
            facts = row["facts"].values.to_numpy()
            pos, total = facts >> FACT_BITS, (facts & ((1 << FACT_BITS) - 1)) >> 1
            value = np.zeros((2, len(pos)), np.int64)
            value[0, pos], value[1, pos] = facts & 1, total
            ints = {n: _unpacked(row[n].as_buffer(), k) for n, k in zip(
                ("piece_at", "piece_pair", "piece_links", "doc_at", "doc_piece", "doc_times"), row["sizes"].as_py())}
            sums = []
            for v in value:  # links of a piece, then pieces of a document
                links = np.r_[0, np.cumsum(v[ints["piece_pair"]] * ints["piece_links"])]
                pieces = np.diff(links[ints["piece_at"]])
                run = np.r_[0, np.cumsum(pieces[ints["doc_piece"]] * ints["doc_times"])]
                sums.append(pa.array(np.diff(run[ints["doc_at"]])))
            docs = row["docs"].values
            cols = [docs.field(n) for n in ("key", "n_a", "n_b", "n_groups", "n_links")] + sums + [docs.field("sha256")]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in RESULT.split(", ")])


def align(docs: DataFrame, byte_level: str, piece_model: str, key: str = "doc_id", text: str = "text",
          chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per row of ``docs``: key, numbers of tokens, groups and links, n_best, count_sum, digest of the groups."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    chunks = stored(rows.mapInArrow(_chunks(byte_level, piece_model, chunk_chars), CHUNKS), "aligned")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("codes", "docs_with")).alias("pos", "p")).select(
        "chunk", "pos", F.col("p.codes").alias("code"), F.col("p.docs_with").alias("n"))
    counts = stored(pairs.groupBy("code").agg(F.sum("n").alias("total")), "pair-counts")
    a = F.shiftright("code", 32)
    best = counts.groupBy(a.alias("a")).agg(F.max("total").alias("most"))  # a row per id of the vocabulary at most
    counts = counts.join(F.broadcast(best), a == F.col("a")).select(
        "code", (F.col("total") * 2 + (F.col("total") == F.col("most")).cast("long")).alias("fact"))
    if counts.count() <= SENT_PAIRS:
        counts = F.broadcast(counts)
    facts = pairs.select("chunk", "pos", "code").join(counts, "code").select(
        "chunk", F.shiftleft(F.col("pos").cast("long"), FACT_BITS).bitwiseOR(F.col("fact")).alias("fact"))
    facts = facts.groupBy("chunk").agg(F.collect_list("fact").alias("facts"))  # the pairs of a chunk: bounded
    whole = chunks.drop("codes", "docs_with").join(facts, "chunk", "left").withColumn(
        "facts", F.coalesce("facts", F.array().cast("array<bigint>")))
    return whole.mapInArrow(_scored, RESULT)
