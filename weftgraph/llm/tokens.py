"""Token-ID output: encode texts, compress the ids of a shard by Re-Pair, write, read back.

A shard holds whole documents in ascending doc_id order.  Re-Pair replaces the most frequent adjacent id
pairs by new symbols, up to RULES_A_ROUND of them a round, until no pair stands LEAST_COUNT times; no pair
spans two documents.  Symbols take 16 bits, or 32 once there are more of them.  The shard stores the rules, each symbol's expansion length, the symbols, and where each
document begins, so any document, or any range of its ids, is decoded without the rest.

Shards are rows of a Parquet table written by Spark, so the committer, not the task, decides which of
several attempts counts, and any store that Spark can reach will do.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from weftgraph.llm.decontamination import lowered
from weftgraph.llm.shared import in_arrow, partitions, written
from weftgraph.llm.words import CHUNK_BYTES, IS_WORD, ODD as GOLDEN, U, Slots, buffers, chunks, named, spans

END = 2
SHARD_IDS = 1 << 21
RULES_A_ROUND, LEAST_COUNT = 2600, 16
#: Pairs that are looked up at a time.
BLOCK_PAIRS = 1 << 16
#: A text of more bytes is encoded in stretches.
LONG_BYTES = 8 << 20
#: Bytes of texts that are encoded at a time (a longer single text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Sizes of the table of known pieces, at first and at most (powers of two), and of the cache of other words.
FIRST_SLOTS, SLOTS = 1 << 16, 1 << 22
CACHED_WORDS = 100_000
#: The rules of the vocabulary file that the fast path reproduces.
CUTS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
#: Bytes that send their word through the full tokenizer: controls, ' and <, and lead bytes but C3.
ODD = np.zeros(256, bool)
ODD[:0x20] = ODD[[0x27, 0x3C, 0x7F]] = True
ODD[0xC0:] = True
ODD[0xC3] = False
#: 0 white space, 1 letter, 2 digit, 3 other
KIND = np.full(256, 3, np.uint8)
KIND[~IS_WORD] = 0
KIND[0x41:0x5B] = KIND[0x61:0x7B] = KIND[0x80:] = 1
KIND[0x30:0x3A] = 2
MAGIC = b"WRP1"
HEADER = struct.Struct("<4sIIIIII")
SHARDS = "part long, seq long, before long, n_tokens long, payload binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by the tokenizers library, called once per distinct piece.

    The vocabulary drops white space, lowers, and merges only inside the pieces its pattern cuts: runs of
    letters, single digits, runs of anything else.  Words of ASCII and Latin-1 letters are cut, lowered
    and hashed for a whole batch in numpy; their pieces' ids stand in an open-addressing table (key:
    64-bit hash and a tag of length and outer bytes) that doubles when half full and is emptied at SLOTS.
    A word with anything else in it (other scripts, apostrophes, control characters, a ``<`` that could begin a
    special token) goes whole through the full tokenizer.  A tokenizer with other normalising or cutting
    rules than these encodes each text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.vocabulary = self.full.get_vocab_size()
        rules = json.loads(Path(path).read_text())
        self.cuts = [rules["normalizer"], rules["pre_tokenizer"]] == CUTS
        self.pieces = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": CUTS[1]["pretokenizers"][1]}))
        self.words: dict[bytes, list[int]] = {}
        self._empty(FIRST_SLOTS)

    def _empty(self, slots: int) -> None:
        self.known = Slots(slots)
        self.first, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.pooled = np.zeros(1 << 20, np.uint32), 0

    def _room(self, more: int) -> None:
        """Room for so many more pieces: a larger table, in which known ones have other slots, or an empty one."""
        slots = self.known.size
        while slots < SLOTS and self.known.held + more > slots // 2:
            slots *= 2
        if self.known.held + more > slots // 2:
            self._empty(slots)
        elif slots > self.known.size:
            old, there = self.known, np.flatnonzero(self.known.keys)
            first, size = self.first[there], self.size[there]
            self.known, self.first, self.size = Slots(slots), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
            slot = self.known.put(old.keys[there], old.tags[there])
            self.first[slot], self.size[slot] = first, size

    def _put(self, keys: np.ndarray, tags: np.ndarray, ids: list[list[int]]) -> None:
        size = np.array([len(x) for x in ids], np.int32)
        flat = np.array([y for x in ids for y in x], np.uint32)
        if self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pooled], np.zeros(max(len(flat), len(self.pool)), np.uint32)])
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        slot = self.known.put(keys, tags)
        self.first[slot], self.size[slot] = self.pooled + np.cumsum(size) - size, size
        self.pooled += len(flat)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, each text's followed by END, and how many each has.

        A long text goes through in stretches that end at white space, which no piece spans.
        """
        data, offsets = buffers(column)
        if not self.cuts or len(offsets) != 2 or len(data) <= LONG_BYTES:
            return self._ids(data, offsets)
        out, at = [], 0
        while at < len(data):
            to = min(at + CHUNK_BYTES, len(data))
            while to < len(data) and not (gap := np.flatnonzero(~IS_WORD[data[to : to + CHUNK_BYTES]])[:1]).size:
                to = min(to + CHUNK_BYTES, len(data))
            to += int(gap[0]) if to < len(data) else 0
            out.append(self._ids(data[at:to], np.array([0, to - at]))[0][:-1])
            at = to
        out.append(np.array([END], np.uint32))
        ids = np.concatenate(out)
        return ids, np.array([len(ids)], np.int64)

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        if not self.cuts:
            raw = data.tobytes()
            ids = [[*self.full.encode(raw[a:b].decode(), add_special_tokens=False).ids, END] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([y for x in ids for y in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        starts, ends, firsts = spans(data, offsets)
        if not len(starts):
            return np.full(n_docs, END, np.uint32), np.ones(n_docs, np.int64)
        low = lowered(data)
        odd = ODD[data]
        tail = (data[1:] & 0xC0) == 0x80
        after = data[:-1] == 0xC3
        odd[1:] |= (tail != after) | (after & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        odd[-1] |= data[-1] == 0xC3
        odd[0] |= (data[0] & 0xC0) == 0x80
        seen = np.concatenate([[0], np.cumsum(odd)])
        whole = seen[ends] > seen[starts]
        kind = KIND[low]
        edge = np.ones(len(data), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge &= kind > 0
        edge[starts] = True
        at = np.flatnonzero(edge)
        word = np.searchsorted(starts, at, "right") - 1
        keep = ~whole[word] | (at == starts[word])
        at, word = at[keep], word[keep]
        to = ends[word]
        inner = np.flatnonzero(word[1:] == word[:-1])
        to[inner] = at[inner + 1]
        whole = whole[word]
        keys, tags = named(low, at, to)
        slot = np.full(len(at), -1, np.int64)
        plain = np.flatnonzero(~whole)
        slot[plain] = self.known.find(keys[plain], tags[plain])
        new = plain[slot[plain] < 0]
        if self.known.held + len(new) > self.known.size // 2:
            self._room(len(np.unique(keys[new])))
            slot[plain] = self.known.find(keys[plain], tags[plain])
            new = plain[slot[plain] < 0]
        raw = low.tobytes() if len(new) else b""
        # a second round only for pieces of equal hash and different tag
        while len(new):
            _, one = np.unique(keys[new], return_index=True)
            some = new[one]
            texts = [raw[a:b].decode() for a, b in zip(at[some].tolist(), to[some].tolist(), strict=True)]
            self._put(keys[some], tags[some], [e.ids for e in self.pieces.encode_batch_fast(texts, add_special_tokens=False)])
            slot[new] = self.known.find(keys[new], tags[new])
            new = new[slot[new] < 0]
        first, size = self.first[slot].astype(np.int64), self.size[slot].astype(np.int64)
        pool = self.pool
        other = np.flatnonzero(whole)
        if len(other):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(at[other].tolist(), to[other].tolist(), strict=True)]
            missing = list({w for w in words if w not in self.words})
            if len(self.words) + len(missing) > CACHED_WORDS:
                self.words.clear()
                missing = list(set(words))
            coded = self.full.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
            self.words.update(zip(missing, (e.ids for e in coded), strict=True))
            ids = [self.words[w] for w in words]
            size[other] = [len(x) for x in ids]
            first[other] = self.pooled + np.cumsum(size[other]) - size[other]
            pool = np.concatenate([pool[: self.pooled], np.array([y for x in ids for y in x], np.uint32)])
        # a document's END stands after its last piece
        doc = np.searchsorted(firsts, word, "right") - 1
        run = np.cumsum(size)
        counts = np.bincount(doc, size, n_docs).astype(np.int64) + 1
        out = np.empty(counts.sum(), np.uint32)
        out[np.arange(run[-1]) + np.repeat(doc, size)] = pool[np.arange(run[-1]) + np.repeat(first - (run - size), size)]
        out[np.cumsum(counts) - 1] = END
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, counts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), symbols, and the index of each document's first symbol (one more at the end).

    Symbols from ``terminals`` on are nonterminals, rule k of them ``terminals + k``.
    """
    seq = ids.copy()
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts) - 1] = True
    rules: list[np.ndarray] = []
    names, most = terminals, RULES_A_ROUND
    while len(seq) > 1:
        # 16-bit symbols make 32-bit pairs, which sort twice as fast
        one, pair, half = (np.uint16, np.uint32, 16) if names + RULES_A_ROUND <= 1 << 16 else (np.uint32, np.uint64, 32)
        seq = seq.astype(one, copy=False)
        key = (seq[:-1].astype(pair) << pair(half)) | seq[1:]
        inner = ~last[:-1]
        some = np.sort(key[inner])
        # a pair is frequent if LEAST_COUNT sorted places on there is the same one
        far = some[LEAST_COUNT - 1 :] == some[: max(0, len(some) - LEAST_COUNT + 1)]
        frequent = some[: len(far)][far]
        if not len(frequent):
            break
        first = np.flatnonzero(np.concatenate([[True], frequent[1:] != frequent[:-1]]))
        count = np.diff(np.append(first, len(frequent)))
        often = np.argsort(-count, kind="stable")[:most]
        chosen = frequent[first[often]]
        # a small direct table finds the few chosen pairs; of pairs that share a slot the most frequent stays for now
        slots = lambda k: ((k.astype(U) * GOLDEN) >> U(44)).astype(np.int32)
        table = np.full(1 << 20, len(chosen), np.int16)
        at = slots(chosen)
        table[at[::-1]] = np.arange(len(chosen) - 1, -1, -1)
        kept = table[at] == np.arange(len(chosen))
        rank = np.empty(len(key), np.int16)
        for i in range(0, len(key), BLOCK_PAIRS):
            rank[i : i + BLOCK_PAIRS] = table[slots(key[i : i + BLOCK_PAIRS])]
        # a shard has less than 2^32 ids
        hit = np.flatnonzero((rank < len(chosen)) & inner).astype(np.uint32)
        hit = hit[chosen[rank[hit]] == key[hit]]
        del key, some
        # of overlapping pairs take every other one from the left
        begin = np.concatenate([[True], np.diff(hit) > 1])
        run = hit[np.maximum.accumulate(np.where(begin, np.arange(len(hit), dtype=np.uint32), np.uint32(0)))]
        hit = hit[((hit - run) & 1) == 0]
        # a pair that others have left but one place to waits; if that holds for all, the most frequent goes alone
        its = rank[hit]
        kept &= np.bincount(its, minlength=len(chosen)) > 1
        if not kept.any():
            most = 1
            continue
        most = RULES_A_ROUND
        hit = hit[kept[its]]
        number = np.cumsum(kept) - 1
        pairs = chosen[kept]
        rules.append(np.stack([pairs >> pair(half), pairs & pair((1 << half) - 1)], 1).astype(np.uint32))
        seq[hit] = (names + number[rank[hit]]).astype(one)
        names += len(pairs)
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
    seq = seq.astype(np.uint16 if names <= 1 << 16 else np.uint32, copy=False)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return table, seq, np.concatenate([[0], np.flatnonzero(last) + 1])


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    """One shard: header, rules, expansion lengths, documents (id, known or not, first symbol, first id), symbols, checksum."""
    rules, symbols, firsts = compress(ids, counts, terminals)
    lengths = [1] * terminals
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    width = symbols.itemsize
    body = b"".join(
        [
            HEADER.pack(MAGIC, len(counts), len(rules), len(symbols), len(ids), terminals, width),
            rules.astype("<u4").tobytes(),
            np.array(lengths[terminals:], "<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
            firsts.astype("<u4").tobytes(),
            np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A packed shard: ``ids(k)`` decodes document k, ``ids(k, a, b)`` only its ids a to b."""

    def __init__(self, payload: bytes):
        body = memoryview(payload)[:-4]
        if zlib.crc32(body) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("shard checksum differs")
        magic, n_docs, n_rules, n_symbols, self.n_ids, self.terminals, width = HEADER.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes
            return got

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        ids = take("<i8", n_docs).tolist()
        self.doc_ids = [x if known else None for x, known in zip(ids, take(np.uint8, n_docs).tolist(), strict=True)]
        self.firsts = take("<u4", n_docs + 1).astype(np.int64)
        self.starts = take("<u4", n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols).astype(np.int64)
        self._flat()

    def _flat(self) -> None:
        """Every rule's expansion in one array, in order of the rules (each uses only earlier ones)."""
        out = np.empty(int(self.lengths.sum()), np.uint32)
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        for i, (a, b) in enumerate(self.rules.tolist()):
            to = starts[i]
            for x in (a, b):
                if x < self.terminals:
                    out[to] = x
                    to += 1
                else:
                    j = x - self.terminals
                    n = self.lengths[j]
                    out[to : to + n] = out[starts[j] : starts[j] + n]
                    to += n
        self.expansions, self.expansion_starts = out, starts

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.terminals
        index = np.where(rule, symbols - self.terminals, 0)
        sizes = np.where(rule, self.lengths[index] if len(self.lengths) else 1, 1)
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        out[(ends - sizes)[~rule]] = symbols[~rule]
        n = sizes[rule]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((ends - sizes)[rule], n) + inner] = self.expansions[np.repeat(self.expansion_starts[index[rule]], n) + inner]
        return out

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def ids(self, k: int, a: int = 0, b: int | None = None) -> np.ndarray:
        symbols = self.symbols[self.firsts[k] : self.firsts[k + 1]]
        sizes = np.where(symbols >= self.terminals, self.lengths[np.maximum(symbols - self.terminals, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(sizes)
        b = int(ends[-1]) if b is None else min(b, int(ends[-1]))
        if a >= b:
            return np.empty(0, np.uint32)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
        skipped = int(ends[i] - sizes[i])
        return self._expand(symbols[i : j + 1])[a - skipped : b - skipped]


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seq = before = held = 0
        docs: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            ids.clear()
            payload = pack(docs, np.concatenate(counts), flat, encode.vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int64()), (seq, pa.int64()), (before, pa.int64()), (held, pa.int64()), (payload, pa.binary()))], names=["part", "seq", "before", "n_tokens", "payload"])

        for batch in chunks(batches, "text", SLICE_BYTES):
            some, n = encode(batch.column("text"))
            names, ends, at = batch.column("doc_id").to_pylist(), np.cumsum(n), 0
            while at < len(n):
                done = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, done + SHARD_IDS - held, "right"))
                if to == at and not held:
                    to = at + 1
                if to > at:
                    docs += names[at:to]
                    counts.append(n[at:to])
                    ids.append(some[done : ends[to - 1]])
                    held += int(ends[to - 1]) - done
                    at = to
                if at < len(n):
                    yield flush()
                    seq, before, held, docs, counts, ids = seq + 1, before + held, 0, [], [], []
        if docs:
            yield flush()

    return run


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Packed shards of ``docs(doc_id, text)`` in ascending doc_id order (null first; equal ones by text).

    ``part, seq`` order the shards, ``before`` counts the ids before the shard in its part.  Null text is
    empty and still has its end id.  An empty table has no shard.  Repeated rows each have their ids; other
    columns are ignored.  A task holds one shard's ids (4 bytes each; a longer single text is a shard of its
    own) and, while it encodes, some 45 times a slice of 1 MB of text, or 12 times a longer single text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return in_arrow(rows, _shards(tokenizer_path), SHARDS)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column("payload")[i].as_py())
            raw = shard.all_ids().astype("<u4").tobytes()
            base = batch.column("base")[i].as_py()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base, pa.int64()), pa.array(np.diff(shard.starts), pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def documents(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the shards: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; the running sum is over parts, of which there
    are as many as write tasks, so the broadcast table has a fixed bound.
    """
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    rows = shards.join(F.broadcast(sums), "part").select((F.col("part_start") + F.col("before")).alias("base"), "payload")
    return in_arrow(rows, _documents, DOCS)


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` as shards in the shared folder, read them back, and describe each document."""
    return documents(written(encode(docs, tokenizer_path), "token-shards"))
