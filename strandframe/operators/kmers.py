"""K-mers of many sequences, coded at two bits a base in one Arrow pass; k-mers become rows only where they have to meet.

A k-mer with a letter other than A, C, G and T is kept as it is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandframe.session import stored

U = np.uint64
#: Bases that are worked on at once, bits of a dense count's code in one row, and the most bits of a filter's address.
PIECE, ROW, MOST_BITS = 1 << 21, 16, 28
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def windows(seqs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all sequences, sequence of each k-mer, place of its first letter, whether it is of A, C, G and T alone), in order."""
    size = np.array([len(s) for s in seqs], np.int64)
    text = np.frombuffer(b"".join(seqs), np.uint8)
    many = np.maximum(size - k + 1, 0)
    owner = np.repeat(np.arange(len(seqs)), many)
    place = np.arange(len(owner)) + np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many)
    odd = np.concatenate(([0], np.cumsum(_CODE[text] > 3)))
    return text, owner, place, odd[place + k] == odd[place]


def codes(text: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k-mers at these places as numbers, two bits a base, the first base highest; k is 32 at most."""
    word, size, got, out = _CODE[text].astype(np.uint64) & U(3), 1, 0, np.zeros(len(place), np.uint64)
    while True:
        if k & size:
            out = out << U(2 * size) | word[place + got]
            got += size
        if 2 * size > k:
            return out
        more = np.zeros_like(word)
        more[: len(word) - size] = word[size:]
        word = word << U(2 * size) | more
        size *= 2


def _letters(text: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    return text[place[:, None] + np.arange(k)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and sequences, PIECE letters at a time."""
    ids, seqs, n = [], [], 0
    for b in batches:
        for sid, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if seq:
                ids.append(sid), seqs.append(seq)
                n += len(seq)
            if n > PIECE:
                yield ids, seqs
                ids, seqs, n = [], [], 0
    if seqs:
        yield ids, seqs


def _fixed(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])


def kmer_counts(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, n): number of places of each k-mer of (sid, seq), k being 12 at most.

    Each task counts the k-mers of bases in one array of all codes and gives that array in rows of 65,536 counts, so a task sends as
    much however long its sequences are; there are as many tasks as the session's parallelism. Other k-mers are rows with their counts.
    """
    if not 0 < k <= 12:
        raise ValueError("k must be 1 to 12")
    wide = min(1 << ROW, 4**k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, dense = ["part", "counts", "kmer", "n"], np.zeros(4**k, np.int64)
        for _, seqs in _pieces(batches):
            beyond = [s for s in seqs if not s.isascii()]
            text, _, place, pure = windows([s.encode() for s in seqs if s.isascii()], k)
            np.add.at(dense, codes(text, place[pure], k), 1)
            others = _fixed(_letters(text, place[~pure], k)).value_counts()
            kmers, n = others.field(0).cast(pa.binary()).cast(pa.string()), others.field(1)
            if beyond:
                written = [s[i : i + k] for s in beyond for i in range(len(s) - k + 1)]
                kmers, n = pa.concat_arrays([kmers, pa.array(written, pa.string())]), pa.concat_arrays([n, pa.array([1] * len(written), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), kmers, n], names)
        for at in range(0, len(dense), wide):
            if (own := dense[at : at + wide]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at // wide], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        for part, counts in total.items():
            at = np.flatnonzero(counts)
            code = at + part * wide
            letters = np.frombuffer(b"ACGT", np.uint8)[code[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3]
            yield pa.RecordBatch.from_arrays([_fixed(letters).cast(pa.binary()).cast(pa.string()), pa.array(counts[at])], ["kmer", "n"])

    tasks = sequences.sparkSession.sparkContext.defaultParallelism
    found = stored(sequences.select("sid", "seq").coalesce(tasks).mapInArrow(count, "part int, counts binary, kmer string, n long"))
    dense = found.where("part IS NOT NULL").select("part", "counts").repartition(tasks, "part").mapInArrow(add, "kmer string, n long")
    return dense.unionByName(found.where("part IS NULL").groupBy("kmer").agg(F.sum("n").alias("n")))


def _mixed(key: np.ndarray) -> np.ndarray:
    """Keys as hashes whose highest bits are the address in a filter."""
    return key * U(0x9E3779B97F4A7C15)


def _hashed(letters: np.ndarray) -> np.ndarray:
    """One number for each row of letters."""
    words = np.zeros((len(letters), -(-letters.shape[1] // 8) * 8), np.uint8)
    words[:, : letters.shape[1]] = letters
    out = np.zeros(len(letters), np.uint64)
    for w in words.view(np.uint64).T:
        out = (out ^ w) * U(0xD6E8FEB86659FD93)
        out ^= out >> U(32)
    return out


def distinct_kmers(sequences: DataFrame, k: int, known: tuple | None = None) -> DataFrame:
    """(sid, kmer, hash): k-mers of (sid, seq), once for each piece of work, k being 9 to 32.

    kmer is a code of 8 bytes, or the letters if they aren't all bases. With ``known``, the result of ``kmer_filter``, only k-mers that
    may be in its set are given: all of these and few others.
    """
    if not 8 < k <= 32:
        raise ValueError("k must be 9 to 32")
    kind = sequences.schema["sid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = (known[0], np.frombuffer(known[1].value, np.uint8)) if known else (0, None)
        for b in batches:
            target = b.schema.field(0).type
            for ids, seqs in _pieces(iter([b])):
                raw = [s.encode() if s.isascii() else b"" for s in seqs]
                text, owner, place, pure = windows(raw, k)
                letters = _letters(text, place[~pure], k)
                for key, own, form in ((codes(text, place[pure], k), owner[pure], None), (_hashed(letters), owner[~pure], letters)):
                    mixed = _mixed(key)
                    if known:
                        at = mixed >> U(64 - bits)
                        stay = np.flatnonzero(held[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1)
                        key, own, mixed, form = key[stay], own[stay], mixed[stay], None if form is None else form[stay]
                    if len(key):
                        written = _fixed((key.astype(">u8") if form is None else form).view(np.uint8).reshape(len(key), -1)).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, target).take(pa.array(own)), written, pa.array(mixed.view(np.int64))], ["sid", "kmer", "hash"])
                for sid, s in zip(ids, seqs):
                    if not s.isascii():  # never filtered
                        every = [s[i : i + k].encode() for i in range(len(s) - k + 1)]
                        yield pa.RecordBatch.from_arrays([pa.array([sid] * len(every), target), pa.array(every, pa.binary()), pa.array([0] * len(every), pa.int64())], ["sid", "kmer", "hash"])

    return sequences.select("sid", "seq").mapInArrow(run, f"sid {kind}, kmer binary, hash long")


def kmer_filter(kmers: DataFrame) -> tuple:
    """(bits, broadcast bit map) of the hashes of k-mers: one bit each at 16 bits a k-mer, of 32 MB at most; fuller ones let more others through."""
    spark = kmers.sparkSession
    bits = max(17, min(MOST_BITS, (16 * kmers.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> U(64 - bits)
            part = (at >> U(17)).astype(np.int64)
            for p in np.unique(part):
                own = maps.setdefault(int(p), np.zeros(1 << 17, bool))
                own[(at[part == p] & U((1 << 17) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())], ["part", "map"])

    whole = np.zeros(1 << bits - 3, np.uint8)
    # by the part of the map, so each part is filled by one task
    for r in kmers.select("hash").repartition(F.shiftrightunsigned("hash", 64 - bits + 17)).mapInArrow(fill, "part int, map binary").toLocalIterator():
        whole[r.part << 14 : (r.part + 1) << 14] |= np.frombuffer(r.map, np.uint8)
    return bits, spark.sparkContext.broadcast(whole.tobytes())
