"""Column functions for sequences, packed marks and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ALPHABET = "ACGTacgt"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: str | Column) -> Column:
    """Reverse complement; letters other than A, C, G, T keep their place and case."""
    return F.reverse(F.translate(_col(seq), ALPHABET, "TGCAtgca"))


def strict_reverse_complement(seq: str | Column) -> Column:
    """As reverse_complement, but N is allowed as well and any other letter is an error."""
    s = _col(seq)
    return F.when(s.rlike("[^ACGTNacgtn]"), F.raise_error(F.concat(F.lit("not a base in "), F.substring(s, 1, 40)))).otherwise(reverse_complement(s))


def subsequence(seq: str | Column, bgn: str | Column, end: str | Column) -> Column:
    """The half-open stretch [bgn, end)."""
    b, e = _col(bgn), _col(end)
    return F.substring(_col(seq), b + 1, e - b)


def to_bytes(seq: str | Column) -> Column:
    return F.encode(_col(seq), "US-ASCII")


def from_bytes(raw: str | Column) -> Column:
    return F.decode(_col(raw), "US-ASCII")


def bit_planes(seq: str | Column) -> Column:
    """The low and the high bits of the 2-bit codes (A 0, C 1, G 2, T 3) as two strings of 0 and 1."""
    s = F.upper(_col(seq))
    return F.struct(F.translate(s, "ACGT", "0101").alias("low"), F.translate(s, "ACGT", "0011").alias("high"))


def mark_hash(x: str | Column) -> Column:
    return F.shiftrightunsigned(_col(x), 8)


def mark_span(x: str | Column) -> Column:
    return _col(x).bitwiseAND(F.lit(255)).cast("int")


def mark_rid(y: str | Column) -> Column:
    return F.shiftrightunsigned(_col(y), 32).cast("int")


def mark_pos(y: str | Column) -> Column:
    return F.shiftright(_col(y).bitwiseAND(F.lit(4294967295)), 1).cast("int")


def mark_strand(y: str | Column) -> Column:
    return _col(y).bitwiseAND(F.lit(1)).cast("int")


def pack_mark(hash_: Column, span: Column, rid: Column, pos: Column, strand: Column) -> Column:
    """The packed pair (x, y) of a mark."""
    x = F.shiftleft(hash_.cast("long"), 8).bitwiseOR(span.cast("long"))
    y = F.shiftleft(rid.cast("long"), 32).bitwiseOR(F.shiftleft(pos.cast("long"), 1)).bitwiseOR(strand.cast("long"))
    return F.struct(x.alias("x"), y.alias("y"))


def pair_name(h0: str | Column, h1: str | Column) -> Column:
    """The two hashes in hexadecimal, 16 digits each, joined by an underscore."""
    hexed = lambda h: F.lpad(F.lower(F.hex(_col(h))), 16, "0")
    return F.concat_ws("_", hexed(h0), hexed(h1))


def file_stem(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def region_name(base: Column, ctg: Column, bgn: Column, end: Column, orientation: Column) -> Column:
    """base::ctg_bgn_end_orientation, as fetched regions are named."""
    return F.concat(base, F.lit("::"), F.concat_ws("_", ctg, bgn, end, orientation))


def last_attribute(attributes: str | Column) -> Column:
    """The value of the last attribute of a GTF line, without quotes: the gene name."""
    fields = F.split(F.trim(F.regexp_replace(_col(attributes), r";\s*$", "")), ";")
    return F.trim(F.translate(F.element_at(F.split(F.trim(F.element_at(fields, -1)), " "), -1), '"', ""))


def attribute_map(attributes: str | Column) -> Column:
    """Attributes written as key=value;... as a map; the last of repeated keys stays."""
    entries = F.filter(F.split(_col(attributes), ";"), lambda e: F.trim(e) != "")
    key = lambda e: F.trim(F.regexp_extract(e, "^([^=]*)", 1))
    pair = lambda e: F.struct(key(e).alias("k"), F.trim(F.regexp_replace(e, "^[^=]*=?", "")).alias("v"))
    # of repeated keys only the last is taken
    last = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda f: key(f) == key(e))
    return F.map_from_entries(F.transform(F.filter(entries, last), pair))


def hue(id_: str | Column) -> Column:
    """The two numbers that colour a bundle."""
    i = _col(id_)
    return F.struct(F.pmod(i * 57, F.lit(59)).alias("a"), (93 - F.pmod(i * 31, F.lit(47))).alias("b"))


def kmers(seq: str | Column, k: int) -> Column:
    """All k-mers of a sequence, the last one included; none for shorter ones."""
    s = _col(seq)
    n = F.length(s) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
