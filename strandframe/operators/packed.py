"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton marks, in one pass over a record, the delimiters, the quotes and every known whole
value. Dynamic programming over the marks then picks the cover of the text with the highest score: a segment that
is a known whole value or a quoted literal scores and protects the delimiters inside it, all else is split at its
delimiters. The dictionary is either a list of bounded size or a table of any size, of which each record gets the values
that stand in it. It decides where known values stand without their quotes; a text split by quotes alone needs neither
dictionary nor marks, as two expressions find its fields and their values.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FIELD_END, VALUE_END = ";", ",|"
KNOWN, QUOTED = 2, 1

VALUES = "tag string, pos int, val string"


def automaton(known: list[str], protect: bool):
    """Delimiters, the quote, and each known value: in its quoted spelling and, if ``protect``, also as it is."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for mark in FIELD_END + VALUE_END + '"':
        a.add_word(mark, (len(mark), 0))
    for value in known:
        if value:
            quoted = '"' + value.replace('"', '""') + '"'
            a.add_word(quoted, (len(quoted), KNOWN))
            if protect and value[0] not in '";,|' and any(c in value for c in FIELD_END + VALUE_END):
                a.add_word(value, (len(value), KNOWN))
    a.make_automaton()
    return a


def _literal_end(text: str, at: int) -> int:
    """The end of the quoted literal that begins at ``at``; -1 if it isn't closed. A doubled quote stays inside."""
    while (at := text.find('"', at + 1)) >= 0:
        if text[at + 1 : at + 2] != '"':
            return at + 1
        at += 1
    return -1


def cover(text: str, marks) -> list[tuple[int, str]]:
    """The delimiters that remain outside the protected segments of the best cover, as (place, delimiter).

    The table is kept at the marks, as nothing can be chosen between them: best[k] is the best score of the text from
    the k-th mark on, found from the right.
    """
    spans: dict[int, list[tuple[int, int]]] = {}
    places: list[int] = []
    for end, (size, score) in marks.iter(text):
        bgn = end + 1 - size
        if score:
            edge_l, edge_r = text[:bgn].rstrip(" "), text[end + 1 :].lstrip(" ")
            whole = (not edge_l or edge_l[-1] in "=;,|" or text[bgn] == '"') and (not edge_r or edge_r[0] in ";,|")
            if whole:
                spans.setdefault(bgn, []).append((end + 1, score))
        else:
            places.append(bgn)
    for at in places:
        if text[at] == '"' and (to := _literal_end(text, at)) > 0:
            spans.setdefault(at, []).append((to, QUOTED))
    if not spans:
        return [(i, text[i]) for i in places if text[i] != '"']
    at = sorted({*places, *spans, *(e for s in spans.values() for e, _ in s), len(text)})
    index = {p: k for k, p in enumerate(at)}
    best, step = [0] * len(at), [0] * len(at)
    for k in range(len(at) - 2, -1, -1):
        best[k], step[k] = best[k + 1], k + 1
        for to, score in spans.get(at[k], ()):
            # the more is protected the better, and of equal segments the known one; an opening quote can't be skipped
            value = best[index[to]] + score + 4 * (to - at[k])
            if value > best[k] or text[at[k]] == '"' and step[k] == k + 1:
                best[k], step[k] = value, index[to]
    out, k = [], 0
    while k < len(at) - 1:
        if step[k] == k + 1 and text[at[k]] in FIELD_END + VALUE_END:
            out.append((at[k], text[at[k]]))
        k = step[k]
    return out


def _value(text: str) -> str:
    """The value in a segment: literal inside quotes, else without outer blanks."""
    text = text.strip(" ")
    if len(text) > 1 and text[0] == '"' and text[-1] == '"':
        return text[1:-1].replace('""', '"')
    return text


def _tag_of(segment: str) -> tuple[str | None, str]:
    """Splits the first segment of a field into its tag and its first value."""
    text = segment.strip(" ")
    quote = text.find('"')
    eq = text.find("=")
    if eq >= 0 and (quote < 0 or eq < quote):
        return text[:eq].strip(" ") or None, text[eq + 1 :]
    if quote > 0 and text[quote - 1] == " ":
        return text[:quote].strip(" "), text[quote:]
    return None, segment


_PLAIN_VALUES = re.compile("[,|]")


def _plain_segment(text: str) -> list[tuple[str | None, int, str]]:
    """As ``segment``, for a text in which nothing is protected."""
    out, tag, seen = [], None, {}
    for field in text.split(";"):
        for i, value in enumerate(_PLAIN_VALUES.split(field) if "," in field or "|" in field else (field,)):
            if not i and (eq := value.find("=")) >= 0 and (own := value[:eq].strip(" ")):
                tag, value = own, value[eq + 1 :]
            value = value.strip(" ")
            if value:
                seen[tag] = seen.get(tag, 0) + 1
                out.append((tag, seen[tag], value))
    return out


_LITERAL = '"(?:[^"]|"")*+"'
_FIELDS, _VALUES = re.compile(f"(?:{_LITERAL}|[^;])+"), re.compile(f"(?:{_LITERAL}|[^,|])+")


def quoted_segment(text: str | None) -> list[tuple[str | None, int, str]]:
    """As ``segment`` without a dictionary: only quotes protect, so two expressions find the fields and their values."""
    if not text:
        return []
    if '"' not in text:
        return _plain_segment(text)
    out, tag, seen = [], None, {}
    for field in _FIELDS.findall(text):
        lead = field[0] not in VALUE_END
        for value in _VALUES.findall(field) if "," in field or "|" in field else (field,):
            if lead:
                own, rest = _tag_of(value)
                if own is not None:
                    tag, value = own, rest
                lead = False
            value = _value(value)
            if value:
                seen[tag] = seen.get(tag, 0) + 1
                out.append((tag, seen[tag], value))
    return out


def segment(text: str | None, marks, bare: bool = True) -> list[tuple[str | None, int, str]]:
    """(tag, position, value) for each non-empty value, in order. Values before any tag have a null tag.

    Without ``bare`` all known values in ``marks`` are in their quoted spelling, so a text without a quote is only split.
    """
    if not text:
        return []
    if not bare and '"' not in text:
        return _plain_segment(text)
    out, tag, seen, first, bgn = [], None, {}, True, 0
    for at, mark in [*cover(text, marks), (len(text), ";")]:
        piece = text[bgn:at]
        if first:
            own, rest = _tag_of(piece)
            if own is not None:
                tag, piece = own, rest
        value = _value(piece)
        if value:
            seen[tag] = seen.get(tag, 0) + 1
            out.append((tag, seen[tag], value))
        first, bgn = mark in FIELD_END, at + 1
    return out


def candidates(text: str, longest: int) -> set[str]:
    """The parts of a text, up to ``longest`` letters, that ``cover`` would protect if they were known values.

    These are the closed quoted literals, and what lies between two edges (blanks beside an edge may belong to it or not), in
    so far as it holds a delimiter.
    """
    inner = FIELD_END + VALUE_END
    delimiters = [i for i, c in enumerate(text) if c in inner]
    out = {text[i + 1 : to - 1].replace('""', '"') for i, c in enumerate(text) if c == '"' and (to := _literal_end(text, i)) > 0}
    out = {v for v in out if len(v) <= longest and any(c in v for c in inner)}
    ends = set()
    for e in (*delimiters, len(text)):
        ends.add(e)
        while e and text[e - 1] == " ":
            e -= 1
            ends.add(e)
    stops, begins = sorted(ends), set()
    for b in (0, *(i + 1 for i, c in enumerate(text) if c in "=" + inner)):
        while b < len(text):
            begins.add(b)
            if text[b] != " ":
                break
            b += 1
    for b in begins:
        k = bisect_left(delimiters, b)
        if k < len(delimiters) and text[b] not in '"' + inner:
            out.update(text[b:e] for e in stops[bisect_right(stops, delimiters[k]) : bisect_right(stops, b + longest)])
    return out


def _quoted(df: DataFrame, field: str) -> DataFrame:
    """(v): every quoted value that holds a delimiter, as it is spelled."""
    literal = F.explode(F.regexp_extract_all(F.col(field), F.lit('"((?:[^"]|"")*)"'), F.lit(1)))
    return df.select(literal.alias("v")).where("v rlike '[;,|]'")


def learned_values(df: DataFrame, field: str) -> DataFrame:
    """(v): all quoted values that hold a delimiter, each once."""
    return _quoted(df, field).select(F.replace("v", F.lit('""'), F.lit('"')).alias("v")).distinct()


def learn_dictionary(df: DataFrame, field: str, size: int = 10_000) -> list[str]:
    """The ``size`` most frequent quoted values that hold a delimiter, counted over all rows (ties by value)."""
    counted = _quoted(df, field).groupBy("v").count()
    return [r.v.replace('""', '"') for r in counted.orderBy(F.desc("count"), "v").limit(size).select("v").collect()]


def _with_known(src: DataFrame, known: DataFrame) -> DataFrame:
    """Adds to (key, field) the values of ``known`` that may stand in the field.

    Parts and values meet by their hashes, and records by theirs: a clash adds a value that doesn't stand in the field or
    is found there anyway, so it changes nothing.
    """
    longest = known.agg(F.max(F.length("v"))).first()[0] or 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids, found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["rec", "part"])

        for batch in batches:
            ids, found = [], []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in candidates(text, longest):
                    ids.append(rec), found.append(part)
                    if len(ids) >= 50_000:
                        yield made(ids, found)
                        ids, found = [], []
            yield made(ids, found)

    marked = src.withColumn("rec", F.xxhash64("key", "field"))
    own = marked.select("rec", "field").mapInArrow(parts, "rec long, part string").select("rec", F.xxhash64("part").alias("h"))
    met = own.join(known.select(F.xxhash64("v").alias("h"), "v"), "h").groupBy("rec").agg(F.collect_set("v").alias("known"))
    return marked.join(met, "rec", "left").select("key", "field", "known")


def split_packed(df: DataFrame, key: str, field: str, known: list[str] | DataFrame | None = None, protect: bool = False) -> DataFrame:
    """One row (key, tag, pos, val) per value packed in ``field``.

    Outside protected segments ``;`` ends a field, ``,`` and ``|`` end a value, and a field without a tag continues
    the tag before it. ``known`` is the dictionary of whole values: a list (its size is the caller's bound) or a table (v)
    of any size; with ``protect`` its values are kept whole even where they aren't quoted, without it quotes decide alone and
    ``known`` isn't read. A null or empty field gives no rows; rows repeated with the same key and field give one case; values
    in front of the first tag have a null tag; an unclosed quote is an ordinary letter; further columns aren't read.
    """
    known = known if protect else None
    listed = not isinstance(known, DataFrame)
    words = list(known or []) if listed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = automaton(words, True) if protect else None
        for batch in batches:
            if not listed:  # the values of a batch only protect what the whole dictionary would
                marks = automaton(sorted({v for vs in batch.column(2).to_pylist() for v in vs or ()}), True)
            keys, tags, places, values = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for tag, pos, val in segment(text, marks) if protect else quoted_segment(text):
                    keys.append(k), tags.append(tag), places.append(pos), values.append(val)
                    if len(keys) >= 50_000:
                        yield _rows(batch, keys, tags, places, values)
                        keys, tags, places, values = [], [], [], []
            yield _rows(batch, keys, tags, places, values)

    def _rows(batch, keys, tags, places, values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(tags, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.string())], ["key", "tag", "pos", "val"])

    src = df.select(F.col(key).alias("key"), F.col(field).alias("field")).where("field IS NOT NULL").distinct()
    kind = df.schema[key].dataType.simpleString()
    if not listed:
        src = _with_known(src, known)
    return src.mapInArrow(run, f"key {kind}, {VALUES}").withColumnRenamed("key", key)
