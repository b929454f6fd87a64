"""Mixing of sources to target weights by raking, with capped repeats.

Documents get their size in tokens of a public tokenizer. The sizes are summed over the cells source x language x
topic; iterative proportional fitting rakes the cells' token weights to the target shares of the sources and to the
languages' and topics' shares in the corpus, under each source's cap on repeats. A document's expected number of
copies is its cell's weight; whole copies are certain, and the fraction is settled by order sampling: in each source
the documents are taken in the order of a seeded hash over their probability, until the source's tokens are reached.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Languages and topics below this share of the tokens are raked together, so at most 1 / share of each are told apart.
LEAST_SHARE = 0.01
BINS = 4096
ROUNDS = 200


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """``keep`` and the number of tokens of each text (0 for null). The vocabulary file is read by each worker."""
    form = df.select(*keep).schema.add("tokens", "long")
    letters = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(t: str | None) -> int:
            if not t or len(t) <= letters:
                return len(own.encode_ordinary(t)) if t else 0
            # very long texts are cut before a blank that follows a letter, where the pattern always splits
            n = bgn = 0
            while bgn < len(t):
                end = min(len(t), bgn + letters)
                while end < len(t) and not (t[end] == " " and t[end - 1].isalnum()):
                    end += 1
                n, bgn = n + len(own.encode_ordinary(t[bgn:end])), end
            return n

        for batch in batches:
            n = pa.array([size(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, form)


def rake(cells: list[tuple[str, str, str, float]], shares: dict[str, float], caps: dict[str, float | None], total: float) -> list[float]:
    """Weights (copies) of cells (source, language, topic, tokens) so that sources have their shares of ``total``.

    Languages and topics are raked to their shares in the corpus as far as the caps allow; the sources come last and
    hold exactly, as ``total`` is feasible: no source needs more than its cap.
    """
    margins = []
    everything = sum(c[3] for c in cells)
    for k in (1, 2):
        goal: dict[str, float] = {}
        for c in cells:
            goal[c[k]] = goal.get(c[k], 0.0) + c[3] / everything * total
        margins.append((k, goal))
    by_source: dict[str, list[int]] = {}
    for i, c in enumerate(cells):
        by_source.setdefault(c[0], []).append(i)
    available = {s: sum(cells[i][3] for i in own) for s, own in by_source.items()}
    top = {s: float("inf") if caps[s] is None else caps[s] for s in by_source}
    w = [shares[c[0]] * total / available[c[0]] for c in cells]
    for _ in range(ROUNDS):
        before = list(w)
        for k, goal in margins:
            now: dict[str, float] = {}
            for i, c in enumerate(cells):
                now[c[k]] = now.get(c[k], 0.0) + w[i] * c[3]
            w = [min(w[i] * goal[c[k]] / now[c[k]], top[c[0]]) if now[c[k]] else w[i] for i, c in enumerate(cells)]
        for s, own in by_source.items():
            _fill(w, own, cells, shares[s] * total, top[s])
        if max(abs(a - b) for a, b in zip(w, before)) < 1e-9:
            break
    return w


def _fill(w: list[float], own: list[int], cells, goal: float, top: float) -> None:
    """Scales the weights of one source to its goal; weights that reach the cap stay there and the others make up for it.

    The largest weights reach the cap first, so one pass in their order finds how many do.
    """
    order = sorted(own, key=lambda i: -w[i])
    rest = [0.0]  # tokens of the last cells, from the end
    for i in reversed(order):
        rest.append(rest[-1] + w[i] * cells[i][3])
    held, factor, capped = 0.0, 0.0, len(order)
    for k, i in enumerate(order):
        now = rest[len(order) - k]
        factor = max((goal - held) / now, 0.0) if now else 0.0
        if w[i] * factor <= top:
            capped = k
            break
        held += top * cells[i][3]
    for k, i in enumerate(order):
        w[i] = top if k < capped else w[i] * factor


def _pooled(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the value of ``column`` if it has the least share of tokens, else 'other'."""
    sums = df.groupBy(column).agg(F.sum("tokens").alias("n"))
    whole = df.agg(F.sum("tokens")).first()[0] or 0
    large = [r[0] for r in sums.where(F.col("n") >= whole * LEAST_SHARE).select(column).collect()]  # at most 1 / LEAST_SHARE
    return df.withColumn(out, F.when(F.col(column).isin(large), F.col(column)).otherwise("other")) if large else df.withColumn(out, F.lit("other"))


def mix_sources(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, lang: Column, topic: Column, total: int | None = None, seed: int = 0, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix (key, source, tokens, copies), its report (source, target_share, docs, tokens, reached_share, ...) and its margins.

    The margins (margin, value, wanted_share, reached_share) are those that were raked: each source, language and topic, with its
    share of the tokens. Languages and topics below LEAST_SHARE of the tokens are one value, 'other'.

    ``targets`` has source, weight (relative) and max_repeats (null: no cap); it is a small table of settings and is
    collected. Sources are compared without outer blanks and case. Sources without a target, with a null source or a
    weight of 0 or less aren't in the mix; targets without tokens reach 0, and the weights of the others are taken
    relative to each other. The size is ``total`` tokens, or all that the caps allow if that is less; without
    ``total``, as many as the mixed sources have, again within the caps. Texts without tokens aren't drawn. Ties of the
    hash are drawn together. Repeated rows of a key are separate documents; empty tables give an empty mix.
    """
    clean = lambda c: F.lower(F.trim(c))
    wanted = {}
    for r in targets.select(clean(F.col("source")).alias("s"), F.col("weight").cast("double").alias("w"), "max_repeats").where("s IS NOT NULL AND w > 0").collect():
        wanted[r.s] = (r.w, r.max_repeats)
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), clean(F.col(source)).alias("source"), F.coalesce(lang, F.lit("none")).alias("lang"), F.coalesce(topic, F.lit("none")).alias("topic"))
    src = src.where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    sized = cut(count_tokens(src, "text", ["key", "source", "lang", "topic"], path).where("tokens > 0"))
    held = _pooled(_pooled(sized, "lang", "l"), "topic", "t").select("key", "source", "l", "t", "tokens")
    # sources x at most 1 / LEAST_SHARE languages x as many topics
    cells = [(r.source, r.l, r.t, float(r.n)) for r in held.groupBy("source", "l", "t").agg(F.sum("tokens").alias("n")).orderBy("source", "l", "t").collect()]
    have: dict[str, float] = {}
    for c in cells:
        have[c[0]] = have.get(c[0], 0.0) + c[3]
    scale = sum(wanted[s][0] for s in have)
    shares = {s: wanted[s][0] / scale for s in have}
    caps = {s: None if wanted[s][1] is None else float(wanted[s][1]) for s in have}
    feasible = min((caps[s] * have[s] / shares[s] for s in have if caps[s] is not None), default=float("inf"))
    goal = min(float(sum(have.values()) if total is None else total), feasible)
    spark = docs.sparkSession
    weights = rake(cells, shares, caps, goal) if cells else []
    settings = spark.createDataFrame([(c[0], c[1], c[2], w) for c, w in zip(cells, weights)], "source string, l string, t string, copies double")
    placed = held.join(F.broadcast(settings), ["source", "l", "t"])  # one row a cell
    sure, part = F.floor("copies"), F.col("copies") - F.floor("copies")
    u = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    drawn = cut(placed.select("key", "source", "l", "t", "tokens", sure.cast("long").alias("sure"), F.when(part > 1e-12, u / part).alias("turn")))
    limit = _thresholds(drawn, {s: shares[s] * goal for s in have})
    limits = spark.createDataFrame(list(limit.items()), "source string, turns double")
    mix = drawn.join(F.broadcast(limits), "source")  # one row a source
    mix = mix.select("key", "source", "l", "t", "tokens", (F.col("sure") + F.when(F.col("turn") <= F.col("turns"), 1).otherwise(0)).alias("copies")).where("copies > 0")
    return mix.select(F.col("key").alias(key), "source", "tokens", "copies"), _report(mix, wanted, shares, have), _margins(mix, cells, shares)


def _margins(mix: DataFrame, cells: list[tuple[str, str, str, float]], shares: dict[str, float]) -> DataFrame:
    everything = sum(c[3] for c in cells)
    goal: dict[tuple[str, str], float] = {("source", s): x for s, x in shares.items()}
    for k, margin in ((1, "language"), (2, "topic")):
        for c in cells:
            goal[margin, c[k]] = goal.get((margin, c[k]), 0.0) + c[3] / everything
    wanted = mix.sparkSession.createDataFrame([(*k, x) for k, x in goal.items()], "margin string, value string, wanted_share double")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(c).alias("value")) for m, c in (("source", "source"), ("language", "l"), ("topic", "t"))))).alias("m")
    got = mix.select(each, (F.col("tokens") * F.col("copies")).alias("n")).groupBy("m.margin", "m.value").agg(F.sum("n").alias("n"))
    whole = mix.agg(F.sum(F.col("tokens") * F.col("copies")).alias("whole"))
    out = wanted.join(got, ["margin", "value"], "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("margin", "value", "wanted_share", F.coalesce(F.col("n") / F.col("whole"), F.lit(0.0)).alias("reached_share"))


def _thresholds(drawn: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """The turn up to which each source's documents get their additional copy, so that its tokens come nearest to the goal.

    Turns are found by histograms of token sums, twice refined: bins x sources rows come to the driver at a time.
    """
    if not goals:
        return {}
    spark = drawn.sparkSession
    base = {r.source: float(r.n) for r in drawn.groupBy("source").agg(F.sum(F.col("sure") * F.col("tokens")).alias("n")).collect()}
    low = {s: 0.0 for s in goals}
    high = {s: 4.0 for s in goals}  # far beyond 1, where the expectation lies
    below = dict(base)
    for _ in range(3):
        ranges = spark.createDataFrame([(s, low[s], high[s]) for s in goals], "source string, low double, high double")
        inside = drawn.where("turn IS NOT NULL").join(F.broadcast(ranges), "source").where("turn > low AND turn <= high")
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("turn") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int")
        rows = inside.groupBy("source", bin_.alias("b")).agg(F.sum("tokens").alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last")).orderBy("source", "b").collect()
        for s in goals:
            sum_, lo, hi = below[s], low[s], low[s]
            for r in (r for r in rows if r.source == s):
                if sum_ + r.n > goals[s]:
                    nearer = sum_ + r.n - goals[s] < goals[s] - sum_
                    hi = r.last
                    if r.first == r.last:  # one turn: it is taken whole or not
                        lo = hi = r.last if nearer else lo
                    break
                sum_, lo = sum_ + r.n, r.last
                hi = lo
            low[s], high[s], below[s] = lo, max(hi, lo), sum_
    # what remains of the last bin is less than a 2^-36 part of the turns
    return {s: low[s] for s in goals}


def _report(mix: DataFrame, wanted: dict, shares: dict[str, float], have: dict[str, float]) -> DataFrame:
    spark = mix.sparkSession
    asked = sum(w for w, _ in wanted.values())
    rows = [(s, w / asked, shares.get(s, 0.0), None if c is None else int(c), int(have.get(s, 0))) for s, (w, c) in sorted(wanted.items())]
    settings = spark.createDataFrame(rows, "source string, target_share double, share_of_present double, max_repeats int, available_tokens long")
    got = mix.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    out = settings.join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
    reached = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0))
    return out.select("source", "target_share", "share_of_present", reached.alias("reached_share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "available_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
