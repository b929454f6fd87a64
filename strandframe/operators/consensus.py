"""Consensus of groups of reads. Each group is one locus; its reads are worked on together in one Arrow stream."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

from strandframe.operators.chains import chain
from strandframe.operators.graph import Node, _graph, flip, weighted_walk
from strandframe.operators.grouped import grouped_scan
from strandframe.operators.shimmers import ShimmerSpec, sequence_marks

DBG_SPEC = ShimmerSpec(31, 31, 1, 0, False)
SPARSE_SPEC = ShimmerSpec(33, 33, 1, 0, False)
_TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def turned(seq: str) -> str:
    return seq.translate(_TURN)[::-1]


def kmer_consensus(reads: list[str], k: int, min_cov: int) -> str:
    """Consensus from the de Bruijn graph of k-mers, led by the first read where its k-mers have ``min_cov`` occurrences.

    Going back from the guide's last k-mer, the guide's own predecessor is taken if it is covered, else the predecessor
    with the heaviest way from a source. A cycle in the graph is an error.
    """
    if any(len(r) < k for r in reads):
        raise ValueError("reads must be at least as long as the k-mer")
    count: Counter[str] = Counter()
    into: dict[str, dict[str, None]] = defaultdict(dict)
    out: dict[str, dict[str, None]] = defaultdict(dict)
    for r in reads:
        mers = [r[i : i + k] for i in range(len(r) - k + 1)]
        count.update(mers)
        for a, b in zip(mers, mers[1:]):
            into[b][a] = out[a][b] = None
    waiting = {m: len(into[m]) for m in count}
    ready = [m for m in count if not waiting[m]]
    weight: dict[str, int] = {}
    back: dict[str, str | None] = {}
    while ready:
        m = ready.pop()
        best = max(into[m], key=lambda p: weight[p], default=None)
        weight[m], back[m] = count[m] + (weight[best] if best else 0), best
        for n in out[m]:
            waiting[n] -= 1
            if not waiting[n]:
                ready.append(n)
    if len(weight) < len(count):
        raise ValueError("the graph has a cycle")
    guide = [reads[0][i : i + k] for i in range(len(reads[0]) - k + 1)]
    own = dict(zip(guide[1:], guide))
    path, now = [guide[-1]], guide[-1]
    while True:
        lead = own.get(now)
        now = lead if lead is not None and count[lead] >= min_cov else back[now]
        if now is None:
            break
        path.append(now)
    path.reverse()
    return path[0] + "".join(m[-1] for m in path[1:])


def _places(seq: str, spec: ShimmerSpec, query: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(h0, h1, begin, end, orientation) of the pairs of a read."""
    h, p, _ = sequence_marks(seq.encode("ascii", "replace"), spec)
    h, p = h.tolist(), p.tolist()
    return [(min(a, b), max(a, b), x + 1, y + 1, int(a >= b if query else a > b)) for a, b, x, y in zip(h, h[1:], p, p[1:])]


def _pair_graph(reads: list[str], spec: ShimmerSpec):
    """Vertices' sequences and weights on both strands, and the links of adjoining pairs in order of the reads."""
    if spec.k % 2 == 0 or spec.min_span:
        raise ValueError("consensus needs an odd k and min_span 0")
    letters: dict[Node, str] = {}
    weight: Counter[tuple[int, int]] = Counter()
    links: dict[tuple[Node, Node], None] = {}
    for r in reads:
        last = None
        for h0, h1, b, e, o in sorted(_places(r, spec), key=lambda x: (x[2], x[3], x[0], x[1], x[4])):
            v, part = (h0, h1, o), r[b - spec.k : e]
            letters.setdefault(v, part)
            letters.setdefault(flip(v), turned(part))
            weight[h0, h1] += 1
            if last and last[1] == b:
                links[last[0], v] = None
                links[flip(v), flip(last[0])] = None
            last = (v, e)
    return letters, weight, list(links)


def _spell(nodes: list[Node], letters: dict[Node, str], weight, k: int) -> tuple[str, list[int]]:
    """The sequence of a path of vertices, and the coverage of each base."""
    seq, cov = "", []
    for v in nodes:
        part = letters[v] if not seq else letters[v][k:]
        seq += part
        cov += [weight[v[:2]]] * len(part)
    return seq, cov


def branch_consensus(reads: list[str], spec: ShimmerSpec = DBG_SPEC) -> list[tuple[str, list[int]]]:
    """A sequence for each branch of the weighted walk over the graph of pairs, from the first pair of the first read."""
    letters, weight, links = _pair_graph(reads, spec)
    if not links:
        return []
    per = defaultdict(int, {v: weight[v[:2]] for v in letters})
    out, path = [], []
    for v, _, leaf, *_ in weighted_walk(*_graph(links), per, links[0][0]):
        path.append(v)
        if leaf:
            out.append(_spell(path, letters, weight, spec.k))
            path = []
    return out


def guided_consensus(reads: list[str], min_cov: int, spec: ShimmerSpec = DBG_SPEC) -> tuple[str, list[int]]:
    """One sequence along the first read: its covered vertices are followed, the closest ahead first, elsewhere the heaviest."""
    letters, weight, links = _pair_graph(reads, spec)
    if not links:
        return "", []
    guide = {(h0, h1, o): b for h0, h1, b, _, o in _places(reads[0], spec, query=True) if weight[h0, h1] >= min_cov}
    after, _ = _graph(links)
    now, seen, path, last = links[0][0], set(), [], None
    while now is not None:
        seen.add(now)
        ahead = [w for w in after.get(now, ()) if w not in seen]
        here = guide.get(now)
        led = [w for w in ahead if w in guide and (here is None or guide[w] > here)]
        free = [w for w in ahead if w not in guide]
        path.append(now)
        if led:
            now = min(led, key=lambda w: (guide[w], w))
            last = len(path)
        else:
            now = max(free, key=lambda w: (weight[w[:2]], w), default=None)
    return _spell(path[: last + 1] if last else path, letters, weight, spec.k)


def sparse_consensus(reads: list[str], min_cov: int, guide: int = 0, spec: ShimmerSpec = SPARSE_SPEC) -> list[tuple[str, list[int]]]:
    """Corrected stretches of one read: its pairs that enough reads align to, and between them the most frequent patch.

    A gap is patched with the sequence that most other reads have between the two pairs, if ``min_cov`` agree; otherwise
    a new stretch begins.
    """
    if spec.k % 2 == 0 or spec.min_span:
        raise ValueError("consensus needs an odd k and min_span 0")
    index: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
    for i, r in enumerate(reads):
        for h0, h1, b, e, o in _places(r, spec):
            index[h0, h1].append((i, b, e, o))
    hits: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for h0, h1, b, e, o in _places(reads[guide], spec, query=True):
        found = index.get((h0, h1), [])
        own = Counter(i for i, *_ in found)
        if len(found) <= 32:
            for i, tb, te, to in found:
                if own[i] <= 32:
                    hits[i].append((b, e, o, tb, te, to))
    placed: dict[tuple[int, int, int], dict[int, tuple[int, int, int]]] = defaultdict(dict)
    total: Counter[tuple[int, int, int]] = Counter()
    for i, anchors in hits.items():
        if len(anchors) > 1:
            for a in chain(anchors, max_span=33, penalty=0.1, oriented=True)[0][1]:
                placed[a[:3]][i] = a[3:]
                total[a[:3]] += 1
    seq0, out, seq, cov, last = reads[guide], [], "", [], None
    for r in sorted(v for v, by in placed.items() if len(by) >= min_cov):
        patch, n = "", 0
        if last is not None and r[0] != last[1]:
            votes: Counter[str] = Counter()
            for i in placed[last].keys() & placed[r].keys() - {guide}:
                v, w = placed[last][i], placed[r][i]
                if v[0] < w[0] and v[1] < w[1] and v[1] < w[0]:
                    votes[reads[i][v[1] : w[0]]] += 1
                elif w[0] < v[0] and w[1] < v[1] and w[1] < v[0]:
                    votes[turned(reads[i][w[1] - spec.k : v[0] - spec.k])] += 1
            n, patch = max(((c, s) for s, c in votes.items()), default=(0, ""))
            if n < min_cov:
                out.append((seq, cov))
                seq, cov, patch = "", [], ""
        seq += patch + seq0[r[0] : r[1]]
        cov = [*cov, *[n] * len(patch), *[total[r]] * (r[1] - r[0])]
        last = r
    return [*out, (seq, cov)]


def consensus(reads: DataFrame, by: str, method: str = "sparse", min_cov: int = 2, k: int = 33, order: str = "sid") -> DataFrame:
    """(by, part, seq, coverage, reason): consensus of each group of reads (by, order, seq); the first read in order is the guide.

    ``method`` is 'kmer', 'branches', 'guided' or 'sparse'. A group that a method can't solve (a cycle, a read that is too short, no
    reads) has one row with a null sequence and the reason. A group is one locus; its reads are held in memory together.
    """
    ways: dict[str, Callable[[list[str]], list[tuple[str, list[int]]]]] = {
        "kmer": lambda r: [(kmer_consensus(r, k, min_cov), [])],
        "branches": lambda r: branch_consensus(r),
        "guided": lambda r: [guided_consensus(r, min_cov)],
        "sparse": lambda r: sparse_consensus(r, min_cov),
    }
    way = ways[method]

    def work(key: tuple, rows: list[dict]):
        own = [r["seq"] for r in rows if r["seq"]]
        try:
            if not own:
                raise ValueError("no reads")
            found = way(own)
        except ValueError as e:
            yield (*key, 0, None, None, str(e))
            return
        for part, (seq, cov) in enumerate(found):
            yield (*key, part, seq, cov, None)

    kind = reads.schema[by].dataType.simpleString()
    return grouped_scan(reads.select(by, order, "seq"), [by], [order], work, f"{by} {kind}, part int, seq string, coverage array<int>, reason string")
