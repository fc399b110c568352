"""Problem 3: oversized sequences cut into overlapping pieces at natural boundaries.

Balanced targets.  From the size limit and the overlap follows the least number of pieces; cut targets of equal piece length are
placed; each is snapped to the strongest boundary nearby, the longest gap within half a piece, and within that gap to the position
closest to the target.  If a piece then breaks the limit, or a target has no gap nearby, one more piece is planned, and so on up to twice
the least number.

A record of more than twice ``STRETCH`` pieces is planned in stretches that end in snapped cuts, so that a piece that breaks the limit costs
one more piece in its own stretch only.  Where no number of pieces gives a gap at every target, the plan is the cheapest path over the
gaps: with the fewest cuts outside of gaps, then the fewest pieces, then the most even ones; cuts outside of gaps are spaced evenly.

Boundaries are gaps: maximal runs of at least ``MIN_GAP`` unknown residues (N, in proteins X, in either case) that reach neither end.
Only the letters A to Z of ``sequence`` are residues.  A null sequence is empty, a null ``mol_type`` counts as dna.  Sequences within
the limit give no rows.  The work is per record and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, MIN_GAP = 6000, 200, 10
#: Least number of pieces of a stretch that is planned as a whole.
STRETCH = 8
_OTHER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def residues(sequence: str | None) -> bytes:
    return (sequence or "").encode("utf-8", "surrogatepass").translate(None, _OTHER)


def gaps_of(seq: bytes, protein: bool, least: int = MIN_GAP) -> list[tuple[int, int]]:
    """Inner gaps as half-open ranges."""
    run = re.compile((b"[Xx]" if protein else b"[Nn]") + b"{%d,}" % least)
    return [m.span() for m in run.finditer(seq) if m.start() > 0 and m.end() < len(seq)]


def _snapped(target: int, gaps: list[tuple[int, int]], low: float, high: float) -> tuple[int, int]:
    """The position closest to ``target`` in the longest gap between ``low`` and ``high`` with its length; the target itself and 0 if there is none."""
    best = (0, 0, target)
    for i in range(bisect_left(gaps, low, key=lambda g: g[1]), len(gaps)):
        a, b = gaps[i]
        if a > high:
            break
        at = min(max(target, a), b)
        best = max(best, (b - a, -abs(at - target), at))
    return best[2], best[0]


def _stretch(start: int, n: int, gaps: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cuts between ``start`` and ``n``, the first piece beginning at ``start``."""
    step = limit - overlap
    least = 1 + -(-(n - start - limit) // step)

    def plan(pieces: int) -> list[tuple[int, int]]:
        length = (n - start + overlap * (pieces - 1)) / pieces  # every gap is near the target next to it
        targets = [start + round(length + (k - 1) * (length - overlap)) for k in range(1, pieces)]
        return [_snapped(t, gaps, t - length / 2, t + length / 2) for t in targets]

    def fits(c: list[tuple[int, int]]) -> bool:
        at = [start, *(x for x, _ in c), n]
        return all(overlap < y - x + (overlap if i else 0) <= limit and (i == 0 or y > x) for i, (x, y) in enumerate(zip(at, at[1:], strict=False)))

    for pieces in range(least, 2 * least + 1):
        if fits(c := plan(pieces)) and all(gap for _, gap in c):
            return c
    return _cheapest(start, n, gaps, overlap, step, (n - start - overlap) / least)


def _cheapest(start: int, n: int, gaps: list[tuple[int, int]], overlap: int, step: int, length: float) -> list[tuple[int, int]]:
    """Cuts on the cheapest path from ``start`` to ``n`` over the gaps; a piece gives at most ``step`` residues beside its overlap."""
    begin = start + overlap
    low, high = bisect_left(gaps, begin + 1, key=lambda g: g[1]), bisect_left(gaps, n, key=lambda g: g[0])
    # Both ends of a gap are boundaries: the far one reaches further, the near one may just be within the limit.
    nodes = [(begin, 0)]
    for a, b in gaps[low:high]:
        nodes += [(x, b - a) for x in sorted({max(a, begin + 1), min(b, n - 1)}) if nodes[-1][0] < x < n]
    nodes.append((n, 0))
    best: list[tuple[tuple[int, int, float], int]] = [((0, 0, 0.0), -1)]
    for j in range(1, len(nodes)):
        options = []
        for i in range(j - 1, -1, -1):
            between = nodes[j][0] - nodes[i][0]
            bare = -(-between // step) - 1  # cuts outside of gaps on the way
            (u, p, d), _ = best[i]
            options.append(((u + bare, p + bare + 1, d + (bare + 1) * (between / (bare + 1) - length) ** 2), i))
            if bare and i < j - 1 and nodes[i + 1][0] - nodes[i][0] <= step:
                break  # from further back the way leads over the node after
        best.append(min(options))
    path, j = [], len(nodes) - 1
    while j > 0:
        i = best[j][1]
        between = nodes[j][0] - nodes[i][0]
        bare = -(-between // step) - 1
        path += [nodes[j], *((nodes[i][0] + round(k * between / (bare + 1)), 0) for k in range(bare, 0, -1))]
        j = i
    return path[:0:-1]


def cuts(n: int, gaps: list[tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Cut positions between 0 and ``n`` with the strength of the boundary at each (0: none)."""
    step = limit - overlap
    out: list[tuple[int, int]] = []
    start = 0
    while (least := 1 + -(-(n - start - limit) // step)) > 2 * STRETCH:
        length = (n - start + overlap * (least - 1)) / least
        target = start + round(length + (STRETCH - 1) * (length - overlap))
        end = _snapped(target, gaps, target - length / 2, target + length / 2)
        out += [*_stretch(start, end[0], gaps, limit, overlap), end]
        start = end[0] - overlap
    return out + _stretch(start, n, gaps, limit, overlap)


_PIECE = pa.struct([("piece_no", pa.int32()), ("name", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("cut_gap", pa.int32()), ("sequence", pa.string())])
_BOUNDARY = pa.struct([("gap_start", pa.int64()), ("size", pa.int32()), ("cut_after", pa.int32())])
_ROW = "contig_id long, n_residues long, boundaries array<struct<gap_start long, size int, cut_after int>>, pieces array<struct<piece_no int, name string, start_pos long, end_pos long, cut_gap int, sequence string>>"


def split(contigs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, min_gap: int = MIN_GAP, text: bool = True) -> DataFrame:
    """One row per oversized record: its boundaries and its pieces.

    A boundary is a gap: its first position, from 1, its size, and the last piece that is cut in it (null: none).  A piece is named ``<id>_<piece_no>``, covers ``start_pos`` to ``end_pos`` (from 1, both included), begins with the last
    ``overlap`` residues of the one before, and ends in a gap of ``cut_gap`` residues (0: no boundary was near, or the record's end).
    ``text=False`` leaves the pieces' sequences null.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for contig, name, sequence, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seq = residues(sequence)
                if len(seq) <= limit:
                    continue
                gaps = gaps_of(seq, (kind or "").lower() == "protein", min_gap)
                letters, at, pieces = seq.decode("ascii") if text else None, 0, []
                cut_in: dict[int, int] = {}
                for k, (end, gap) in enumerate([*cuts(len(seq), gaps, limit, overlap), (len(seq), 0)], 1):
                    begin = at - overlap if k > 1 else 0
                    pieces.append({"piece_no": k, "name": f"{contig if name is None else name}_{k}", "start_pos": begin + 1, "end_pos": end, "cut_gap": gap, "sequence": letters[begin:end] if text else None})
                    if gap:
                        cut_in[bisect_left(gaps, end, key=lambda g: g[1])] = k
                    at = end
                rows.append((contig, len(seq), [{"gap_start": a + 1, "size": b - a, "cut_after": cut_in.get(i)} for i, (a, b) in enumerate(gaps)], pieces))
            types = [pa.int64(), pa.int64(), pa.list_(_BOUNDARY), pa.list_(_PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["contig_id", "n_residues", "boundaries", "pieces"])

    return contigs.select(F.col("contig_id").cast("long"), "id", "sequence", "mol_type").mapInArrow(run, _ROW)


def pieces(contigs: DataFrame, **options: int) -> DataFrame:
    """``(contig_id, piece_no, name, start_pos, end_pos, cut_gap, sequence)``."""
    return split(contigs, **options).select("contig_id", F.explode("pieces").alias("p")).select("contig_id", "p.*")


def boundaries(contigs: DataFrame, **options: int) -> DataFrame:
    """``(contig_id, gap_start, size, cut_after)``: the boundaries that the cuts of each oversized record were chosen from."""
    return split(contigs, text=False, **options).select("contig_id", F.explode("boundaries").alias("b")).select("contig_id", "b.*")


def found_gaps(contigs: DataFrame, **options: int) -> DataFrame:
    """``(contig_id, gap_start)``: the boundaries of every oversized record; 0 for one without."""
    found = split(contigs, text=False, **options).select("contig_id", F.explode_outer("boundaries").alias("b"))
    return found.select("contig_id", F.coalesce("b.gap_start", F.lit(0).cast("long")).alias("gap_start"))
