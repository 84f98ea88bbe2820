"""SentencePiece encoding with N best segmentations, and exact decoding.

The vocabulary of a public ``.model`` file gives the piece lattice of a text and
its scores.  A forward Viterbi pass over the lattice gives the best score up to
every position; the backward search from the end is A-star with those scores as
its exact heuristic, so it pops complete segmentations in order of score.

No piece of a usable vocabulary crosses from a non-space into a space or into a
line break (checked when it is loaded), so a text's lattice falls apart there
into chunks whose segmentations are independent.  A chunk is solved once per
worker and kept; a text's N best are the N smallest sums of its chunks' losses.

Scores are multiples of ``UNIT``, so that sums are exact in any order.  A partial
segmentation's estimate then equals that of the best way to go on with it, and
as the search prefers the longer one of equal estimates, it walks straight to an
end: N best take N walks, also where very many segmentations tie.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, freed, fresh, schema_with, table, text_slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Bytes of solved chunks, about, that one worker keeps in each of two generations; has no influence on results.
KEPT_BYTES = 24 << 20
UNIT = 2.0**-20
LONG_CHUNK = 64  # characters; longer chunks are solved one at a time
SWITCHED_OFF = -1e8  # scores below this mark pieces that a model never uses on a best path
EDITS = "array<struct<score: double, edits: array<struct<at: int, n_old: int, ids: array<int>>>>>"
EDITS_ARROW = pa.list_(
    pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("n_old", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
)


class Pieces:
    """A vocabulary: what the driver reads from a model file and sends to the workers (some 32,000 strings)."""

    def __init__(self, strings: list[str], scores: list[float], byte_ids: list[int]):
        scores = [round(s / UNIT) * UNIT for s in scores]
        self.strings, self.scores, self.byte_ids = strings, scores, byte_ids
        self.lookup: dict[str, tuple[int, float] | None] = {}
        special = set(byte_ids) | {0, 1, 2}
        for i, (p, s) in enumerate(zip(strings, scores, strict=True)):
            if i in special or not p:
                continue
            if re.search("[^ ] |.\n|\n.", p):
                raise ValueError(f"piece {i} crosses a chunk border")
            for j in range(1, len(p)):
                self.lookup.setdefault(p[:j], None)
            self.lookup[p] = (i, s)
        self.unknown = min(s for s in scores if s > SWITCHED_OFF) - 10.0
        raw = [b"" if i in (0, 1, 2) else p.encode() for i, p in enumerate(strings)]
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw])
        self.place = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self._automaton()
        self.solved: dict[str, tuple[bytes, float, float]] = {}
        self.before = self.solved
        self.ranked: dict[str, list] = {}
        self.last: tuple[str, array] = "", array("d", [0.0])  # the chunk solved last, and the best score up to each place
        self.kept = 0

    def __reduce__(self):
        return Pieces, (self.strings, self.scores, self.byte_ids)

    def _automaton(self) -> None:
        """The prefixes of all pieces as states: sorted (state, character) keys, the next state, and the piece that ends there."""
        number = {"": 0} | {p: i for i, p in enumerate(sorted(self.lookup), 1)}
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in number if p], np.int64)
        order = np.argsort(keys)
        self.step, self.next = keys[order], np.array([number[p] for p in number if p])[order]
        self.ends = np.full(len(number), -1)
        for p, found in self.lookup.items():
            if found:
                self.ends[number[p]] = found[0]
        self.longest = max(map(len, self.lookup), default=1)
        self.score_of = np.append(np.array(self.scores), self.unknown)  # the last for unknown characters, id -1

    def _edges(self, chunk: str, i: int) -> list[tuple[int, int, float]]:
        """Pieces that start at ``i``: (end, id, score); an unknown character has id -1."""
        out, lookup = [], self.lookup
        for j in range(i + 1, len(chunk) + 1):
            found = lookup.get(chunk[i:j], 0)
            if found:
                out.append((j, *found))
            elif found == 0:
                break
        return out if out and out[0][0] == i + 1 else [*out, (i + 1, -1, self.unknown)]

    def _into(self, chunk: str, j: int):
        """Pieces that end at ``j``: (start, id, score)."""
        lookup, single = self.lookup, False
        for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
            found = lookup.get(chunk[i:j])
            if found:
                single = single or i == j - 1
                yield (i, *found)
        if not single:
            yield j - 1, -1, self.unknown

    def _ids(self, chunk: str, path) -> bytes:
        out = array("i")
        for i, j, k in path:
            if k >= 0:
                out.append(k)
            else:
                out.extend([self.byte_ids[b] for b in chunk[i:j].encode()])
        return out.tobytes()

    def _edge_blocks(self, chunk: str, size: int = 1 << 14):
        """The edges of a long chunk, ``size`` starts at a time: (first start, bounds of each start's edges, ends, ids, scores)."""
        code = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        for lo in range(0, len(code), size):
            start = np.arange(lo, min(len(code), lo + size))
            state, found, alone = np.zeros(len(start), np.int64), [], np.ones(len(start), bool)
            at = start
            for reach in range(self.longest):
                inside = at + reach < len(code)
                at, state = at[inside], state[inside]
                key = state << 21 | code[at + reach]
                slot = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
                hit = self.step[slot] == key
                at, state = at[hit], self.next[slot[hit]]
                if not len(at):
                    break
                full = self.ends[state] >= 0
                if reach == 0:
                    alone[at[full] - lo] = False
                found.append((at[full], at[full] + reach + 1, self.ends[state[full]]))
            odd = start[alone]
            begin, end, ids = (np.concatenate(x) for x in zip(*found, (odd, odd + 1, np.full(len(odd), -1)), strict=True))
            order = np.lexsort((end, begin))
            yield lo, np.searchsorted(begin[order], np.arange(lo, lo + len(start) + 1)).tolist(), end[order].tolist(), ids[order].tolist(), self.score_of[ids[order]].tolist()

    def solve(self, chunk: str) -> tuple[bytes, float, float]:
        """(ids of the best segmentation, its score, by how much the second best is worse)."""
        n = len(chunk)
        best, second, back, piece = array("d", [float("-inf")]) * (n + 1), array("d", [float("-inf")]) * (n + 1), array("q", [0]) * (n + 1), array("q", [0]) * (n + 1)
        best[0] = 0.0
        for lo, bounds, ends, ids, scores in self._edge_blocks(chunk):
            for i in range(len(bounds) - 1):
                a, b = best[lo + i], second[lo + i]
                for e in range(bounds[i], bounds[i + 1]):
                    j, s = ends[e], scores[e]
                    x, y = a + s, best[j]
                    if x > y:
                        best[j], back[j], piece[j] = x, lo + i, ids[e]
                        x = y if y > b + s else b + s
                    if x > second[j]:
                        second[j] = x
        self.last = chunk, best
        path, j = [], n
        while j:
            path.append((back[j], j, piece[j]))
            j = back[j]
        return self._ids(chunk, reversed(path)), best[n], best[n] - second[n]

    def solve_many(self, chunks: list[str]) -> None:
        """``solve`` for many new chunks: one numpy step for each (start, length), over all chunks of a block."""
        short = sorted((c for c in chunks if len(c) <= LONG_CHUNK), key=len, reverse=True)
        for c in chunks:
            if len(c) > LONG_CHUNK:
                self.solved[c] = self.solve(c)
        for lo in range(0, len(short), 4096):
            self._solve_block(short[lo : lo + 4096])

    def _solve_block(self, chunks: list[str]) -> None:
        size = np.array([len(c) for c in chunks])
        n, most = len(chunks), int(size[0])
        text = np.zeros((n, most), np.int64)
        text[np.arange(most) < size[:, None]] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        best, second = np.full((most + 1, n), -np.inf), np.full((most + 1, n), -np.inf)
        back, piece = np.zeros((most + 1, n), np.int64), np.zeros((most + 1, n), np.int64)
        best[0] = 0.0

        def relax(rows, i, j, ids):
            s = self.score_of[ids]
            x, y = best[i, rows] + s, best[j, rows]
            better = x > y
            new = np.where(better, np.maximum(y, second[i, rows] + s), x)
            second[j, rows] = np.maximum(second[j, rows], new)
            rows = rows[better]
            best[j, rows], back[j, rows], piece[j, rows] = x[better], i, ids[better]

        for i in range(most):
            rows = np.arange(np.searchsorted(-size, -i, side="left"))
            alone, state = np.ones(len(rows), bool), np.zeros(len(rows), np.int64)
            for j in range(i + 1, min(most, i + self.longest) + 1):
                live = size[rows] >= j
                rows, state = rows[live], state[live]
                key = state << 21 | text[rows, j - 1]
                slot = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
                hit = self.step[slot] == key
                rows, state = rows[hit], self.next[slot[hit]]
                if not len(rows):
                    break
                ids = self.ends[state]
                full = ids >= 0
                if full.any():
                    if j == i + 1:
                        alone[rows[full]] = False
                    relax(rows[full], i, j, ids[full])
            rest = np.flatnonzero(alone)
            if len(rest):
                relax(rest, i, i + 1, np.full(len(rest), -1))
        # walk back from the ends, then turn the pieces around
        at, used, steps, spans = size.copy(), np.zeros(n, np.int64), [], []
        live = np.arange(n)
        while len(live):
            steps.append((live, piece[at[live], live]))
            spans.append((back[at[live], live], at[live]))
            used[live] += 1
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
        start = np.concatenate(([0], np.cumsum(used)))
        flat = np.zeros(start[-1], np.int32)
        for k, (rows, ids) in enumerate(steps):
            flat[start[rows] + used[rows] - 1 - k] = ids
        odd = set()
        for rows, ids in steps:
            odd.update(rows[ids < 0].tolist())
        raw = flat.tobytes()
        tops, gaps, cut = best[size, np.arange(n)].tolist(), (best[size, np.arange(n)] - second[size, np.arange(n)]).tolist(), (4 * start).tolist()
        for r, c in enumerate(chunks):
            ids = raw[cut[r] : cut[r + 1]]
            if r in odd:
                path = [(int(a[np.searchsorted(rows, r)]), int(z[np.searchsorted(rows, r)]), int(k[np.searchsorted(rows, r)])) for (rows, k), (a, z) in zip(steps, spans, strict=True) if r < n and _has(rows, r)]
                ids = self._ids(c, path[::-1])
            self.solved[c] = (ids, tops[r], gaps[r])

    def n_best(self, chunk: str, n_best: int) -> list[tuple[float, bytes]]:
        """The ``n_best`` segmentations of a chunk, best first: Viterbi forward, A-star backward."""
        n = len(chunk)
        if self.last[0] != chunk:
            self.solve(chunk)
        ahead = self.last[1]
        agenda, made, found = [(-ahead[n], n, 0, 0.0, None)], 1, []
        while agenda and len(found) < n_best:
            f, at, _, behind, path = heapq.heappop(agenda)
            if not at:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                found.append((-f, self._ids(chunk, steps)))
                continue
            for i, k, s in self._into(chunk, at):
                heapq.heappush(agenda, (-(ahead[i] + s + behind), i, made, behind + s, ((i, at, k), path)))
                made += 1
        return found

    def encode_many(self, texts: list[str], n_best: int) -> list[tuple[bytes, list[tuple[float, list]]]]:
        """For each text (ids of the best segmentation, the ``n_best`` as (score, edits of the best))."""
        if self.kept > KEPT_BYTES:
            self.before, self.solved, self.ranked, self.kept = self.solved, {}, {}, 0
        chunks = [CHUNK.findall(" " + t) if t else [] for t in texts]
        new = set().union(*chunks) - self.solved.keys()
        known = new & self.before.keys()
        for c in known:
            self.solved[c] = self.before[c]
        if len(new) > len(known):
            self.solve_many(list(new - known))
        self.kept += sum(map(len, new)) * 6 + 300 * len(new)
        return [self._combine(c, n_best) for c in chunks]

    def encode(self, text: str, n_best: int) -> tuple[bytes, list[tuple[float, list]]]:
        return self.encode_many([text], n_best)[0]

    def _combine(self, chunks: list[str], n_best: int) -> tuple[bytes, list[tuple[float, list]]]:
        if not chunks:
            return b"", [(0.0, [])]
        parts = [self.solved[c] for c in chunks]
        ids, scores, gaps = map(list, zip(*parts, strict=True))
        total, ways = sum(scores), [(0.0, ())]
        for _ in range(n_best - 1):  # the chunks with the smallest losses, first ones first
            loss = min(gaps)
            if loss == float("inf"):
                break
            i = gaps.index(loss)
            gaps[i] = float("inf")
            ranked = self.ranked.get(chunks[i])
            if ranked is None or len(ranked) < n_best:
                ranked = self.ranked[chunks[i]] = self.n_best(chunks[i], n_best)
                self.kept += 300 + sum(200 + len(ids) for _, ids in ranked)
            more = [(done + ranked[0][0] - s, (*chosen, (i, r))) for done, chosen in ways for r, (s, _) in enumerate(ranked) if r]
            ways = heapq.nsmallest(n_best, ways + more)
        begin = list(accumulate(map(len, ids), initial=0)) if len(ways) > 1 else []
        out = []
        for done, chosen in ways:
            edits = [(begin[i] // 4, len(ids[i]) // 4, np.frombuffer(self.ranked[chunks[i]][r][1], np.int32).tolist()) for i, r in sorted(chosen)]
            out.append((total - done, edits))
        return b"".join(ids), out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of many id lists, without the space that encoding puts before each."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = self.pool[np.repeat(self.place[ids] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[offsets]
        full = np.diff(bounds) > 0
        keep = np.ones(len(raw), bool)
        keep[bounds[:-1][full]] = False
        return raw[keep], bounds - np.concatenate(([0], np.cumsum(full)))


def _has(rows: np.ndarray, r: int) -> bool:
    at = np.searchsorted(rows, r)
    return at < len(rows) and rows[at] == r


CHUNK = re.compile("\n| +[^ \n]*|[^ \n]+")


def load_pieces(model: str = MODEL) -> Pieces:
    """Read a ``.model`` file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if len(set(byte_ids)) < 256:
        raise ValueError("the vocabulary needs byte fallback")
    return Pieces([sp.id_to_piece(i).replace("▁", " ") for i in range(n)], [sp.get_score(i) for i in range(n)], byte_ids)


def encode(docs: DataFrame, *, text: str = "text", model: str = MODEL, n_best: int = N_BEST, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``nbest`` and ``round_trip``.

    ``nbest`` lists up to ``n_best`` segmentations, best first: a score (the sum
    of piece scores) and its edits of ``ids``, each replacing ``n_old`` ids from
    index ``at`` on.  ``round_trip`` says whether decoding ``ids`` gives back the
    very text.  Null and empty texts give no ids and one empty segmentation.
    Ties between segmentations go to the one found first, the same in every run.
    A literal U+2581 is spelled in bytes, so it survives.  Other columns pass
    through, or those named in ``keep``; one named like a new one is replaced.
    """
    spark = docs.sparkSession
    given, place, source = beside(docs, text, ["ids", "n_tokens", "nbest", "round_trip"], keep)
    shared = spark.sparkContext.broadcast(load_pieces(model))

    @freed
    def run(batches):
        pieces = shared.value
        for part in text_slices(batches, place):
            col = part.column(place)
            found = pieces.encode_many([t or "" for t in col.to_pylist()], n_best)
            ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
            off = np.concatenate(([0], np.cumsum([len(f[0]) // 4 for f in found])))
            raw, bounds = pieces.decode(ids, off)
            text_raw, text_off = utf8(col)
            same = np.diff(bounds) == np.diff(text_off)
            if same.all():
                bad = np.concatenate(([0], np.cumsum(raw != text_raw)))
                same = bad[bounds[1:]] == bad[bounds[:-1]]
            else:
                same = np.array([bytes(raw[bounds[i] : bounds[i + 1]]) == bytes(text_raw[text_off[i] : text_off[i + 1]]) for i in range(len(found))])
            nbest = pa.array([[{"score": s, "edits": [{"at": a, "n_old": n, "ids": x} for a, n, x in e]} for s, e in f[1]] for f in found], EDITS_ARROW)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(given)], pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), pa.array(np.diff(off)), nbest, pa.array(same)],
                [*(f.name for f in given), "ids", "n_tokens", "nbest", "round_trip"],
            )

    return source.mapInArrow(run, schema_with(given, f"ids array<int>, n_tokens long, nbest {EDITS}, round_trip boolean"))


def decode(rows: DataFrame, *, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of an id list in a new column; a null list counts as empty."""
    given = [f for f in rows.schema.fields if f.name != text]
    source = rows.select(*[F.col(f"`{f.name}`") for f in given], F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(fresh(rows.columns, "ids")[0]))
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(model))

    @freed
    def run(batches):
        for part in batches:
            lists = part.column(len(given))
            off = np.asarray(lists.offsets)
            raw, bounds = shared.value.decode(np.asarray(lists.values)[off[0] : off[-1]], off - off[0])
            texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(given)], texts], [*(f.name for f in given), text])

    return source.mapInArrow(run, schema_with(given, f"`{text}` string"))


def op1_sentencepiece(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, keep=["doc_id"]).select("doc_id", "n_tokens", "ids", "nbest", "round_trip")
