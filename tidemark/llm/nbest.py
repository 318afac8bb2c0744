"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text has an edge for every vocabulary piece that stands at a place, scored as in the
model file, and an edge of byte pieces for a character that is no piece. Forward Viterbi scores give the
best way to every place; going backward from the end, A* takes them as its heuristic, which is exact,
so ways come off the queue in the order of their whole scores.

No piece runs over a word's start, a line break and most punctuation (looked up in the vocabulary), so
the lattice is a chain of smaller ones, a chunk each. A chunk's best and second-best scores are found
once in a worker; among a text's N best only the N - 1 chunks whose second-best is nearest can differ
from their best, so A* runs over those, and their choices are joined in the order of their sums.

Defined cases: null and empty texts have no pieces, score 0 and decode to the empty text; repeated
rows are encoded each; the mark U+2581 in a text is written as bytes, so decoding is always exact;
a text with fewer than N ways lists them all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.common import bound_batches, in_slices, table

MODEL, N, MARK = "piece_bpe_32k.model", 4, "▁"
#: Chunks that a worker remembers before it forgets the rarer ones, and characters of texts segmented together.
REMEMBER, SLICE = 250_000, 4 << 20
NEVER = float("-inf")
#: Longer chunks are taken one by one. Bits of the table over hashes, and the hash's factors.
LONG, TOP, MUL, MIX = 40, 20, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary, and what is derived from it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        odd = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.of = {self.text[i]: (i, sp.get_score(i)) for i in range(n) if not odd[i]}
        #: A character without a piece: worse than any real piece.
        self.unknown = min((s for _, s in self.of.values() if s > -1e8), default=0.0) - 10
        self.plain = [None if i in self.byte_of else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        #: Every start of a piece, with the piece's id and score if it is one itself.
        self.starts = {p[:k]: None for p in self.of for k in range(1, len(p) + 1)} | self.of
        self.chunk = re.compile(self.cuts())
        self.index_prefixes()
        self.forget()

    def index_prefixes(self) -> None:
        """Starts of pieces by a 64-bit hash of their code points, sorted, with a table over its top bits."""
        names = list(self.starts)
        h = np.array([self.hash_of(x) for x in names], np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two starts of pieces have one hash")
        hits = [self.starts[names[k]] or (-1, 0.0) for k in order]
        self.hash_piece, self.hash_score = np.array([i for i, _ in hits], np.int32), np.array([x for _, x in hits], np.float64)
        self.buckets = np.searchsorted(self.hashes, np.arange(1 << TOP, dtype=np.uint64) << np.uint64(64 - TOP)).astype(np.int64)
        self.buckets = np.append(self.buckets, len(h))
        self.crowd = int(np.diff(self.buckets).max())
        self.longest = max(map(len, names))

    @staticmethod
    def hash_of(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(MUL) + ord(c) + 1) % 2**64
        return h * int(MIX) % 2**64

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the starts of pieces, -1 if it is none."""
        top = (h >> np.uint64(64 - TOP)).astype(np.int64)
        at, stop = self.buckets[top], self.buckets[top + 1]
        out = np.full(len(h), -1, np.int64)
        rest = np.flatnonzero(at < stop)
        for _ in range(self.crowd):
            if not len(rest):
                break
            same = self.hashes[at[rest]] == h[rest]
            out[rest[same]] = at[rest[same]]
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < stop[rest]]
        return out

    def forget(self) -> None:
        """Known chunks by number; of number k: score, gap to the second best, and ids bank[first[k] : first[k + 1]]."""
        self.known: dict[str, int] = {}
        self.score, self.gap, self.bank, self.first, self.met = np.zeros(0), np.zeros(0), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def sweep(self) -> None:
        """Forget the chunks that were not met since the last time; what is common stays, however many there are."""
        if len(self.known) <= REMEMBER:
            return
        keep = np.flatnonzero(self.met) if 2 * self.met.sum() <= REMEMBER else np.zeros(0, np.int64)
        names, size = list(self.known), np.diff(self.first)[keep]
        score, gap = self.score[keep], self.gap[keep]
        ids = self.bank[np.repeat(self.first[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.forget()
        self.keep([names[k] for k in keep], score, gap, ids, size)

    def keep(self, chunks: list[str], score: np.ndarray, gap: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.score)
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.score, self.gap, self.bank = np.append(self.score, score), np.append(self.gap, gap), np.append(self.bank, ids.astype(np.uint32))
        self.first, self.met = np.append(self.first, np.cumsum(size) + self.first[-1]), np.append(self.met, np.zeros(len(chunks), bool))

    def learn(self, chunks: list[str]) -> None:
        """Forward Viterbi over all these chunks at once, place by place; odd and long ones one by one."""
        plain = [c for c in chunks if len(c) <= LONG]
        odd = [c for c in chunks if len(c) > LONG]
        for i in range(0, len(plain), 50_000):
            odd += self.learn_together(plain[i : i + 50_000])
        found = [self.best(c) for c in odd]
        ids = np.frombuffer(b"".join(x for _, _, x in found), np.uint32)
        self.keep(odd, np.array([x for x, _, _ in found]), np.array([x for _, x, _ in found]), ids, np.array([len(x) // 4 for _, _, x in found], np.int64))

    def edges(self, points: np.ndarray, stop: np.ndarray):
        """All lattice edges (start, length, piece, score) of concatenated chunks; stop is each place's chunk end."""
        found, at = [], np.arange(len(points))
        h = points + np.uint64(1)
        for length in range(1, self.longest + 1):
            hit = self.find(h * MIX)
            piece = np.where(hit >= 0, self.hash_piece[hit], -1)
            real = piece >= 0
            found.append((at[real], np.full(real.sum(), length), piece[real], self.hash_score[hit[real]]))
            if length == 1:
                none = at[~real]
                found.append((none, np.ones(len(none), np.int64), np.full(len(none), -1), np.full(len(none), self.unknown)))
            go = (hit >= 0) & (at + length < stop[at])
            at, h = at[go], h[go]
            if not len(at):
                break
            h = h * MUL + points[at + length] + np.uint64(1)
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def learn_together(self, chunks: list[str]) -> list[str]:
        """Learns the chunks whose best way has no unknown character, and returns the others."""
        marked = [self.marked(c) for c in chunks]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        offset, number = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        at, length, piece, score = self.edges(points, (offset + size)[number])
        node = at + number[at]  # every chunk has one place more than characters
        key = (at - offset[number[at]]) * (self.longest + 1) + length
        order = np.argsort(key, kind="stable")
        node, length, piece, score, key = node[order], length[order], piece[order], score[order], key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        n = len(points) + len(size)
        best, second, last, back = np.full(n, NEVER), np.full(n, NEVER), np.full(n, -1), np.zeros(n, np.int64)
        begin = offset + np.arange(len(size))
        best[begin] = 0.0
        for a, b in itertools.pairwise(cuts):  # one place and length: no two of these edges end alike
            src, d, sc = node[a:b], length[a], score[a:b]
            to = src + d
            v, v2, old, old2 = best[src] + sc, second[src] + sc, best[to], second[to]
            up = v > old
            second[to] = np.maximum(np.where(up, old, np.maximum(old2, v)), v2)
            best[to] = np.where(up, v, old)
            last[to[up]], back[to[up]] = piece[a:b][up], d
        place, live, steps = begin + size, np.arange(len(size)), []
        count, bad = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
        while len(live):
            steps.append((live, last[place[live]], count[live].copy()))
            bad[live] |= steps[-1][1] < 0
            count[live] += 1
            place[live] -= back[place[live]]
            live = live[place[live] > begin[live]]
        first = np.cumsum(np.where(bad, 0, count)) - np.where(bad, 0, count)
        ids = np.zeros(int(count[~bad].sum()), np.uint32)
        for of, pieces_, k in steps:
            good = ~bad[of]
            of, pieces_, k = of[good], pieces_[good], k[good]
            ids[first[of] + count[of] - 1 - k] = pieces_
        good, end = np.flatnonzero(~bad), begin + size
        self.keep([chunks[k] for k in good], best[end[good]], best[end[good]] - second[end[good]], ids, count[good])
        return [chunks[k] for k in np.flatnonzero(bad)]

    def cuts(self) -> str:
        """A pattern of chunks that no piece runs over: cut before spaces and around line breaks, and
        before punctuation marks that no piece has after a letter or digit."""
        pairs = {p[k : k + 2] for p in self.of for k in range(len(p) - 1)}
        if any(b == MARK != a or "\n" in (a, b) for a, b in pairs):
            return r"(?s).+"
        tied = {b for a, b in pairs if a.isalnum() and not b.isalnum()}
        free = re.escape("".join(sorted(set(string.punctuation) - tied)))
        return rf" *[^\W_]+(?=[ \n{free}]|\Z)| *[^ \n]+| +|\n"

    def marked(self, chunk: str) -> str:
        """A chunk with the mark for spaces; a mark in the text itself becomes a character without a piece."""
        return chunk.replace(MARK, "\0").replace(" ", MARK)

    def lattice(self, s: str) -> list[list[tuple[int, int, float]]]:
        """By start: edges (end, id, score); id -1 is the character in bytes."""
        edges, starts = [], self.starts
        for i in range(len(s)):
            here, j = [], i + 1
            while j <= len(s) and (hit := starts.get(s[i:j], 0)) != 0:
                if hit:
                    here.append((j, *hit))
                j += 1
            if not here or here[0][0] != i + 1:
                here.append((i + 1, -1, self.unknown))
            edges.append(here)
        return edges

    def forward(self, s: str):
        """Best and second-best scores to every place, and the piece and start of the best way's last edge.

        The lattice is walked as it is found, without being built."""
        n, get, unknown = len(s), self.starts.get, (-1, self.unknown)
        best, second, piece, start = [NEVER] * (n + 1), [NEVER] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            a, b, j = best[i], second[i], i + 1
            hit = get(s[i], 0)
            more, hit = hit != 0, hit or unknown
            while True:
                if hit:
                    v, old = a + hit[1], best[j]
                    if v > old:
                        second[j], best[j], piece[j], start[j] = old, v, hit[0], i
                    elif v > second[j]:
                        second[j] = v
                    if b > NEVER and b + hit[1] > second[j]:
                        second[j] = b + hit[1]
                j += 1
                if j > n or not more:
                    break
                hit = get(s[i:j], 0)
                if hit == 0:
                    break
        return best, second, piece, start

    def ids(self, chunk: str, way: list[tuple[int, int]]) -> bytes:
        """Ids, four bytes each, of a way of (start, id) edges in order."""
        out = array("I")
        for at, piece in way:
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.bytes[b] for b in chunk[at].encode("utf-8", "surrogatepass"))
        return out.tobytes()

    def best(self, chunk: str) -> tuple[float, float, bytes]:
        """Score, distance of the second best, ids of the best."""
        best, second, piece, start = self.forward(self.marked(chunk))
        way, j = [], len(chunk)
        while j:
            way.append((start[j], piece[j]))
            j = start[j]
        return best[-1], best[-1] - second[-1], self.ids(chunk, way[::-1])

    def nbest(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a chunk, best first, by backward A* under the forward scores."""
        s = self.marked(chunk)
        edges, best = self.lattice(s), self.forward(s)[0]
        into = [[] for _ in range(len(edges) + 1)]
        for i, here in enumerate(edges):
            for j, piece, score in here:
                into[j].append((i, piece, score))
        turn, out = itertools.count(), []
        queue = [(-best[-1], next(turn), len(edges), 0.0, None)]  # total, order, place, score behind, way behind
        while queue and len(out) < n:
            total, _, place, behind, way = heapq.heappop(queue)
            if place == 0:
                edges_in_order = []
                while way:
                    edges_in_order.append(way[0])
                    way = way[1]
                out.append((-total, self.ids(chunk, edges_in_order)))
                continue
            for i, piece, score in into[place]:
                heapq.heappush(queue, (-(best[i] + score + behind), next(turn), i, behind + score, ((i, piece), way)))
        return out

    def encode(self, text: str | None, n: int = N) -> list[tuple[float, bytes]]:
        return next(self.encode_batch([text], n))

    def encode_batch(self, texts: list[str | None], n: int = N) -> Iterator[list[tuple[float, bytes]]]:
        """For every text its n best segmentations (score, ids in four bytes each), best first."""
        split = [self.chunk.findall(" " + t) if t else [] for t in texts]
        self.sweep()
        known = self.known
        self.learn([c for c in dict.fromkeys(itertools.chain.from_iterable(split)) if c not in known])
        score, gap, bank, first, met = self.score, self.gap, self.bank, self.first, self.met
        for chunks in split:
            if not chunks:
                yield [(0.0, b"")]
                continue
            code = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
            met[code] = True
            size = first[code + 1] - first[code]
            upto = np.cumsum(size)
            ids = bank[np.arange(upto[-1]) + np.repeat(first[code] - (upto - size), size)].tobytes()
            total, gaps = float(score[code].sum()), gap[code]
            near = np.argpartition(gaps, n - 2)[: n - 1] if 1 < n <= len(gaps) else np.arange(len(gaps) if n > 1 else 0)
            near = sorted(int(k) for k in near if gaps[k] < np.inf)
            options = [self.nbest(chunks[k], n) for k in near]
            out = []
            for drop, choice in cheapest([[o[0][0] - s for s, _ in o] for o in options], n):
                parts, at = [], 0
                for k, o, c in zip(near, options, choice, strict=True):
                    if c:
                        parts += [ids[at : 4 * int(upto[k] - size[k])], o[c][1]]
                        at = 4 * int(upto[k])
                out.append((total - drop, b"".join([*parts, ids[at:]]) if parts else ids))
            yield out

    def decode(self, data: bytes) -> str:
        """The text of ids in four bytes each."""
        ids = array("I", data)
        parts = [self.plain[i] for i in ids]
        for at, part in enumerate(parts) if None in parts else ():
            if part is None:  # a run of bytes is a run of characters
                stop = next((k for k in range(at, len(parts)) if parts[k] is not None), len(parts))
                parts[at:stop] = [bytes(self.byte_of[i] for i in ids[at:stop]).decode("utf-8", "surrogatepass"), *[""] * (stop - at - 1)]
        return "".join(parts)[1:]


def cheapest(costs: list[list[float]], n: int):
    """The n choices, one from each list of rising costs, with the smallest sums, in order."""
    first = (0,) * len(costs)
    queue, seen = [(0.0, first)], {first}
    while queue and n:
        total, choice = heapq.heappop(queue)
        yield total, choice
        n -= 1
        for k, c in enumerate(choice):
            if c + 1 < len(costs[k]):
                nxt = (*choice[:k], c + 1, *choice[k + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(queue, (sum(x[i] for x, i in zip(costs, nxt, strict=True)), nxt))


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary a worker, so that what it remembers outlives a task."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def segment(docs: DataFrame, *, n: int = N, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_pieces, score, ids_crc32, round_trip, nbest (score, n_pieces,
    ids_crc32 of each of the n best), and with_ids the ids of the best."""
    import public_tokenizers

    path = model or public_tokenizers.path(MODEL)
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        p = pieces(path)
        for batch in in_slices(batches, most=SLICE):
            rows = []
            texts = batch["text"].tolist()
            for doc, text, ways in zip(batch["doc_id"], texts, p.encode_batch(texts, n), strict=True):
                each = [{"score": s, "n_pieces": len(ids) // 4, "ids_crc32": zlib.crc32(ids)} for s, ids in ways]
                ids = ways[0][1]
                rows.append((doc, len(ids) // 4, ways[0][0], each[0]["ids_crc32"], p.decode(ids) == (text or ""), each, *([np.frombuffer(ids, "<i4")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "score", "ids_crc32", "round_trip", "nbest", *(["ids"] if with_ids else [])]).astype({"doc_id": object})

    schema = f"doc_id {kind}, n_pieces long, score double, ids_crc32 long, round_trip boolean, nbest array<struct<score:double,n_pieces:long,ids_crc32:long>>" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def query(spark, sf_dir):
    """op9: every document's N best segmentations, as scores, lengths and checksums, and whether decoding gives the text back."""
    return segment(table(spark, sf_dir, "documents"), with_ids=False)
