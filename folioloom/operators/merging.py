"""Order-dependent merging of chunks inside one filing.

Short answers join the chunk before them, contained chunks go, strongly overlapping chunks merge,
then the most similar neighbours merge until a budget is used up.  Every step depends on the one
before, so a filing of any size is worked through whole, in one task.  Candidates are found through
shared or close sentences and pages and wait in heaps, so work follows the pairs that stand close
and not the square of the chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.providers import Embedder, HashedWords

#: Texts that go to the embedder at once.
BATCH = 1024


@dataclass(frozen=True)
class Settings:
    """Limits of the merge steps, checked when made.

    ``most_words`` is the limit of a merged chunk: the embedding limit of the configuration, else
    its token limit.
    """

    small_sentences: int = 1
    small_words: int = 20
    most_words: int = 512
    overlap: float = 0.8
    similarity: float = 0.85
    most_gap: int = 3
    budget: float = 0.4

    def __post_init__(self) -> None:
        if not (0 < self.overlap <= 1 and -1 <= self.similarity <= 1 and 0 <= self.budget <= 1):
            raise ValueError("overlap, similarity and budget must be shares")
        if self.most_words < 1 or self.most_gap < 0:
            raise ValueError("most_words must be positive, most_gap not negative")


@dataclass(eq=False)
class _Piece:
    key: str
    ids: tuple[int, ...]
    pages: tuple[int, ...]
    sources: tuple[str, ...]
    short: tuple[str, ...] = ()

    @cached_property
    def order(self) -> tuple:
        tail = re.search(r"\d+$", self.key)
        return (self.ids[0], self.ids[-1], len(self.ids), self.key[: tail.start()] if tail else self.key, int(tail.group()) if tail else -1, self.key)


class Merger:
    """The merge steps over the pieces of one filing."""

    def __init__(self, pieces: list[_Piece], words: dict[int, str], settings: Settings, embedder: Embedder):
        self.pieces = sorted(pieces, key=lambda p: p.order)
        self.sentences, self.settings, self.embedder = words, settings, embedder
        self.lengths = {i: len(x.split()) for i, x in words.items()}
        self.events: list[dict] = []
        # new chunks go on behind the ones there are
        self.made = max([len(self.pieces), *(int(n) for p in self.pieces if (n := p.key.removeprefix("chunk_")).isdigit() and n != p.key)])

    def text(self, ids: tuple[int, ...]) -> str:
        return " ".join(self.sentences[i] for i in ids if i in self.sentences)

    def size(self, ids: Iterable[int]) -> int:
        return sum(self.lengths.get(i, 0) for i in ids)

    def fits(self, a: _Piece, b: _Piece) -> bool:
        return self.size({*a.ids, *b.ids}) <= self.settings.most_words

    def join(self, a: _Piece, b: _Piece, phase: str, score: float) -> _Piece:
        self.made += 1
        both = _Piece(f"chunk_{self.made:06d}", tuple(sorted({*a.ids, *b.ids})), tuple(sorted({*a.pages, *b.pages})), tuple(sorted({*a.sources, *b.sources})))
        self.events.append({"phase": phase, "merged": both.key, "first": a.key, "second": b.key, "score": score})
        return both

    def repair_short(self) -> None:
        """The first short piece in order that fits joins the piece before it, again and again."""
        s = self.settings
        ends: dict[int, dict[_Piece, None]] = {}
        shorts: dict[int, list[_Piece]] = {}
        alive = dict.fromkeys(self.pieces)
        for p in self.pieces:
            ends.setdefault(p.ids[-1] + 1, {})[p] = None
            if len(p.ids) <= s.small_sentences and p.short and self.size(p.ids) <= s.small_words:
                shorts.setdefault(p.ids[0], []).append(p)
        waiting = [(p.order, n, p) for n, p in enumerate(p for held in shorts.values() for p in held)]
        made = len(waiting)
        heapify(waiting)
        while waiting:
            p = heappop(waiting)[2]
            before = ends.get(p.ids[0]) if p in alive else None
            if not before:
                continue
            q = min(before, key=lambda x: (-len(x.ids), x.ids[0], x.order))
            if not self.fits(q, p):
                continue
            both = self.join(q, p, "short_previous_repair", 0.0)
            for x in (p, q):
                del alive[x], ends[x.ids[-1] + 1][x]
            alive[both] = ends.setdefault(both.ids[-1] + 1, {})[both] = None
            # only what starts where one of them ended has another piece before it now
            for start in {p.ids[0], p.ids[-1] + 1}:
                for x in shorts.get(start, ()):
                    if x in alive:
                        made += 1
                        heappush(waiting, (x.order, made, x))
        self.pieces = sorted(alive, key=lambda x: x.order)

    def drop_contained(self, phase: str) -> None:
        sets = {p: frozenset(p.ids) for p in self.pieces}
        holders: dict[int, list[_Piece]] = {}
        for p in self.pieces:
            for i in p.ids:
                holders.setdefault(i, []).append(p)
        target = {}
        for p in self.pieces:
            over = [q for q in holders[p.ids[0]] if q is not p and sets[p] <= sets[q] and (len(q.ids) > len(p.ids) or q.order < p.order)]
            if over:
                target[p] = min(over, key=lambda q: (-len(q.ids), q.order))
        for p in sorted(target, key=lambda x: x.order, reverse=True):
            q = target[p]
            q.sources = tuple(sorted({*q.sources, *p.sources}))
            self.events.append({"phase": phase, "merged": q.key, "first": q.key, "second": p.key, "score": 1.0})
        self.pieces = [p for p in self.pieces if p not in target]

    def merge_best(self, phase: str, near, ranks, most: int | None = None, added=None, blocker=None) -> None:
        """The best pair merges, again and again, at most ``most`` times.

        ``near`` gives the keys under which a piece is kept and those under which its neighbours
        are found; ``ranks`` the (rank, score, piece) of the neighbours that may merge with a piece,
        the least rank first; equal ranks go by the order of the pieces.  A pair for which
        ``blocker`` names a piece waits until that piece is gone.
        """
        alive = dict.fromkeys(self.pieces)
        ordered = [(p.order, p) for p in self.pieces]
        held_back: dict[_Piece, list] = {}
        kept: dict = {}
        waiting: list = []
        made = 0

        def offer(p: _Piece) -> None:
            nonlocal made
            at, look = near(p)
            found = dict.fromkeys(q for k in look for q in kept.get(k, ()))
            for rank, score, q in ranks(p, found):
                made += 1
                a, b = (p, q) if p.order < q.order else (q, p)
                heappush(waiting, (rank, a.order, b.order, made, score, a, b))
            for k in at:
                kept.setdefault(k, {})[p] = None

        for p in self.pieces:
            offer(p)
        while waiting and (most is None or most > 0):
            entry = heappop(waiting)
            score, a, b = entry[4:]
            if a not in alive or b not in alive or not self.fits(a, b):
                continue
            if blocker and (between := blocker(ordered, a, b)):
                held_back.setdefault(between, []).append(entry)
                continue
            both = self.join(a, b, phase, score)
            for x in (a, b):
                del alive[x], ordered[bisect_left(ordered, x.order, key=lambda o: o[0])]
                for k in near(x)[0]:
                    del kept[k][x]
                for entry in held_back.pop(x, ()):
                    heappush(waiting, entry)
            alive[both] = None
            insort(ordered, (both.order, both), key=lambda o: o[0])
            if added:
                added(both, a, b)
            offer(both)
            if most is not None:
                most -= 1
        self.pieces = sorted(alive, key=lambda x: x.order)

    def merge_overlaps(self) -> None:
        def ranks(p: _Piece, others):
            ids = set(p.ids)
            for q in others:
                ratio = len(ids.intersection(q.ids)) / min(len(p.ids), len(q.ids))
                if ratio >= self.settings.overlap:
                    size = self.size(ids.union(q.ids))
                    if size <= self.settings.most_words:
                        yield (-ratio, size), ratio, q

        self.merge_best("high_overlap_merge", lambda p: (p.ids, p.ids), ranks)

    def merge_similar(self, budget: int) -> None:
        import numpy as np

        gap = self.settings.most_gap
        if len(self.pieces) < 2 or budget < 1:
            return
        vectors = {}
        for n in range(0, len(self.pieces), BATCH):
            some = self.pieces[n : n + BATCH]
            vectors.update(zip(some, np.array(self.embedder.encode([self.text(p.ids) for p in some]))))

        def near(p: _Piece) -> tuple[list, list]:
            at = [*p.ids, *(("page", n) for n in p.pages)]
            return at, [*sorted({i + d for i in p.ids for d in range(-gap, gap + 1)}), *sorted({("page", n + d) for n in p.pages for d in (-1, 0, 1)})]

        def ranks(p: _Piece, others):
            if others:
                scores = np.stack([vectors[q] for q in others]) @ vectors[p]
                for q, score in zip(others, scores.tolist()):
                    if score > self.settings.similarity:
                        yield -score, score, q

        def added(both: _Piece, a: _Piece, b: _Piece) -> None:
            del vectors[a], vectors[b]
            vectors[both] = np.array(self.embedder.encode([self.text(both.ids)]))[0]

        def blocker(ordered: list, a: _Piece, b: _Piece) -> _Piece | None:
            # behind the first piece that is far in sentences and pages nothing is looked at
            end = a.ids[-1] + gap
            if b.ids[0] <= end:
                return None
            for at in range(bisect_left(ordered, (end + 1,), key=lambda o: o[0]), len(ordered)):
                c = ordered[at][1]
                if c is b:
                    return None
                if not any(abs(p - q) <= 1 for p in a.pages for q in c.pages):
                    return c
            return None

        self.merge_best("embedding_greedy_merge", near, ranks, budget, added, blocker)

    def run(self) -> None:
        if len(self.pieces) < 2:
            return
        budget = int(len(self.pieces) * self.settings.budget)
        self.repair_short()
        self.drop_contained("containment_cleanup")
        self.merge_overlaps()
        self.merge_similar(budget)
        self.drop_contained("final_containment_cleanup")


def merge(chunks: DataFrame, sentences: DataFrame, settings: Settings = Settings(), embedder: Embedder | None = None) -> DataFrame:
    """(document_id, segment, kind, key, ids, sources, phase, first, second, seq, score).

    Rows of kind ``chunk`` are the chunks at the end, rows of kind ``event`` the merges in order.
    A filing is one segment, 0.
    """
    model = embedder or HashedWords()
    held = chunks.select("document_id", "chunk_id", "ids", "page_span")
    used = held.select("document_id", F.explode("ids").alias("sentence_id")).distinct()
    said = sentences.select("document_id", "sentence_id", F.col("text").alias("sentence")).join(used, ["document_id", "sentence_id"], "left_semi")
    said = said.withColumn("short", text.short_answer_reasons(F.col("sentence")))
    schema = "document_id string, segment int, kind string, key string, ids array<bigint>, sources array<string>, phase string, first string, second string, seq int, score double"

    def work(chunk_rows: pd.DataFrame, sentence_rows: pd.DataFrame) -> pd.DataFrame:
        words, short = {}, {}
        for r in sentence_rows.itertuples():
            if r.sentence is not None:
                words[int(r.sentence_id)] = r.sentence
            if r.short is not None and len(r.short):
                short[int(r.sentence_id)] = tuple(r.short)
        pieces = {}
        for r in chunk_rows.itertuples():
            if r.chunk_id not in pieces:
                ids = tuple(int(i) for i in r.ids)
                span = [int(p) for p in r.page_span if p is not None] if r.page_span is not None else []
                pieces[r.chunk_id] = _Piece(r.chunk_id, ids, tuple(sorted(set(span))), (r.chunk_id,), short.get(ids[0], ()) if len(ids) == 1 else ())
        if not pieces:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        merger = Merger(list(pieces.values()), words, settings, model)
        merger.run()
        document = chunk_rows["document_id"].iloc[0]
        out = [(document, 0, "chunk", p.key, list(p.ids), list(p.sources), None, None, None, n, None) for n, p in enumerate(merger.pieces, 1)]
        out += [(document, 0, "event", e["merged"], None, None, e["phase"], e["first"], e["second"], n, e["score"]) for n, e in enumerate(merger.events, 1)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return held.groupBy("document_id").cogroup(said.groupBy("document_id")).applyInPandas(work, schema)
