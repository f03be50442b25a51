"""Problem 3: pieces under a size limit, cut at natural boundaries, with overlap.

A text becomes a tree: document, sections under headings, blocks (paragraphs, list items, lines),
sentences, clauses, words.  Siblings are merged from the left while they fit under the limit; only
a node that is larger than the limit by itself is opened and its children are merged in the same
way.  A new piece first repeats the last ``overlap`` whole sentences of the piece before it, as
many of them as fit beside its first new sentence; a node that doesn't fit beside them is opened.  Sentences are those of the sentence table where
the text still agrees with them; elsewhere they end at a closing sign.

Each piece is a slice of the original text, so the new parts of all pieces put together give the
text back.  Defined results: a null text has no pieces; an empty or blank text is one piece of no
words; a null, missing or non-positive limit is no limit; a null overlap is none; ids that are
null, repeated or without a sentence are ignored; repeated chunk rows each give their pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_WORD = re.compile(r"\S+")
_CLOSED = re.compile(r"""[.!?…]["'”’»)\]]*$""")
_CLAUSE = re.compile(r"[;:,–—]$")
_HEADING = re.compile(r"(#{1,6})\s|(={2,6})\s")
_ITEM = re.compile(r"\s*(?:[-*•·]|\d{1,3}[.)]|\(?[a-z]\))\s")
#: A break of this kind separates two sentences: none, a line, a paragraph.
_INLINE, _LINE, _PARAGRAPH = 0, 1, 2


def word_count(text: Column) -> Column:
    """Words of a text, separated by any Unicode white space."""
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{_SPACE[1:-1]}]+"), F.lit(0)))


@dataclass
class Node:
    """Words ``first`` to ``last`` (exclusive); a leaf sentence knows its ids."""

    first: int
    last: int
    children: list["Node"] = field(default_factory=list)
    sentence: int = -1
    whole: bool = False

    @property
    def words(self) -> int:
        return self.last - self.first


def _sentences(text: str, spans: list[tuple[int, int]], known: list[tuple[int, str]]) -> tuple[list[Node], list[int | None]]:
    """Sentence nodes in reading order and the id of each (None where no row agrees)."""
    words = [text[a:b] for a, b in spans]
    by_first: dict[str, list[tuple[list[str], int]]] = {}
    for key, value in known:
        parts = value.split()
        if parts:
            by_first.setdefault(parts[0], []).append((parts, key))
    for rows in by_first.values():
        rows.sort(key=lambda row: (-len(row[0]), row[1]))

    def known_at(i: int) -> tuple[int, int] | None:
        for parts, key in by_first.get(words[i], ()):
            if words[i : i + len(parts)] == parts:
                return len(parts), key
        # the end of a text may break off inside its last sentence
        for parts, key in by_first.get(words[i], ()):
            rest = words[i:]
            if len(rest) >= 4 and len(rest) < len(parts) and parts[: len(rest) - 1] == rest[:-1] and parts[len(rest) - 1].startswith(rest[-1]):
                return len(rest), key
        return None

    nodes, ids, i = [], [], 0
    while i < len(words):
        found = known_at(i)
        if found:
            size, key = found
        else:
            size, key = 1, None
            while i + size < len(words):
                gap = text[spans[i + size - 1][1] : spans[i + size][0]]
                if _CLOSED.search(words[i + size - 1]) or gap.count("\n") > 1 or (words[i + size] in by_first and known_at(i + size)):
                    break
                size += 1
        nodes.append(Node(i, i + size, sentence=len(nodes), whole=True))
        ids.append(key)
        i += size
    return nodes, ids


def _halves(node: Node, words: list[str], limit: int) -> None:
    """Open an oversized sentence into clauses, and an oversized clause into runs of words."""
    cuts = [i + 1 for i in range(node.first, node.last - 1) if _CLAUSE.search(words[i])]
    if not cuts:
        cuts = list(range(node.first + limit, node.last, limit))
    edges = [node.first, *cuts, node.last]
    node.children = [Node(a, b, sentence=node.sentence) for a, b in zip(edges, edges[1:])]


def tree_of(text: str, spans: list[tuple[int, int]], sentences: list[Node]) -> Node:
    """Sections, blocks and sentences as a tree."""
    root = Node(0, len(spans))
    blocks: list[Node] = []
    for node in sentences:
        gap = text[spans[node.first - 1][1] : spans[node.first][0]] if node.first else "\n\n"
        kind = _PARAGRAPH if gap.count("\n") > 1 else _LINE if "\n" in gap else _INLINE
        if kind or not blocks:
            blocks.append(Node(node.first, node.last, [node]))
        else:
            blocks[-1].children.append(node)
            blocks[-1].last = node.last
    # headings own what follows up to the next heading of their level or above
    path: list[tuple[int, Node]] = [(0, root)]
    for block in blocks:
        head = _HEADING.match(text, spans[block.first][0])
        if head:
            level = len(head.group(1) or head.group(2))
            while path[-1][0] >= level:
                path.pop()
            section = Node(block.first, block.last)
            path[-1][1].children.append(section)
            path.append((level, section))
        elif _ITEM.match(text, spans[block.first][0]) and path[-1][1].children and path[-1][1].children[-1].children:
            before = path[-1][1].children[-1]
            opened = _ITEM.match(text, spans[before.first][0])
            if opened:  # items of one list stay under one node
                if before.children[0].sentence >= 0:
                    before.children = [Node(before.first, before.last, before.children)]
                before.children.append(block)
                for _, owner in path:
                    owner.last = max(owner.last, block.last)
                before.last = block.last
                continue
        path[-1][1].children.append(block)
        for _, owner in path:
            owner.last = max(owner.last, block.last)
    return root


def pieces_of(text: str, limit: int | None, overlap: int, known: list[tuple[int, str]]) -> list[tuple[int, int, int, list[int]]]:
    """(start, new_start, end, sentence ids) of each piece; offsets count characters of ``text``."""
    spans = [m.span() for m in _WORD.finditer(text)]
    sentences, ids = _sentences(text, spans, known)
    if not limit or limit < 1 or len(spans) <= limit:
        return [(0, 0, len(text), sorted({k for k in ids if k is not None}))]
    words = [text[a:b] for a, b in spans]
    done: list[tuple[int, int, int]] = []  # (first word, first new word, last word)
    open_piece: list[int] | None = None
    whole_ends: list[Node] = []  # whole sentences in the order they were placed

    def repeated(first_new: int, room: int) -> int:
        """The first word of the piece that begins at ``first_new``, with what it repeats."""
        start = first_new
        if done and overlap > 0:
            back = done[-1]
            for node in whole_ends[: -overlap - 1 : -1]:
                if node.last != start or node.first < back[0] or first_new - node.first > room:
                    break
                start = node.first
        return start

    def flush() -> None:
        nonlocal open_piece
        if open_piece and open_piece[2] > open_piece[1]:
            done.append(tuple(open_piece))
        open_piece = None

    def leaves(node: Node) -> Iterator[Node]:
        if node.whole:
            yield node
        for child in node.children:
            yield from leaves(child)

    def place(node: Node) -> None:
        nonlocal open_piece
        if open_piece and node.last - open_piece[0] <= limit:
            open_piece[2] = node.last
        elif node.words <= limit:
            flush()
            head = node
            while head.children and not head.whole:
                head = head.children[0]
            start = repeated(node.first, limit - head.words)
            if node.last - start > limit:  # what is repeated fits beside the first sentence, not beside the whole node
                open_piece = [start, node.first, node.first]
                for child in node.children:
                    place(child)
                return
            open_piece = [start, node.first, node.last]
        else:
            flush()
            if not node.children:
                _halves(node, words, limit)
            for child in node.children:
                place(child)
            flush()
            return
        whole_ends.extend(leaves(node))

    place(tree_of(text, spans, sentences))
    flush()
    out = []
    last_end = 0
    starts = [n.first for n in sentences]
    for number, (first, new, last) in enumerate(done):
        inside = sorted({ids[k] for k in range(bisect_right(starts, first) - 1, bisect_left(starts, last)) if ids[k] is not None})
        end = len(text) if number == len(done) - 1 else spans[last - 1][1]
        out.append((0 if not number else spans[first][0], 0 if not number else last_end, end, inside))
        last_end = end
    return out


_PIECES = "chunk_key {key}, piece_no int, oversized boolean, text string, words int, sentence_ids array<bigint>, new_from int"


def split_chunks(chunks: DataFrame, sentences: DataFrame, configs: DataFrame) -> DataFrame:
    """(chunk_key, piece_no, oversized, text, words, sentence_ids, new_from) for every chunk with a text.

    ``new_from`` is the offset in ``text`` at which the part not repeated from the piece before begins.
    """
    limits = configs.groupBy("config_id").agg(F.max("max_tokens").alias("max_tokens"), F.max("overlap").alias("overlap"))
    # equal rows share one address, so the text itself travels once and the sentences once
    base = chunks.where(F.col("text").isNotNull()).select("chunk_key", "document_id", "config_id", "sentence_ids", "text", F.xxhash64("chunk_key", "document_id", "sentence_ids").alias("nr"))
    wanted = base.select("nr", "document_id", F.explode("sentence_ids").alias("sentence_id")).distinct()
    rows = sentences.where(F.col("text").isNotNull()).groupBy("document_id", "sentence_id").agg(F.min("text").alias("sentence"))
    held = wanted.join(rows, ["document_id", "sentence_id"]).groupBy("document_id", "nr").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "sentence"))).alias("known"))
    ready = base.join(limits, "config_id", "left").join(held, ["document_id", "nr"], "left")
    kind = chunks.schema["chunk_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for key, text, limit, overlap, known in zip(*(batch.column(i).to_pylist() for i in range(5))):
                pieces = pieces_of(text, limit, max(0, overlap or 0), [(k["sentence_id"], k["sentence"]) for k in known or ()])
                for number, (start, new, end, inside) in enumerate(pieces, 1):
                    part = text[start:end]
                    for column, value in zip(out, (key, number, len(pieces) > 1, part, len(part.split()), inside, max(0, new - start))):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["chunk_key", "piece_no", "oversized", "text", "words", "sentence_ids", "new_from"])

    return ready.select("chunk_key", "text", "max_tokens", "overlap", "known").mapInArrow(run, _PIECES.format(key=kind))
