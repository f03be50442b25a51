"""Problem 6: token ids of a whole corpus with a public byte-level BPE vocabulary.

Each partition is encoded where it lies; nothing is shuffled.  Inside a partition the words
not met before go through a recursive DuckDB query: one row per (piece, position, token), a join
of neighbouring tokens with the merge table, contraction of every piece's leftmost pair of least
rank, repeated until no pair can be merged.  Texts are then assembled from the word -> ids
table.  Decoding is an ordered DuckDB aggregation over (text, position, id) rows.

A word longer than a window is encoded as overlapping windows.  Two windows are put together
behind a token that both have at the same place; where they have none, a window that begins at a
token of the first comes between them, and where even that has none the word's windows become
twice as wide.  This is exact: a row of tokens is the encoding of its text if and only if every
two neighbours are the encoding of theirs (no merge can cross a boundary first), and every two
neighbours of the result stand side by side in one of the windows.

Defined results: a null or empty text has the empty array; white space is text; rows are kept
one for one, repeated ids included; further columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies are installed; a parameter of every function below.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"

# fixed value: the split pattern that belongs to the byte-level vocabularies
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of a window; each shares half of them with the next one.
WINDOW = 32
#: Rows that the steps of one recursive query may make (a piece of n bytes makes n * n / 2 at most); bounds DuckDB's memory.
ROWS_PER_QUERY = 1_000_000
#: Word ids remembered by a worker; when full the memory starts afresh (speed only, never results).
REMEMBERED_WORDS = 300_000

_CONTRACT = """
WITH RECURSIVE state AS (
    SELECT 0 AS step, w, pos, tok FROM symbols
    UNION ALL
    SELECT step + 1, w, pos, CASE WHEN pos = target THEN best // 4294967296 ELSE tok END
    FROM (
        SELECT step, w, pos, tok, before, best, best % 4294967296 AS target
        FROM (
            SELECT p.step, p.w, p.pos, p.tok, p.before,
                   min(m.made * 4294967296 + p.pos) OVER (PARTITION BY p.w) AS best
            FROM (
                SELECT step, w, pos, tok,
                       tok * 65536 + lead(tok) OVER seq AS pair, lag(pos) OVER seq AS before
                FROM state
                WINDOW seq AS (PARTITION BY w ORDER BY pos)
            ) p LEFT JOIN merges m ON p.pair = m.pair
        )
        WHERE best IS NOT NULL
    )
    WHERE before IS DISTINCT FROM target
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM (SELECT w, pos, tok, step, max(step) OVER (PARTITION BY w) AS final FROM state)
WHERE step = final GROUP BY w ORDER BY w
"""

_DECODE = """
SELECT t.i AS i, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.i
"""


class Encoder:
    """A vocabulary loaded into one worker's DuckDB, with the words it has met so far."""

    _loaded: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import duckdb
        import numpy as np
        import regex

        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        pairs, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    made.append(rank)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.first = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.size = {rank: len(token) for token, rank in ranks.items()}
        # the rows of a query are bounded, so nothing needs a folder to spill to
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.con.register("given", pa.table({"pair": pa.array(pairs, pa.int64()), "made": pa.array(made, pa.int64())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.register("words", pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "hex": [t.hex() for t in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM words")

    def contract(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece by the recursive query, in batches of bounded size."""
        import numpy as np

        out: list[list[int]] = []
        at = 0
        while at < len(pieces):
            end, rows = at, 0
            while end < len(pieces) and (end == at or rows + len(pieces[end]) ** 2 // 2 <= ROWS_PER_QUERY):
                rows += len(pieces[end]) ** 2 // 2
                end += 1
            some = pieces[at:end]
            sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            flat = self.first[np.frombuffer(b"".join(some), dtype=np.uint8)]
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.con.register("symbols", pa.table({"w": np.repeat(np.arange(len(some)), sizes), "pos": pos, "tok": flat}))
            out += self.con.sql(_CONTRACT).to_arrow_table()["ids"].to_pylist()
            at = end
        return out

    def learn(self, words: list[str]) -> None:
        """Encode ``words`` and remember their ids."""
        # a lone surrogate cannot be UTF-8; it becomes the replacement sign, as in the libraries
        raw = [w.encode("utf-8", "replace") for w in words]
        ids: dict[bytes, list[int]] = {}
        width = dict.fromkeys(range(len(raw)), WINDOW)
        needed = {raw[w][a : a + WINDOW] for w in width for a in range(0, max(1, len(raw[w]) - WINDOW // 2), WINDOW // 2)}
        while width:
            fresh = sorted(needed, key=len)
            ids.update(zip(fresh, self.contract(fresh)))
            needed = set()
            for w in list(width):
                found = self._joined(raw[w], width[w], ids, needed)
                while found is None:
                    width[w] *= 2
                    found = self._joined(raw[w], width[w], ids, needed)
                if found:
                    self.known[words[w]] = found
                    del width[w]

    def _joined(self, raw: bytes, width: int, ids: dict[bytes, list[int]], needed: set[bytes]) -> list[int] | None:
        """The ids of ``raw`` put together from its windows.

        Windows without ids are added to ``needed`` and the result is empty; it is None where two
        windows share no token and wider ones are wanted.
        """
        if len(raw) <= width:
            if raw not in ids:
                needed.add(raw)
                return []
            return ids[raw]
        out: list[int] = []
        places: dict[int, tuple[int, int]] = {}  # start of a token of the last window: its end, and the tokens up to it
        start = end = 0
        whole = True

        def join(a: int, tokens: list[int]) -> bool:
            """Put a window that begins at ``a`` behind a token it shares with the last one."""
            nonlocal places, start, end
            at, skip = a, 0
            if places:
                for k, t in enumerate(tokens, 1):
                    size = self.size[t]
                    if places.get(at, (0, 0))[0] == at + size:
                        skip = k
                        del out[places[at][1] :]
                        at += size
                        break
                    at += size
                if not skip:
                    return False
            kept = {k: v for k, v in places.items() if v[1] <= len(out) and k >= a} if skip else {}
            for t in tokens[skip:]:
                out.append(t)
                kept[at] = (at + self.size[t], len(out))
                at += self.size[t]
            places, start, end = kept, a, at
            return True

        grid = iter(range(0, len(raw) - width // 2, width // 2))
        a = next(grid)
        while end < len(raw):
            if a < len(raw) and min(a + width, len(raw)) > end:
                part = raw[a : a + width]
                if part not in ids:
                    needed.add(part)
                    whole, places = False, {}
                    end = max(end, a)
                    a = next(grid, len(raw))
                    if a == len(raw):
                        break
                    continue
                if join(a, ids[part]):
                    a = next(grid, len(raw))
                    continue
                between = min((p for p in places if start < p < end), key=lambda p: abs(p - start - width // 2), default=None)
                if between is None:
                    return None
                part = raw[between : between + width]
                if part not in ids:
                    needed.add(part)
                    whole, places = False, {}  # go on behind the gap
                elif not join(between, ids[part]):
                    return None
            else:
                a = next(grid, len(raw))
                if a == len(raw) and end < len(raw):
                    between = min((p for p in places if start < p < end), key=lambda p: abs(p - start - width // 2), default=None)
                    part = raw[between : between + width] if between is not None else b""
                    if not part or (part in ids and not join(between, ids[part])):
                        return None
                    if part not in ids:
                        needed.add(part)
                        whole = False
                        break
        return out if whole else []

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        import numpy as np

        pieces = [self.split(t) if t else [] for t in texts]
        fresh = set(itertools.chain.from_iterable(pieces)).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED_WORDS:
                self.known.clear()
                fresh = set(itertools.chain.from_iterable(pieces))
            self.learn(list(fresh))
        known = self.known
        rows = [list(itertools.chain.from_iterable([known[w] for w in p])) for p in pieces]
        ends = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=ends[1:])
        flat = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int32, count=int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def decode(self, rows: list[list[int] | None]) -> list[str]:
        """Texts of ``rows`` by an ordered aggregation; a null or empty array gives the empty text."""
        import numpy as np

        sizes = np.fromiter((len(r or ()) for r in rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter(itertools.chain.from_iterable(r or () for r in rows), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.con.register("tokens", pa.table({"i": owner, "pos": pos, "id": flat}))
        texts = [""] * len(rows)
        for i, code in self.con.sql(_DECODE).fetchall():
            texts[i] = bytes.fromhex(code).decode("utf-8", "replace")
        return texts


def _slices(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose text stays near ``most`` bytes, so memory follows no batch size."""
    size = batch.column(column).nbytes
    step = max(1, int(batch.num_rows * most / size)) if size > most else max(1, batch.num_rows)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def encode_texts(frame: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) for every row of ``frame``."""
    path = f"{directory}/{RANK_FILE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for whole in batches:
            for batch in _slices(whole, 1):
                ids = encoder.encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    source = frame.select(F.col(key), F.col(text).cast("string").alias(text))
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(frame: DataFrame, key: str = "doc_id", ids: str = "ids", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text) for every row of ``frame``; a null or empty array gives the empty text."""
    path = f"{directory}/{RANK_FILE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for whole in batches:
            for batch in _slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.decode(batch.column(1).to_pylist()), pa.string())], names=[key, "text"])

    source = frame.select(F.col(key), F.col(ids))
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, text string")
