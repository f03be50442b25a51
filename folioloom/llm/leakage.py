"""Problem 7: passages of held-out items inside a training corpus.

Word n-grams of the held-out items become a hash set that travels with the scan of the corpus.
Every window of a text is hashed and looked up; hits are verified word by word and added up per
item.  The corpus is read once and never shuffled.

Where the items hold more than ``WORDS_PER_BLOCK`` words, no task and no driver holds them all: a
bit map of fixed size travels instead, and only windows whose bit is set, with their words, meet
the n-grams of the items in a join.  The corpus is still read once, and the results are the same.

Words are runs of letters and digits after removal of markup, in NFKC and without case.  A copied
passage is a run of at least ``RUN`` consecutive words of the item; a text leaks an item when its
passages together cover at least ``SHARE`` of the item's words.

Defined results: null and empty texts and items leak nothing; an item shorter than ``RUN`` words
cannot be found; repeated rows of the corpus each give their own result, rows that agree in key
and item appear once per row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.sources.durable import written

RUN = 8
SHARE = 0.4
#: Words of held-out text in one hash set (about 16 bytes each); beyond that a bit map travels.
WORDS_PER_BLOCK = 2_000_000
#: The bit map has 2 ** MAP_BITS bits (16 MB).
MAP_BITS = 27

_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"[<&\\\[{]")
_MARKUP = re.compile(
    r"<!--.*?-->|</?[A-Za-z][^<>]*>"  # elements and comments
    r"|(?<=\])\([^()\s]*\)"  # targets of links
    r"|\\(?:begin|end)\{[^{}]*\}|\\[A-Za-z]+\*?"  # commands
    r"|\[\[(?:[^\[\]|]*\|)?(?=[^\[\]]*\]\])",  # left half of a piped wiki link
    re.DOTALL,
)


def plain(text: str) -> str:
    """``text`` without markup, character by character replaced only where markup stood."""
    if _MARKED.search(text):
        text = _MARKUP.sub(" ", html.unescape(text) if "&" in text else text)
    return text


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = plain(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def _hashes(ids, run: int):
    """Polynomial hashes of all windows of ``run`` ids; a window with an unknown word gets 0."""
    import numpy as np

    n = len(ids) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    whole = np.ones(n, dtype=bool)
    for k in range(run):
        part = ids[k : k + n]
        out = out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        whole &= part > 0
    out[~whole] = 0
    return out


class ItemSet:
    """Held-out items as word ids and a sorted array of window hashes."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        import numpy as np

        self.run = run
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        spread = []
        where = []
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if len(ids) < run:
                continue
            found = _hashes(np.array(ids, dtype=np.int64), run)
            spread.append(found)
            where += [(len(self.items), p) for p in range(len(found))]
            self.items.append((key, ids))
        hashes = np.concatenate(spread) if spread else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.where = [where[i] for i in order]

    def scan(self, texts: list[str | None], share: float) -> list[dict[int, tuple[set[int], set[int]]]]:
        """For each text: item index -> (covered item positions, word positions in the text)."""
        import numpy as np

        get = self.vocabulary.get
        ids: list[int] = []
        start = []
        for text in texts:
            start.append(len(ids))
            ids += [get(w, 0) for w in words_of(text)]
            ids.append(0)
        start.append(len(ids))
        out: list[dict[int, tuple[set[int], set[int]]]] = [{} for _ in texts]
        if not len(self.hashes):
            return out
        flat = np.array(ids, dtype=np.int64)
        windows = _hashes(flat, self.run)
        at = np.flatnonzero(windows)
        low = np.searchsorted(self.hashes, windows[at])
        ok = low < len(self.hashes)
        ok[ok] = self.hashes[low[ok]] == windows[at[ok]]
        at, low = at[ok], low[ok]
        high = np.searchsorted(self.hashes, windows[at], side="right")
        owner = np.searchsorted(np.array(start), at, side="right") - 1
        for i, lo, hi, doc in zip(at.tolist(), low.tolist(), high.tolist(), owner.tolist()):
            window = ids[i : i + self.run]
            for k in range(lo, hi):
                item, p = self.where[k]
                if self.items[item][1][p : p + self.run] == window:
                    covered, places = out[doc].setdefault(item, (set(), set()))
                    covered.update(range(p, p + self.run))
                    places.update(range(i - start[doc], i - start[doc] + self.run))
        return [{item: v for item, v in found.items() if len(v[0]) >= share * len(self.items[item][1])} for found in out]


def _rows(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")


def _block(rows: DataFrame) -> ItemSet | None:
    """The held-out items as one set, or None where they are too many; measured before anything is collected."""
    words = rows.agg(F.sum(F.length("t") / 2)).first()[0] or 0  # no word is shorter than two characters with its gap
    return ItemSet([(r.k, r.t) for r in rows.collect()]) if words <= WORDS_PER_BLOCK else None


_WORD_HASHES: dict[str, int] = {}


def _grams(words: list[str]):
    """A hash of every window of ``RUN`` words, the same in every worker."""
    import numpy as np

    if len(_WORD_HASHES) > 500_000:
        _WORD_HASHES.clear()
    for w in set(words).difference(_WORD_HASHES):
        _WORD_HASHES[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 2 | 1
    return _hashes(np.array([_WORD_HASHES[w] for w in words], dtype=np.int64), RUN).view(np.int64)


def _windows(frame: DataFrame, key: str, text: str, bits=None) -> DataFrame:
    """(key, row, words, at, hash, gram) of the windows of each text; with ``bits`` only those whose bit is set."""
    source = frame.select(F.col(key), F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull()).withColumn("row", F.xxhash64(key, text))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            owner, sizes, at, hashes, grams = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                words = words_of(value)
                found = _grams(words)
                places = np.arange(len(found))
                if bits is not None and len(found):
                    slot = found & ((1 << MAP_BITS) - 1)
                    places = np.flatnonzero(bits.value[slot >> 3] & (1 << (slot & 7)).astype(np.uint8))
                owner += [i] * len(places)
                sizes += [len(words)] * len(places)
                at += places.tolist()
                hashes += found[places].tolist()
                grams += [" ".join(words[p : p + RUN]) for p in places.tolist()]
            where = pa.array(owner, pa.int64())
            columns = [batch.column(0).take(where), batch.column(2).take(where), pa.array(sizes, pa.int32()), pa.array(at, pa.int32()), pa.array(hashes, pa.int64()), pa.array(grams, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "row", "words", "at", "hash", "gram"])

    return source.mapInArrow(run, f"`{key}` {kind}, row bigint, words int, at int, hash bigint, gram string")


def _joined(documents: DataFrame, rows: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """(key, row, item, item_words, covered, places): leaks by a join of windows, for any number of items."""
    import numpy as np

    held = written(_windows(rows, "k", "t"), "held")
    slot = F.col("hash").bitwiseAND((1 << MAP_BITS) - 1)
    octets = held.groupBy(F.shiftright(slot, 3).alias("octet")).agg(F.bit_or(F.expr("shiftleft(1, CAST(hash & 7 AS INT))")).alias("bits"))
    bits = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    for r in octets.toLocalIterator():  # no more than the map has octets
        bits[r.octet] = r.bits
    near = _windows(documents, key, text, documents.sparkSession.sparkContext.broadcast(bits)).select(F.col(key).alias("d"), "row", F.col("at").alias("place"), "hash", "gram")
    hits = near.join(held.select(F.col("k").alias("item"), F.col("words").alias("item_words"), "at", "hash", "gram"), ["hash", "gram"])
    per = hits.groupBy("d", "row", "item", "item_words").agg(F.collect_set("at").alias("at"), F.collect_set("place").alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + RUN - 1)))))
    return per.withColumn("covered", covered).where(F.col("covered") >= F.lit(share) * F.col("item_words")).select("d", "row", "item", "item_words", "covered", "places")


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", share: float = SHARE) -> DataFrame:
    """(key, item_id, covered, item_words): the items that each document leaks."""
    source = documents.select(F.col(key), F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull())
    kind = source.schema[key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    rows = _rows(items, item_key, item_text)
    block = _block(rows)
    if block is None:
        found = written(_joined(documents, rows, key, text, share), "leaks")
        each = source.select(F.col(key).alias("d"), F.xxhash64(key, text).alias("row"))
        return each.join(found, ["d", "row"]).select(F.col("d").alias(key), F.col("item").alias(item_key), F.col("covered").cast("int").alias("covered"), "item_words")
    shipped = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        for batch in batches:
            keys, found = batch.column(0).to_pylist(), block.scan(batch.column(1).to_pylist(), share)
            rows = [(k, block.items[item][0], len(c), len(block.items[item][1])) for k, f in zip(keys, found) for item, (c, _) in f.items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (batch.schema.field(0).type, None, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k or pa.int64()) for c, k in zip(columns, kinds)], names=[key, item_key, "covered", "item_words"])

    return source.mapInArrow(run, f"`{key}` {kind}, `{item_key}` {item_kind}, covered int, item_words int")


def without_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", share: float = SHARE) -> DataFrame:
    """(key, text, removed_words): texts without the leaked passages, all other text untouched.

    A null text stays null.  Where markup or compatibility characters change the word count of a
    text, the passage is cut from the text without markup.
    """
    source = documents.select(F.col(key), F.col(text).cast("string").alias(text))
    kind = source.schema[key].dataType.simpleString()

    def cut(value: str, places: set[int]) -> str:
        spans = [m.span() for m in _WORD.finditer(value)]
        if len(spans) != len(words_of(value)):
            value = unicodedata.normalize("NFKC", plain(value))
            spans = [m.span() for m in _WORD.finditer(value)]
        keep, last = [], 0
        for p in sorted(places):
            start, end = spans[p]
            keep.append(value[last:start] if p - 1 not in places else "")
            last = end
        return "".join([*keep, value[last:]])

    rows = _rows(items, item_key, item_text)
    block = _block(rows)
    if block is None:
        found = written(_joined(documents, rows, key, text, share), "leaks")
        marked = found.groupBy("d", "row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")).withColumnRenamed("d", "d_key")
        mine = source.withColumn("row", F.xxhash64(key, text))
        source = mine.join(marked, (mine[key] == marked["d_key"]) & (mine["row"] == marked["row"]), "left").select(mine[key], mine[text], "places")
    shipped = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if shipped.value is None:
                places = [{q for p in starts or () for q in range(p, p + RUN)} for starts in batch.column(2).to_pylist()]
            else:
                places = [{p for _, where in found.values() for p in where} for found in shipped.value.scan(texts, share)]
            cleaned = [cut(t, p) if p else t for t, p in zip(texts, places)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.string()), pa.array([len(p) for p in places], pa.int32())], names=[key, "text", "removed_words"])

    return source.mapInArrow(run, f"`{key}` {kind}, text string, removed_words int")
