"""Problem 5: traces of scanning in body text.

Word forms are counted over the whole corpus and grouped by a skeleton in which glyphs that
scanners confuse look alike.  A form without digits that occurs ``LEAST_COUNT`` times is supported,
however large the corpus.  A form is a misreading of a supported form of its skeleton group when
single confusions explain it and the right form is ``DOMINANCE`` times as frequent; among several,
the form that was seen after the same word wins, then the more frequent one.  Numbers are misread
when letters stand where only digits can.

The supported forms travel with the scan while there are at most ``BROADCAST_FORMS`` of them.
Beyond that the most frequent ones do, and a text that meets others asks for them: they are joined
with the counts by skeleton in Spark and the text is worked through again with the answers, until it
meets nothing that it was not told.  So a text sees the same lexicon whatever travels.

Words are split when a hyphen-like sign stands at a line end, or before a blank where the joined
word is a known one.  Running lines are found through the letters of header and footer lines of
the same filing (digits and signs are masked), page numbers through the page index.  The repaired
lines are put back into paragraphs with SQL windows over (block, line).

Defined results: a null or empty content has no noise and no paragraphs; a null label is body; a
null document_id has no running lines, a null page_index no page number; repeated rows count
under each of their keys.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioloom.llm.site_lines import letters, plain_label
from folioloom.sources.durable import written

#: Least count of a supported form.
LEAST_COUNT = 5
#: Supported forms that travel with a scan (some 150 bytes each); others are asked for by an exchange.
BROADCAST_FORMS = 200_000
#: How many times more frequent than a misreading the right form is.
DOMINANCE = 20

# fixed values: labels whose blocks are no body
NOT_BODY = ("doc_title", "paragraph_title", "figure_title", "table", "header", "footer", "number")
# fixed values: conjunctions after a suspended hyphen
_SUSPENDED = frozenset("and or to nor through versus vs und oder bis sowie et ou à y o e u a".split())
# fixed values: what scanners confuse, right to wrong
CONFUSIONS = (
    ("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("h", "li"), ("e", "c"), ("t", "f"), ("h", "b"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("i", "l"), ("s", "5"), ("s", "8"), ("b", "8"), ("g", "9"), ("q", "9"), ("b", "6"), ("z", "2"),
)
# fixed values: letters read for digits
_AS_DIGIT = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "s": "5"})

# every glyph as the strokes it can be confused with
_STROKES = str.maketrans({
    "m": "rn", "d": "cl", "w": "vv", "u": "ll", "h": "ll", "b": "ll", "i": "l", "1": "l", "|": "l", "e": "c", "t": "f",
    "0": "o", "5": "s", "8": "s", "9": "g", "q": "g", "6": "ll", "z": "2",
})

_DOTTED = re.compile(r"\.[A-Za-z]{2}").search
_MARKUP = re.compile(
    r"<[/!A-Za-z][^<>]*>|&#?\w+;|https?://\S+|```.*?```|`[^`\n]*`|\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]|\]\([^()\s]*\)"
    # wiki tables, and rows of pipe tables: signs at both ends, or one that stands free or doubled and another one
    r"|^[^\S\n]*\{\|.*?^[^\S\n]*\|\}|^[^\S\n]*\|(?:[^\n]*\||\s[^\n]*\|[^\n]*|[^\n]*\|\|[^\n]*)[^\S\n]*$|^[^\n|]*\|[^\n]*\s\|[^\S\n]*$|[A-Za-z]:\\\S+|\\[A-Za-z]+\*?|\S*[_@]\S*|\b[A-Za-z][\w-]*(?:\.[\w-]+)*\.(?:[a-z]{2,8}|[A-Z]{2,8})\b",
    re.M | re.S,
)
_SIGN = "-‐¬­"
_AT_END = re.compile(rf"(\w+)[{_SIGN}][^\S\n]*\n[^\S\n]*(\w+)")
_INSIDE = re.compile(rf"(\w+)(?:-|[{_SIGN[1:]}])(?:[^\S\n]+|(?<=[{_SIGN[1:]}]))(\w+)")
_WORDS = re.compile(r"\w+").findall
_PLAIN_TOKENS = re.compile(r"[^\W_]+").findall
_TOKEN = re.compile(r"\|?[^\W_|]+(?:\|[^\W_|]+)*\|?")
_NUMBER = re.compile(r"(?<![\w|.,'’])(\$?)([\dOolISs|]+(?:,[\dOolISs|]{3})*(?:\.[\dOolISs|]+)?)(%?)(?![\w|'’])")
#: Tokens that can be part of a misread number.
_NUMBER_PART = re.compile(r"[\dOolISs|]*\d[\dOolISs|]*|[OlIS|]{1,3}")
_DIGITS = re.compile(r"(?:0|[1-9]\d*|[1-9]\d{0,2}(?:,\d{3})+|0(?:,\d{3})+)(?:\.\d+)?")
_PAGE = re.compile(r"(?:[-–—\[(|]\s?)?(?:(?:page|seite|página|pagina|pag\.|pg\.?|p\.|s\.)\s*)?(\d{1,6})(?:\s*(?:/|of|von|de|sur)\s*(\d{1,6}))?\.?(?:\s?[-–—\])|])?", re.I)

_PAGE_START = re.compile(r"\s*(?:[-–—\[(|]\s*)?(?:(?:page|seite|página|pagina|pag\.|pg\.?|p\.|s\.)\s*)?\d{1,6}(?!\d)", re.I)


def skeleton(form: str) -> str:
    return form.translate(_STROKES)


def explained(wrong: str, right: str) -> bool:
    """Whether single confusions turn ``right`` into ``wrong`` (both in lower case)."""
    reach = {(0, 0)}
    while reach:
        step = set()
        for i, j in reach:
            if i == len(right) and j == len(wrong):
                return True
            if i < len(right) and j < len(wrong) and right[i] == wrong[j]:
                step.add((i + 1, j + 1))
            for good, bad in CONFUSIONS:
                if right.startswith(good, i) and wrong.startswith(bad, j):
                    step.add((i + len(good), j + len(bad)))
                elif len(bad) > 1 and right.startswith(bad, i) and wrong.startswith(good, j):
                    step.add((i + len(bad), j + len(good)))
        reach = step
    return False


def _bare(text: str) -> str:
    """``text`` without markup, addresses, paths and code, whose signs are no misreadings."""
    signs = "<" in text or "&" in text or "`" in text or "_" in text or "{" in text or "\\" in text or "@" in text or "[[" in text or "](" in text
    return _MARKUP.sub(" ", text) if signs or _DOTTED(text) or "|" in text else text


def _split_at_end(text: str) -> bool:
    return "\n" in text and ("-" in text or "­" in text or "¬" in text or "‐" in text)


def _split_inside(text: str) -> bool:
    return "- " in text or "­" in text or "¬" in text or "‐" in text or "-\xa0" in text or "-\u2003" in text or "-\t" in text


class Lexicon:
    """Supported forms, their skeleton groups and the words seen before ambiguous forms."""

    def __init__(self, counts: dict[str, int], before: dict[tuple[str, str], int] | None = None):
        self.counts = counts
        self.before = before or {}
        self.groups: dict[str, list[str]] = {}
        for form in sorted(counts, key=lambda f: (-counts[f], f)):
            self.groups.setdefault(skeleton(form), []).append(form)
        self.memory: dict[str, tuple[str, ...]] = {}
        self.fine: set[str] = set()

    def rights(self, form: str) -> tuple[str, ...]:
        """The supported forms of which ``form`` is a misreading, most frequent first."""
        found = self.memory.get(form)
        if found is None:
            least = DOMINANCE * self.counts.get(form, 1)
            found = tuple(f for f in self.groups.get(skeleton(form), ()) if f != form and self.counts[f] >= least and explained(form, f)) if len(form) > 1 else ()
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[form] = found
        return found

    def lasting(self, word: str) -> bool:
        """Whether what is known of ``word`` holds for the next text."""
        return True

    def supported(self, form: str) -> bool:
        return form in self.counts

    def seen(self, before: str, form: str) -> int:
        """How often ``form`` was seen after the word ``before``."""
        return self.before.get((before, form), 0)

    def known(self, word: str) -> bool:
        form = word.lower()
        return self.supported(form) or bool(self.rights(form))

    def misread(self, text: str) -> bool:
        """Whether ``text`` holds a misread word or number; words found fine are remembered."""
        tokens = _TOKEN.findall(text) if "|" in text else _PLAIN_TOKENS(text)
        fresh = set(tokens).difference(self.fine)
        if len(self.fine) > 300_000:
            self.fine.clear()
        wrong = numbers = False
        for word in fresh:
            if _NUMBER_PART.fullmatch(word) and not word.isdigit():
                numbers = True  # told by its neighbours, so it is looked at every time
                continue
            right = self.right(word)
            if right and right != word:
                wrong = True
            elif self.lasting(word):
                self.fine.add(word)
        return wrong or (numbers and _misread_number(text))

    def right(self, word: str, before: str = "") -> str | None:
        """The right form of ``word``, in its case, or None where it is no misreading."""
        form = word.lower()
        if form.isdigit():
            return None
        found = self.rights(form)
        if not found:
            # a digit between small letters is no word sign; the likeliest letter takes its place
            if re.search(r"[a-zß-ÿ][0159|][a-zß-ÿ]", word):
                return word.replace("0", "o").replace("1", "l").replace("5", "s").replace("9", "g").replace("|", "l")
            return None
        best = max(found, key=lambda f: (self.seen(before.lower(), f), self.counts[f])) if len(found) > 1 else found[0]
        return best.upper() if word.isupper() and len(word) > 1 else best[0].upper() + best[1:] if word[0].isupper() else best


def _number(dollar: str, body: str, percent: str) -> str | None:
    """The right digits of a misread number, or None where it is no number or well read."""
    if body.isdigit() or not any(c in "OolISs|" for c in body):
        return None
    fixed = body.translate(_AS_DIGIT)
    if not _DIGITS.fullmatch(fixed):
        return None
    if not any(c.isdigit() for c in body) and not dollar and not percent and "." not in body and "," not in body:
        return None
    if any(c in "os" for c in body) and not sum(c.isdigit() for c in body) >= 2:
        return None
    return fixed


def _misread_number(text: str) -> bool:
    return any(_number(*m.groups()) for m in _NUMBER.finditer(text))


def split_words(text: str, lexicon: Lexicon) -> tuple[str, bool]:
    """``text`` with split words put together, and whether there were any."""
    found = False

    def at_end(m: re.Match) -> str:
        nonlocal found
        left, right = m.groups()
        joined = left + right
        if (left.isdigit() and right.isdigit()) or (right.lower() in _SUSPENDED and not lexicon.known(joined)):
            return m.group()
        found = True
        if lexicon.known(joined) or not (lexicon.known(left) and lexicon.known(right)):
            return joined
        return f"{left}-{right}"

    def inside(m: re.Match) -> str:
        nonlocal found
        left, right = m.groups()
        joined = left + right
        if joined.isdigit():
            return m.group()
        if lexicon.known(joined):
            found = True
            return joined
        if min(len(left), len(right)) > 1 and right.lower() not in _SUSPENDED and lexicon.known(left) and lexicon.known(right):
            found = True
            return f"{left}-{right}"
        return m.group()

    if _split_at_end(text):
        text = _AT_END.sub(at_end, text.replace("\r\n", "\n"))
    if _split_inside(text):
        text = _INSIDE.sub(inside, text)
    return text, found


def repair(text: str, lexicon: Lexicon) -> tuple[str, bool, bool]:
    """Repaired text, whether words were split, whether something was misread."""
    text, hyphen = split_words(text, lexicon)
    misread = False
    bare = _bare(text)
    changed: dict[str, str] = {}
    if _misread_number(bare):
        misread = True
    last = ""
    for m in _TOKEN.finditer(bare):
        word = m.group()
        if not lexicon.supported(word.lower()) or lexicon.rights(word.lower()):
            right = lexicon.right(word, last)
            if right and right != word:
                misread = True
                changed[word] = right
        last = word
    if misread:
        text = _NUMBER.sub(lambda m: m.group(1) + (_number(*m.groups()) or m.group(2)) + m.group(3), text)
        if changed:
            text = _TOKEN.sub(lambda m: changed.get(m.group(), m.group()), text)
    return text, hyphen, misread


def is_page_number(line: str, page_index: int | None) -> bool:
    m = _PAGE.fullmatch(" ".join(line.split())) if page_index is not None and _PAGE_START.match(line) else None
    return bool(m) and int(m.group(1)) == page_index + 1 and (m.group(2) is None or int(m.group(2)) >= page_index + 1)


def noise_of(text: str | None, page_index: int | None, lexicon: Lexicon) -> list[str]:
    if not text:
        return []
    paged = False
    if page_index is not None:
        lines = text.split("\n")
        pages = [is_page_number(line, page_index) for line in lines]
        paged = any(pages)
        if paged:
            text = "\n".join(x for x, p in zip(lines, pages) if not p)
    text, hyphen = split_words(text, lexicon)
    misread = lexicon.misread(_bare(text))
    return [k for k, found in (("hyphen", hyphen), ("misread", misread), ("pagenum", paged)) if found]


def body_of(blocks: DataFrame) -> DataFrame:
    label = plain_label("block_label")
    return blocks.where(F.length("block_content") > 0).where(label.isNull() | ~label.isin(*NOT_BODY))


def _counted_text(text: str) -> str:
    """``text`` as words are counted in it: fragments of split words are left out."""
    if _split_at_end(text):
        text = _AT_END.sub(" ", text.replace("\r\n", "\n"))
    if _split_inside(text):
        text = _INSIDE.sub(" ", text)
    return _bare(text).lower()


def _counts(body: DataFrame, count, schema: str) -> DataFrame:
    """Partial counts of every partition, added up by Spark; ``count`` fills a Counter from a text."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held) if len(names) == 1 else list(zip(*held))
            columns = [keys] if len(names) == 1 else keys
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(held.values()), pa.int64())], names=[*names, "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count(held, _counted_text(text))
            if len(held) > 300_000:
                yield out()
        if held:
            yield out()

    parts = body.select(F.col("block_content").cast("string")).mapInArrow(run, f"{schema}, n bigint")
    return parts.groupBy(*names).agg(F.sum("n").alias("n"))


class Overlay(Lexicon):
    """The most frequent forms and pairs, and what a text was told about its others.

    ``partial`` names the tables (forms, pairs) of which only the most frequent rows travel;
    ``missing`` gathers (form, word before or None) that the text met and was not told.
    """

    def __init__(self, common: Lexicon, partial: frozenset[str], facts: list[dict] | None = None):
        super().__init__({})
        self.common = common
        self.fine = common.fine
        self.partial = partial
        self.told: dict[str, tuple[bool, tuple[str, ...]]] = {}
        self.missing: set[tuple[str, str | None]] = set()
        for f in facts or ():
            if f["before"] is not None:
                self.before[(f["before"], f["form"])] = f["n"]
                continue
            rights = sorted((-r["n"], r["right"]) for r in f["rights"] or ())
            self.told[f["form"]] = f["n"] is not None, tuple(right for _, right in rights)
            self.counts.update((right, -n) for n, right in rights)
        self.counts = ChainMap(self.counts, common.counts)

    def _told(self, form: str) -> tuple[bool, tuple[str, ...]]:
        found = self.told.get(form)
        if found is None:
            self.missing.add((form, None))
        return found or (False, ())

    def lasting(self, word: str) -> bool:
        return "forms" not in self.partial or word.lower() in self.common.counts

    def supported(self, form: str) -> bool:
        return form in self.common.counts or ("forms" in self.partial and self._told(form)[0])

    def rights(self, form: str) -> tuple[str, ...]:
        # the right forms of a frequent form are more frequent still, so they are among them
        if "forms" not in self.partial or form in self.common.counts:
            return self.common.rights(form)
        return self._told(form)[1] if len(form) > 1 else ()

    def seen(self, before: str, form: str) -> int:
        if not before or "pairs" not in self.partial or (before, form) in self.common.before:
            return self.common.seen(before, form)
        if (before, form) not in self.before:
            self.missing.add((form, before))
        return self.before.get((before, form), 0)


def _stroked(form):
    """``skeleton`` as a column."""
    for glyph, strokes in (("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ll"), ("h", "ll"), ("b", "ll"), ("6", "ll")):
        form = F.replace(form, F.lit(glyph), F.lit(strokes))
    return F.translate(form, "i1|et0589qz", "lllcfossgg2")


def forms_asked(text: str) -> set[str]:
    """The forms that a ``text`` with split words is likely to meet, in lower case; what it meets besides is asked for later."""
    found: set[str] = set()
    parts: set[str] = set()
    texts = [text]
    if _split_at_end(text):
        plain = text.replace("\r\n", "\n")
        texts += [_AT_END.sub(r"\1\2", plain), _AT_END.sub(r"\1-\2", plain)]
        parts.update(part for m in _AT_END.finditer(plain) for part in (m.group(1), m.group(2), m.group(1) + m.group(2)))
    for each in texts:
        if _split_inside(each):
            parts.update(part for m in _INSIDE.finditer(each) for part in (m.group(1), m.group(2), m.group(1) + m.group(2)))
            found.update(_TOKEN.findall(_bare(_INSIDE.sub(r"\1\2", each))))
        found.update(_TOKEN.findall(_bare(each)))
        found.update(_PLAIN_TOKENS(_bare(each)))
    return {f.lower() for f in found if len(f) > 1 and not f.isdigit()} | {p.lower() for p in parts}


def form_counts(body: DataFrame) -> DataFrame:
    """(form, n): the supported forms of the corpus."""
    counted = _counts(body, lambda held, text: held.update(_WORDS(text)), "form string")
    return counted.where((F.col("n") >= LEAST_COUNT) & ~F.col("form").rlike(r"[\d_]"))


def _context(body: DataFrame, counts: DataFrame) -> DataFrame:
    """(before, form, n): the words before supported forms that share their skeleton with others."""
    shared = counts.groupBy(_stroked(F.col("form")).alias("strokes")).agg(F.count("*").alias("forms")).where("forms > 1").select("strokes")
    twins = written(counts.withColumn("strokes", _stroked(F.col("form"))).join(shared, "strokes", "left_semi").select("form"), "twins")
    few = frozenset(r.form for r in twins.collect()) if twins.count() <= BROADCAST_FORMS else None
    if few is not None and not few:
        return body.sparkSession.createDataFrame([], "before string, form string, n bigint")

    def count(held: Counter, text: str) -> None:
        words = _WORDS(text)
        held.update((a, b) for a, b in zip(words, words[1:]) if few is None or b in few)

    pairs = _counts(body, count, "before string, form string")
    return (pairs if few is not None else pairs.join(twins, "form", "left_semi")).where(F.col("n") >= LEAST_COUNT).select("before", "form", "n")


def scanned(rows: DataFrame, text: str, work, schema: str, body: DataFrame, context: bool = False) -> DataFrame:
    """``work(lexicon, values of a row)`` -> rows, over all ``rows`` with what is known of the forms in ``text``."""
    counts = written(form_counts(body), "forms")
    pairs = written(_context(body, counts), "context") if context else None
    names = [f.name for f in rows.schema.fields]
    outs = [part.split()[0] for part in schema.split(", ")]
    at = names.index(text)

    kinds = list(to_arrow_schema(StructType.fromDDL(schema)).types)

    def batch_of(results: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*results)) or [()] * len(outs)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=outs)

    sizes = {"forms": counts.count(), "pairs": pairs.count() if pairs is not None else 0}
    wide = max(sizes.values()) > BROADCAST_FORMS
    most = BROADCAST_FORMS // 2
    partial = frozenset(name for name, size in sizes.items() if wide and size > most)
    known = {r.form: r.n for r in (counts.orderBy(F.col("n").desc(), "form").limit(most) if "forms" in partial else counts).collect()}
    before = None
    if pairs is not None:
        before = {(r.before, r.form): r.n for r in (pairs.orderBy(F.col("n").desc(), "form", "before").limit(most) if "pairs" in partial else pairs).collect()}
    shipped = rows.sparkSession.sparkContext.broadcast(Lexicon(known, before))
    if not partial:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = shipped.value
            for batch in batches:
                yield batch_of([out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in work(lexicon, row)])

        return rows.mapInArrow(run, schema)

    # more than may travel: a text that meets what it was not told gives no rows but asks, and comes again with the answers
    def run_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results: list[tuple] = []
            asked: list[tuple] = []
            for *row, number, facts in zip(*(c.to_pylist() for c in batch.columns)):
                lexicon = Overlay(shipped.value, partial, facts)
                found = work(lexicon, tuple(row))
                if not lexicon.missing:
                    results += found
                    continue
                if "forms" in partial and facts is None and (_split_at_end(row[at]) or _split_inside(row[at])):
                    lexicon.missing.update((f, None) for f in forms_asked(row[at]) if f not in lexicon.common.counts)
                asked.extend((number, form, last) for form, last in lexicon.missing)
            done = batch_of(results)
            asks = [pa.array([a[k] for a in asked], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            names_ = [*outs, "row", "form", "before"]
            yield pa.RecordBatch.from_arrays([*done.columns, *(pa.nulls(len(results), a.type) for a in asks)], names=names_)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(asked), k) for k in kinds), *asks], names=names_)

    fixed = written(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    pending = fixed.withColumn("facts", F.lit(None).cast("array<struct<form: string, before: string, n: bigint, rights: array<struct<right: string, n: bigint>>>>"))
    done = asked = None
    while True:
        step = written(pending.mapInArrow(run_asked, f"{schema}, row bigint, form string, before string"), "round")
        results = step.where("row IS NULL").select(*outs)
        done = results if done is None else done.unionByName(results)
        asks = step.where("row IS NOT NULL").select("row", "form", "before")
        if asks.isEmpty():
            return done
        # what a text asked in earlier rounds is told again
        again = asks.select("row").distinct()
        asked = asks if asked is None else asked.unionByName(asks)
        given = _answered(asked.join(again, "row", "left_semi"), counts, pairs).groupBy("row").agg(F.collect_list("fact").alias("facts"))
        pending = fixed.join(given, "row").select(*names, "row", "facts")


def _answered(asked: DataFrame, counts: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(row, fact): count and right forms of every form asked for, the count of every pair."""
    alone = asked.where("before IS NULL").select("row", "form")
    forms = alone.select("form").distinct().join(counts, "form", "left").withColumn("strokes", _stroked(F.col("form")))
    good = counts.select(F.col("form").alias("right"), F.col("n").alias("right_n"), _stroked(F.col("form")).alias("strokes"))
    near = forms.join(good, "strokes").where((F.col("right") != F.col("form")) & (F.col("right_n") >= DOMINANCE * F.coalesce("n", F.lit(1))))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([explained(f, r) for f, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    rights = near.select("form", "right", "right_n").mapInArrow(explain, "form string, right string, right_n bigint")
    rights = rights.groupBy("form").agg(F.collect_list(F.struct("right", F.col("right_n").alias("n"))).alias("rights"))
    facts = forms.select("form", "n").join(rights, "form", "left")
    answers = alone.join(facts, "form").select("row", F.struct("form", F.lit(None).cast("string").alias("before"), "n", "rights").alias("fact"))
    if pairs is None:
        return answers
    after = asked.where("before IS NOT NULL").join(pairs, ["form", "before"], "left")
    return answers.unionByName(after.select("row", F.struct("form", "before", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast(facts.schema["rights"].dataType).alias("rights")).alias("fact")))


def _running(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """(block_key, line_no) of body lines that agree with a header or footer line of their filing."""
    label = plain_label("block_label")

    def cut(frame: DataFrame) -> DataFrame:
        lines = frame.where(F.col("document_id").isNotNull()).select("block_key", "document_id", F.posexplode(F.split("block_content", "\n")).alias("at", "line"))
        return lines.where(F.col("line").rlike(r"\p{L}")).select("block_key", F.xxhash64("document_id", letters(F.col("line"))).alias("line_hash"), F.col("at").cast("long").alias("line_no"))

    edges = cut(blocks.where(label.isin("header", "footer") & (F.length("block_content") > 0))).select("line_hash").distinct()
    return cut(body).select("block_key", "line_no", "line_hash").join(edges, "line_hash", "left_semi").select("block_key", "line_no")


def noise_found(blocks: DataFrame) -> DataFrame:
    """(block_key, noise): one row for each kind of scanning noise in each body block."""
    body = body_of(blocks)
    kind = blocks.schema["block_key"].dataType.simpleString()

    def work(lexicon: Lexicon, row: tuple) -> list[tuple]:
        return [(row[0], noise) for noise in noise_of(row[2], row[1], lexicon)]

    rows = body.select("block_key", F.col("page_index").cast("long").alias("page_index"), F.col("block_content").cast("string").alias("block_content"))
    own = scanned(rows, "block_content", work, f"block_key {kind}, noise string", body)
    running = _running(blocks, body).select("block_key").distinct().select("block_key", F.lit("running").alias("noise"))
    return own.unionByName(running)


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(block_key, paragraph_no, text): continuous paragraphs of every body block.

    Lines that are page furniture go; a line continues the paragraph unless the line before is
    blank, or closed a sentence, or the line opens a list item or heading.
    """
    body = body_of(blocks)
    kind = blocks.schema["block_key"].dataType.simpleString()
    furniture = _running(blocks, body).select("block_key", "line_no")
    lines = body.select("block_key", "page_index", F.posexplode(F.split(F.regexp_replace("block_content", "\r\n?", "\n"), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    lines = lines.join(furniture, ["block_key", "line_no"], "left_anti")
    single = F.trim(F.regexp_replace("line", r"[\s\p{Z}]+", " "))
    number = F.expr("try_cast(number AS bigint)")
    lines = lines.withColumn("number", F.regexp_extract(single, f"^(?i:{_PAGE.pattern})$", 1))
    lines = lines.where(F.coalesce(number != F.col("page_index") + 1, F.lit(True))).drop("number")
    order = Window.partitionBy("block_key").orderBy("line_no")
    last = F.trim(F.lag("line").over(order))
    opens = last.isNull() | (F.trim("line") == "") | (last == "") | F.col("line").rlike(r"^\s*(?:[-*•·☐☒]|\d{1,3}[.)]|#{1,6}|=+)\s") | (last.rlike(r"[.!?:][\"'”’»)\]]*$") & F.col("line").rlike(r"^\s*[\p{Lu}\d\"“«(]"))
    numbered_lines = lines.withColumn("opens", opens.cast("int")).withColumn("paragraph_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered_lines.where(F.trim("line") != "").groupBy("block_key", "paragraph_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))

    def work(lexicon: Lexicon, row: tuple) -> list[tuple]:
        return [(row[0], row[1], " ".join(repair(row[2], lexicon)[0].split()))]

    rows = joined.select("block_key", F.col("paragraph_no").cast("int").alias("paragraph_no"), "text")
    return scanned(rows, "text", work, f"block_key {kind}, paragraph_no int, text string", body, context=True)
