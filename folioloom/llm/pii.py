"""Problem 8: personal information inside free text.

One pass over the texts takes every span that could be a name, a number of a person, an e-mail or
a street address, with a lexical pattern (the two words before it and the one after) and the
instances it consists of: the given name and the surname of a name, the digit shape of a number.
Spans beside unmistakable words (titles, "SSN", "Tel.") are seeds.  Spark then scores the graph of
patterns and instances iteratively: a pattern is as good as the instances in it, an instance as
good as the patterns around it.  After ``ROUNDS`` rounds trusted patterns have found instances
without a seed, and trusted instances their occurrences in any pattern.  E-mails and addresses are
told by their form; they need no neighbours.

Defined results: null and empty texts have nothing; each distinct value of a text is returned once
per type; repeated rows give the same result once per row's key; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.sources.durable import written

ROUNDS = 3
CUTOFF = 0.5
#: Share of an instance's occurrences that must be seeded to fix its score.
LEAST_SEEDED = 0.005
#: Scores that may travel to every task (some 50 bytes each); more are joined by an exchange.
BROADCAST_ROWS = 200_000

# fixed values: words before a person's name that are no part of it
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Herrn Frau M Mme Mlle Monsieur Madame D Dña Doña Don Sr Sra Señor Señora".split()
# fixed values: words that make a sequence of capitals an organisation or a street
ORGANISATION = frozenset(
    "foundation partners llp llc inc ltd plc corp corporation company group holdings holding trust bank capital gmbh ag se kg sa sas sarl sl "
    "bv nv stiftung fondation fundación institute university association society council ministry committee fund funds street road avenue".split()
)
# fixed values: what is written before numbers of persons, telephone numbers and numbers of neither kind
ID_CUES = re.compile(r"\b(?:ssn|social security|passport|identity|identity number|national insurance|tax id|sécurité sociale|numéro fiscal|passeport|documento de identidad|dni|nif|nie|pasaporte|steuer-?id\b.*|ausweis|reisepass|sozialversicherung\w*)\W*(?:(?:no|nr|number|n)\W*|(?:de|des|von|of|du)\b.*)?$", re.I)
PHONE_CUES = re.compile(r"\b(?:tel|tél|telephone|phone|mobile|fax|call|contact|reached at|téléphone|standard|teléfono(?: de \w+)?|móvil|telefon|telefonisch erreichbar|rufnummer)\W*$", re.I)
OTHER_CUES = re.compile(r"\b(?:isin|wkn|cusip|docket|case|file no|reference|ref|invoice|article|section|between|on|aktenzeichen|expediente|dossier|line|note)\W*$", re.I)
# fixed values: words in the names of streets
STREETS_EN = "Street|Road|Lane|Avenue|Drive|Row|Square|Terrace|Close|Court|Crescent|Boulevard|Highway|Parkway|Way|Place"
STREETS_DE = "straße|strasse|gasse|allee|weg|platz|ufer|ring|damm|steig|markt"
STREETS_FR = "rue|quai|impasse|avenue|boulevard|place|allée|chemin|cours|passage|square|route"
STREETS_ES = "calle|plaza|paseo|avenida|ronda|camino|carrera|travesía|glorieta"

_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’']+|[A-ZÀ-ÖØ-Þ]{2,}(?![a-z]))"
_SURNAME = rf"{_CAP}(?:-{_CAP})*"
_GAP = r"[ \xa0\n]"
#: Given name, initials, surname; also surname, comma, given name; also initials and surname.
_NAME = re.compile(rf"(?=(?<![\w@.’'-])(?:(?P<g>{_CAP}(?:-{_CAP})?){_GAP}(?P<m>(?:[A-Z]\.{_GAP}?)*)(?P<s>{_SURNAME})|(?P<s2>{_SURNAME}),[ \xa0](?P<g2>{_CAP})|(?P<i>[A-Z]\.(?:{_GAP}?[A-Z]\.)*){_GAP}(?P<s3>{_SURNAME}))(?![\w@]))")
_PAIR = re.compile(rf"(?=(?<![\w@.’'-])(?P<s2>{_SURNAME}),[ \xa0](?P<g2>{_CAP})(?![\w@]))")
_NUMBER = re.compile(
    r"(?<![\w.,$€£/+-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"
    r"|[A-Z]{1,2}\d{6,9}(?!\w)"
    r"|(?:\(\+?\d{1,4}\) ?|\+)?\d+(?:(?: ?/ ?|[-.‑ \xa0]|\) ?| ?\(0\) ?)\d+)*(?:-?[A-Z](?!\w))?)(?![\w])"
)
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?@ ?| ?[\[({] ?(?:at|ät|arroba|arobase) ?[\])}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|punkt|punto|point) ?[\])}] ?)[A-Za-z][A-Za-z0-9-]*)+", re.I)
_HAS_MAIL = re.compile(r"\w ?@ ?\w|[\[({] ?(?:at|ät|arroba|arobase) ?[\])}]", re.I)
_TOWN = r"[A-ZÀ-Ý][\wà-ÿ’']+(?:-[A-Z][\wà-ÿ]+)*"
_ADDRESS_EN = re.compile(
    rf"(?:Flat{_GAP}\d+\w?,{_GAP})?(?<![\w.,$-])\d{{1,5}}[A-Za-z]?{_GAP}(?:[A-Z][\w’']+{_GAP}){{1,3}}(?:{STREETS_EN})(?:,{_GAP}(?:Suite|Apt\.?|Unit|Floor){_GAP}\w+)?,{_GAP}{_TOWN}(?:{_GAP}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_GAP}\d[A-Z]{{2}}|(?:,{_GAP}[A-Z]{{2}})?{_GAP}\d{{5}})?(?![\w])"
)
_ADDRESS_DE = re.compile(
    rf"(?:\b[A-ZÄÖÜ][\wäöüß-]*(?:{STREETS_DE})|\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Unter den){_GAP}(?:[A-ZÄÖÜ][\wäöüß]+{_GAP}?){{1,2}}(?=[ \xa0\n]\d)){_GAP}\d{{1,4}}[a-z]?(?:,{_GAP}(?:\d{{5}}{_GAP})?|{_GAP}in{_GAP}){_TOWN}"
)
_ADDRESS_FR = re.compile(
    rf"(?<![\w.,$-])\d{{1,4}}(?:{_GAP}?(?:bis|ter|quater))?,?{_GAP}(?:{STREETS_FR}){_GAP}(?:(?:de{_GAP}la|de{_GAP}l[’']|du|des|de|d[’']){_GAP}?)?(?:[A-ZÀ-Ý][\wà-ÿ’'-]+{_GAP}?){{1,3}}(?:,{_GAP}(?:\d{{5}}{_GAP})?|(?<={_GAP})à{_GAP}|{_GAP}à{_GAP}){_TOWN}"
)
_ADDRESS_ES = re.compile(
    rf"\b(?:{STREETS_ES}){_GAP}(?:(?:de{_GAP}(?:los|las|la)|del|de){_GAP})?(?:[A-ZÀ-Ý][\wà-ÿ]+{_GAP}?){{1,3}}(?:,?{_GAP}(?:n\.?º{_GAP})?\d{{1,4}}|(?<={_GAP})\d{{1,4}}),{_GAP}(?:\d{{5}}{_GAP})?{_TOWN}"
)
_EN_HINTS = tuple(f" {w}," for w in STREETS_EN.split("|")) + tuple(f"\n{w}," for w in STREETS_EN.split("|"))
_FR_HINTS = tuple(w + gap for w in STREETS_FR.split("|") for gap in " \xa0\n")
_ES_HINTS = tuple(w + gap for w in STREETS_ES.split("|") for gap in " \xa0\n")
_DE_HINT = re.compile(r"\d[a-z]?(?:,[ \xa0\n](?:\d{5}[ \xa0\n])?|[ \xa0\n]in[ \xa0\n])[A-ZÀ-Ý]")


def _addresses(text: str) -> Iterator[re.Match]:
    """Street addresses; cheap signs decide which language's form is looked for."""
    if any(w in text for w in _EN_HINTS):
        yield from _ADDRESS_EN.finditer(text)
    if _DE_HINT.search(text):
        yield from _ADDRESS_DE.finditer(text)
    if any(w in text for w in _FR_HINTS):
        yield from _ADDRESS_FR.finditer(text)
    if any(w in text for w in _ES_HINTS):
        yield from _ADDRESS_ES.finditer(text)


_TITLE_BEFORE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \xa0\n]$")
_CONTEXT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
#: Words that start a pair of capitals which is no name; saves rows, the scores would drop them.
_OPENERS = frozenset(
    "the a an in on at by for of to from with and or when once after before despite within excluding compared subject over as auditors holders directors management "
    "der die das den dem des ein eine im am vom zum zur bei für vor nach zu auf mit von und le la les un une des du de en au aux pour dans avant après el los las una por para según antes".split()
)


def _pattern(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before a span, and the pattern around it."""
    left = text[max(0, start - 72) : start]
    words = _CONTEXT.findall(left[-40:].replace("\r", ""))[-2:]
    right = _CONTEXT.match(text[end : end + 24].lstrip(" \xa0\r")) if end < len(text) else None
    masked = ["#" if w.isdigit() else w.lower() for w in words]
    return left, f"{' '.join(masked)} _ {'#' if right and right.group().isdigit() else right.group().lower() if right else '$'}"


def shape_of(number: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", number.replace("\xa0", " ")))


def spans_of(text: str) -> list[tuple]:
    """(kind, start, end, value, first instance, second instance, pattern, seed type) of all possible spans."""
    out = []
    if _HAS_MAIL.search(text):
        for m in _EMAIL.finditer(text):
            out.append(("email", m.start(), m.end(), m.group(), None, None, None, "email"))
    for m in _addresses(text):
        out.append(("address", m.start(), m.end(), m.group(), None, None, None, "address"))
    for m in _NUMBER.finditer(text):
        value = m.group()
        if len(value) < 7 or not 6 <= sum(c.isdigit() for c in value) <= 16:
            continue
        left, pattern = _pattern(text, m.start(), m.end())
        seed = "id_number" if ID_CUES.search(left) else "phone" if PHONE_CUES.search(left) or value.startswith(("+", "(+")) else "other" if OTHER_CUES.search(left) else None
        out.append(("number", m.start(), m.end(), value, shape_of(value), None, pattern, seed))
    for m in _NAME.finditer(text):
        if m.group("i"):
            given, surname, start, end = None, m.group("s3"), m.start("i"), m.end("s3")
            if re.match(r"[MD]\.[ \xa0\n]?[A-Z]\.", m.group("i")):
                continue  # a title before the initial, which is a span of its own
        elif m.group("g"):
            given, surname, start, end = m.group("g"), m.group("s"), m.start("g"), m.end("s")
        else:
            given, surname, start, end = m.group("g2"), m.group("s2"), m.start("s2"), m.end("g2")
        tries = [(given, surname, start, end)]
        if m.group("g"):  # the same word may also be a surname before a comma
            other = _PAIR.match(text, m.start())
            if other:
                tries.append((other.group("g2"), other.group("s2"), other.start("s2"), other.end("g2")))
        for given, surname, start, end in tries:
            if (given or "").lower() in _OPENERS or surname.lower() in _OPENERS or surname.lower() in ORGANISATION or (given or "").rstrip("'’") in TITLES:
                continue
            left, pattern = _pattern(text, start, end)
            right = pattern.rsplit(" ", 1)[1]
            if right in ORGANISATION:
                continue
            titled = bool(_TITLE_BEFORE.search(left))
            # words on two lines are a name only where both are known from elsewhere
            # a word before an initial is a given name only where it is known as one
            kind = "wrapped" if "\n" in text[start:end] else "middle" if m.group("m") and start == m.start("g") and end == m.end("s") else "name"
            out.append((kind, start, end, text[start:end], given.lower() if given else None, surname.lower(), pattern, "name" if titled and given else None))
    return out


def _spans(documents: DataFrame, key: str, text: str) -> DataFrame:
    source = documents.where(F.length(text) > 0).select(F.col(key), F.col(text).cast("string").alias(text)).withColumn("row", F.xxhash64(key, text))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = spans_of(value)
                rows += found
                at += [i] * len(found)
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(2).take(where), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, "row", "kind", "start", "end", "value", "one", "two", "pattern", "seed"])

    return source.mapInArrow(run, f"`{key}` {kind}, row bigint, kind string, start int, end int, value string, one string, two string, pattern string, seed string")


def _edges(spans: DataFrame) -> DataFrame:
    """(type, instance, pattern, n, seeds): the graph, one edge per type that the instance may have."""
    names = spans.where("kind = 'name'")
    parts = names.where("one IS NOT NULL").select(F.concat(F.lit("given:"), "one").alias("instance"), "pattern", "seed").unionByName(names.select(F.concat(F.lit("surname:"), "two").alias("instance"), "pattern", "seed"))
    name_edges = parts.groupBy("instance", "pattern").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")).select(F.lit("name").alias("type"), "instance", "pattern", "n", "seeds", F.lit(0).cast("long").alias("against"))
    numbers = spans.where("kind = 'number'").groupBy(F.concat(F.lit("shape:"), "one").alias("instance"), "pattern").agg(
        F.count("*").alias("n"), F.count_if(F.col("seed") == "phone").alias("phone"), F.count_if(F.col("seed") == "id_number").alias("id_number"), F.count_if(F.col("seed") == "other").alias("other"))
    return name_edges.unionByName(numbers.select(F.lit("phone").alias("type"), "instance", "pattern", "n", F.col("phone").alias("seeds"), (F.col("id_number") + F.col("other")).alias("against"))).unionByName(
        numbers.select(F.lit("id_number").alias("type"), "instance", "pattern", "n", F.col("id_number").alias("seeds"), (F.col("phone") + F.col("other")).alias("against")))


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of instances and of patterns, between 0 and 1, after ``rounds`` rounds."""
    edges = edges.withColumn("w", F.log2(F.col("n") + 1))
    # a seeded instance starts with the share of its seeds among what speaks for or against it;
    # a few seeds among very many occurrences are chance
    start = edges.groupBy("type", "instance").agg(F.sum("seeds").alias("s"), F.sum("against").alias("a"), F.sum("n").alias("all")).select("type", "instance", F.when((F.col("s") >= 2) & (F.col("s") >= LEAST_SEEDED * F.col("all")), F.col("s") / (F.col("s") + F.col("a"))).when(F.col("a") > 0, F.lit(0.0)).alias("fixed"))
    edges = written(edges.join(start, ["type", "instance"]).select("type", "instance", "pattern", "w", "fixed"), "edges")
    marks = edges.select("type", "instance", F.coalesce("fixed", F.lit(0.0)).alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        patterns = edges.join(marks, ["type", "instance"]).groupBy("type", "pattern").agg((F.sum(F.col("w") * F.col("score")) / (F.sum("w") + 1)).alias("pattern_score"))
        around = edges.join(patterns, ["type", "pattern"]).groupBy("type", "instance").agg((F.sum(F.col("w") * F.col("pattern_score")) / (F.sum("w") + 0.5)).alias("around"), F.max("fixed").alias("fixed"))
        marks = written(around.select("type", "instance", F.coalesce("fixed", "around").alias("score")), "marks")
    patterns = edges.join(marks, ["type", "instance"]).groupBy("type", "pattern").agg((F.sum(F.col("w") * F.col("score")) / (F.sum("w") + 1)).alias("pattern_score"))
    return marks, written(patterns, "patterns")


def _small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def accepted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, spans): for each text its spans (start, end, type, value), which do not overlap."""
    spans = written(_spans(documents, key, text), "spans")
    marks, patterns = score(_edges(spans))
    good = marks.where(F.col("score") >= CUTOFF)
    given = _small(written(good.where("type = 'name' AND instance LIKE 'given:%'").select(F.substring("instance", 7, 1 << 30).alias("one"), F.lit(True).alias("given_ok")), "given"))
    surname = _small(written(good.where("type = 'name' AND instance LIKE 'surname:%'").select(F.substring("instance", 9, 1 << 30).alias("two"), F.lit(True).alias("surname_ok")), "surname"))
    told = _small(written(patterns.where((F.col("type") == "name") & (F.col("pattern_score") >= CUTOFF)).select("pattern", F.lit(True).alias("pattern_ok")), "told"))
    shapes = _small(written(good.where("instance LIKE 'shape:%'").groupBy(F.substring("instance", 7, 1 << 30).alias("one")).agg(F.max_by("type", "score").alias("type")), "shapes"))
    names = spans.where("kind IN ('name', 'middle', 'wrapped')").join(given, "one", "left").join(surname, "two", "left").join(told, "pattern", "left")
    is_given = F.coalesce("given_ok", F.lit(False))
    trusted = F.coalesce("pattern_ok", F.lit(False))
    known = F.coalesce("surname_ok", F.lit(False))
    single = F.col("kind") == "name"
    names = names.where((is_given & (single | known | (F.col("kind") == "middle"))) | (single & F.col("one").isNull() & (trusted | known)) | (single & trusted & known)).select(key, "row", "start", "end", F.lit("name").alias("type"), "value", (F.when(is_given, 0).otherwise(1)).alias("rank"))
    numbers = spans.where("kind = 'number'").join(shapes, "one").select(key, "row", "start", "end", "type", "value", F.lit(0).alias("rank"))
    forms = spans.where("kind IN ('email', 'address')").select(key, "row", "start", "end", F.col("kind").alias("type"), "value", F.lit(0).alias("rank"))
    both = names.unionByName(numbers).unionByName(forms).groupBy(key, "row").agg(F.collect_set(F.struct("start", "end", "rank", "type", "value")).alias("found"))
    kind = both.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                # e-mails and addresses first, then full names, then the rest; earlier ones win
                kept: list[dict] = []
                order = {"email": 0, "address": 1}
                taken: set[int] = set()
                for s in sorted(found, key=lambda s: (order.get(s["type"], 2), s["rank"], s["start"], s["end"])):
                    if taken.isdisjoint(range(s["start"], s["end"])):
                        taken.update(range(s["start"], s["end"]))
                        kept.append({k: s[k] for k in ("start", "end", "type", "value")})
                out.append(sorted(kept, key=lambda s: s["start"]))
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, spans_type)], names=[key, "row", "spans"])

    return both.select(key, "row", "found").mapInArrow(run, f"`{key}` {kind}, row bigint, spans array<struct<start int, end int, type string, value string>>")


def personal(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, pii_value): each distinct value of each text."""
    each = accepted(documents, key, text).select(key, F.explode("spans").alias("s"))
    return each.select(key, F.col("s.type").alias("pii_type"), F.col("s.value").alias("pii_value")).distinct()


def masked(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, spans): every text with typed placeholders like ``[NAME]``; a null text stays null."""
    rows = documents.select(F.col(key), F.col(text).cast("string").alias(text)).withColumn("row", F.xxhash64(key, text))
    # rows agree by key and hash; a null key is matched as well
    held = accepted(documents, key, text).select(F.col(key).alias("span_key"), F.col("row").alias("span_row"), "spans")
    joined = rows.join(held, F.col(key).eqNullSafe(F.col("span_key")) & (F.col("row") == F.col("span_row")), "left").select(key, text, "spans")
    kind = joined.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for value, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, last = [], 0
                for s in spans or ():
                    parts += [value[last : s["start"]], f"[{s['type'].upper()}]"]
                    last = s["end"]
                out.append("".join([*parts, value[last:]]) if value is not None else None)
                counts.append(len(spans or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[key, "text", "spans"])

    return joined.mapInArrow(run, f"`{key}` {kind}, text string, spans int")
