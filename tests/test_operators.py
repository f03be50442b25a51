"""Core operators on small cases: goldens, edge cases, brute force."""

import json
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.config import Config, Retrieval
from folioloom.functions import arrays, geometry, text
from folioloom.operators import assets, blocks, catalog, chunks, enrichment, evidence, merging, ordered, records, sentences, vectors
from folioloom.plans import pipelines, registry
from folioloom.providers import HashedWords
from folioloom.sources import files, json_io, ocr_json

BLOCKS = "block_key bigint, document_id string, page_index bigint, block_id bigint, block_order bigint, block_label string, block_content string, block_bbox array<bigint>"
CHUNKS = "chunk_key bigint, document_id string, chunk_id string, ids array<bigint>, text string, source_block_ids array<int>, page_span array<int>"


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()]).alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, text.collapse, a=" a\u00a0\u2003b\t\n c ") == "a b c"
    assert one(spark, text.label, a=" \u00a0Text ") == "text"
    assert one(spark, text.label, a=None) == ""
    assert one(spark, text.unescape, a="&amp;nbsp; &copy; &#8217;&#128512; &lt;td&gt; R&D") == "&nbsp; © ’😀 <td> R&D"
    assert one(spark, text.trimmed_lines, a="\r\n a \r b\u00a0\n\n") == "a\nb"
    assert one(spark, lambda a: text.compact(a, 8), a="abcdefgh") == "abcdefgh"
    assert one(spark, lambda a: text.compact(a, 8), a="abcd fghij") == "abcd..."
    assert one(spark, text.slug, a=" A/B: 10% — x ") == "A_B_10_x"
    assert one(spark, text.slug, a="///") == "defaulttitle"
    assert one(spark, text.safe_name, a="a.b c") == "a_b_c"
    assert one(spark, text.query_key, a="evidence preview") == "004e2627"
    assert one(spark, text.query_key, a="  ") == "noquery"
    assert one(spark, text.paragraphs, a="# A\nbody\n\n\n B ") == ["# A body", "B"]
    assert one(spark, text.sentences, a="It rose. It fell 3.5%! Why?") == ["It rose.", "It fell 3.5%!", "Why?"]
    assert one(spark, text.word_count, a=None) == 0


def test_all_entities(spark):
    assert one(spark, text.unescape, a="caf&eacute; &uuml;&#x2019; &copy 5 &amp;amp; R&D &#8217 &#0000065;") == "café ü’ © 5 &amp; R&D ’ A"
    rows = spark.createDataFrame([(1, None), (2, "a < b"), (3, "&Eacute;")], "k int, a string")
    assert {r.k: r.v for r in rows.select("k", text.unescape(F.col("a")).alias("v")).collect()} == {1: None, 2: "a < b", 3: "É"}


@pytest.mark.parametrize("value, reasons", [
    ("☒ Yes", ["checkbox"]), ("yes ☒", ["checkbox", "yes_no_answer"]), ("$1,234.5", ["numeric_like"]), ("N/A.", ["short_status"]), ("- none;", ["short_status"]),
    ("no", ["yes_no_answer"]), ("Revenue rose", []), ("", []), ("1 2 3 4 5 6 7 8 9", []), ("[ ]", ["checkbox"]),
])
def test_short_answers(spark, value, reasons):
    assert one(spark, text.short_answer_reasons, a=value) == reasons


def test_boxes(spark):
    rows = spark.createDataFrame([([5, 6, 1, 2],), ([1, 2, 3],), (None,), ([1, None, 3, 4],)], "b array<bigint>").select(geometry.box(F.col("b")).alias("b")).collect()
    assert [tuple(r.b) if r.b else None for r in rows] == [(1.0, 2.0, 5.0, 6.0), None, None, None]
    # asset and title of a shipped crop, padding 8
    a, t = F.array(*map(F.lit, (633, 194, 1130, 444))), F.array(*map(F.lit, (629, 103, 972, 144)))
    crop = geometry.clip(geometry.expand(geometry.union(geometry.box(a), geometry.box(t)), 8.0), F.lit(1224), F.lit(1584))
    assert tuple(spark.range(1).select(crop.alias("c")).first().c) == (621.0, 95.0, 1138.0, 452.0)


@pytest.mark.parametrize("size, expected", [((1000, 1000), (1000, 1000)), ((4000, 3000), (1156, 867)), ((100, 200), (316, 633)), ((1, 4_000_000), (1, 1003520))])
def test_pixel_budget(spark, size, expected):
    row = spark.range(1).select(geometry.fitted(F.lit(size[0]), F.lit(size[1]), 1_003_520, 200_704).alias("f")).first().f
    assert row.width * row.height <= 1_003_520
    if size != (1, 4_000_000):
        assert (row.width, row.height) == expected


@pytest.mark.parametrize("n, count", [(0, 0), (1, 1), (6, 1), (7, 2), (13, 3)])
def test_windows(spark, n, count):
    got = spark.range(1).select(arrays.windows(F.array(*[F.lit(i).cast("bigint") for i in range(n)]).cast("array<bigint>"), F.lit(6), F.lit(4)).alias("w")).first().w
    assert len(got) == count
    s = spark.createDataFrame([("d", i) for i in range(n)], "document_id string, sentence_id bigint")
    assert [r.sentence_ids for r in sentences.windows(s).orderBy("block_id").collect()] == got


def test_config_windows(spark, tables):
    rows = [("d", i * 3) for i in range(29)] + [("e", i) for i in range(2)]
    s = spark.createDataFrame(rows, "document_id string, sentence_id bigint")
    configs = [(1, 6, 2, None), (2, 6, 1, 5), (3, 3, 1, 4), (4, 40, 0, 7)]
    c = spark.createDataFrame(configs, "config_id int, window_size int, overlap int, step_size int")
    want = set()
    for n, width, over, step in configs:
        step = step or width - over
        for doc in "de":
            ids = [i for d, i in rows if d == doc]
            want |= {(n, doc, k, tuple(ids[k * step : k * step + width])) for k in range(max(0, -(-(len(ids) - width) // step)) + 1)}
    got = [(r.config_id, r.document_id, r.block_id, tuple(r.sentence_ids)) for r in sentences.config_windows(s, c).collect()]
    assert len(got) == len(want) and set(got) == want
    held = registry.queries()["config_sentence_windows"](spark, tables)
    rest = held.where("config_id = 4").drop("config_id").exceptAll(registry.queries()["sliding_windows"](spark, tables).select("document_id", "block_id", "sentence_ids"))
    assert rest.count() == 0 and held.where("size(sentence_ids) > 0").select("document_id").distinct().count() == sentences.current(spark.read.parquet(f"{tables}/sentences.parquet")).select("document_id").distinct().count()


def test_titles_of_two_pages(spark):
    rows = [
        (1, "d", 0, 1, None, "doc_title", "Morgan", [400, 300, 800, 344]), (2, "d", 0, 2, None, "table", "t", [81, 393, 1136, 485]), (3, "d", 0, 3, None, "table", "t", [80, 530, 1143, 1099]),
        (4, "d", 1, 1, None, "figure_title", "Report", [400, 100, 800, 158]), (5, "d", 1, 2, None, "Table ", "t", [89, 169, 1139, 1454]), (6, "d", 1, 3, None, "table", "t", None),
    ]
    b = blocks.fields(spark.createDataFrame(rows, BLOCKS))
    titled = {r.block_key: (r.asset_index, r.title, r.distance) for r in assets.nearest_title(assets.assets_of(b), b, 160.0).collect()}
    assert titled == {2: (1, "Morgan", 49.0), 3: (2, None, None), 5: (3, "Report", 11.0)}


def test_blocks_with_nulls(spark):
    rows = [(1, None, None, None, None, None, None, None), (2, "d", 0, 1, 2, "DOC_TITLE", "A\n b", [1, 2, 3, 4]), (3, "d", 0, 2, 1, "text", "x &amp; y", [1, 2, 3, 4]), (4, "d", 0, 3, None, "my_image", "gone", None)]
    b = blocks.fields(spark.createDataFrame(rows, BLOCKS))
    assert [r.markdown for r in blocks.markdown(b).collect()] == ["x & y\n\n# A b\n"]
    counts = {r.label: (r.kept, r.dropped) for r in blocks.label_counts(b).collect()}
    assert counts == {"<missing>": (0, 1), "doc_title": (1, 0), "text": (1, 0), "my_image": (0, 1)}


def test_empty_tables(spark):
    b = blocks.fields(spark.createDataFrame([], BLOCKS))
    assert blocks.markdown(b).count() == 0 and assets.nearest_title(assets.assets_of(b), b).count() == 0
    c = spark.createDataFrame([], CHUNKS)
    assert chunks.contained(c).count() == 0 and chunks.neighbours(c).count() == 0 and records.text_records(c).count() == 0
    s = spark.createDataFrame([], "document_id string, sentence_id bigint, text string, page int")
    assert merging.merge(c, s).count() == 0 and sentences.windows(s).count() == 0


def chunk_rows(seed, n=40):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start, size = rng.randrange(30), rng.choice([1, 2, 3, 3, 5])
        out.append((k, f"d{rng.randrange(2)}", f"chunk_{k:06d}", list(range(start, start + size)), f"t{k}", [k], [start // 5, (start + size) // 5]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_containment_by_brute_force(spark, seed):
    rows = chunk_rows(seed)
    frame = spark.createDataFrame(rows, CHUNKS)
    want, pairs = {}, set()
    for a in rows:
        over = [b for b in rows if b[1] == a[1] and b[0] != a[0] and set(a[3]) <= set(b[3]) and (len(b[3]) > len(a[3]) or b[0] < a[0])]
        if over:
            want[a[0]] = min(over, key=lambda b: (-len(b[3]), b[0]))[0]
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and set(a[3]) & set(b[3]) and len(set(a[3]) & set(b[3])) / min(len(a[3]), len(b[3])) >= 0.5:
                pairs.add((a[0], b[0]))
    assert {r.chunk_key: r.target_key for r in chunks.contained(frame).collect()} == want
    assert {(r.first_key, r.second_key) for r in chunks.overlapping(frame, 0.5).collect()} == pairs
    assert {r.chunk_key for r in chunks.cleaned(frame).collect()} == {r[0] for r in rows} - set(want)
    assert not set(want.values()) & set(want)


def test_numbers_inside_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, *range(50)]), k) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, v int, k int")
    order = [F.col("v"), F.col("k")]
    got = {r.k: r.n for r in ordered.numbered(frame, ["g"], F.col("v"), order, "n", width=7).collect()}
    nxt = {r.k: r.next.k if r.next else None for r in ordered.with_next(frame, ["g"], F.col("v"), order, ["k"], width=7).collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
        assert [nxt[r[2]] for r in mine] == [r[2] for r in mine[1:]] + [None]


def test_merge_steps(spark):
    rows = [(1, "d", "chunk_000001", [0, 1], "", [0], [1, 1]), (2, "d", "chunk_000002", [2], "", [0], [1, 1]), (3, "d", "chunk_000003", [0], "", [0], [1, 1]), (4, "d", "chunk_000004", [9], "", [1], [9, 9])]
    s = spark.createDataFrame([("d", 0, "alpha beta", 1), ("d", 1, "gamma", 1), ("d", 2, "Yes", 1), ("d", 9, "omega", 9)], "document_id string, sentence_id bigint, text string, page int")
    got = merging.merge(spark.createDataFrame(rows, CHUNKS), s).orderBy("kind", "seq").collect()
    assert [r.ids for r in got if r.kind == "chunk"] == [[0, 1, 2], [9]]
    assert [r.phase for r in got if r.kind == "event"] == ["short_previous_repair", "containment_cleanup"]
    assert next(r for r in got if r.kind == "chunk").sources == ["chunk_000001", "chunk_000002", "chunk_000003"]


def test_large_filing_merges_whole(spark):
    n = 2004
    rows = [(k, "d", f"chunk_{k:06d}", [k], "", [0], [k, k]) for k in range(n) if k != 1998] + [(n, "d", "chunk_009999", [1997, 1998], "", [0], [1997, 1998])]
    said = {1999: "omega psi chi phi", 2000: "Yes", 2001: "omega psi chi phi"}
    name = lambda k, x: x + "".join("abcdefghij"[int(i)] for i in str(k))
    s = spark.createDataFrame([("d", k, said.get(k, f"{name(k, chr(107))} {name(k, chr(108))} {name(k, chr(109))}"), k) for k in range(n)], "document_id string, sentence_id bigint, text string, page int")
    got = merging.merge(spark.createDataFrame(rows, CHUNKS), s, merging.Settings(budget=0.0005)).collect()
    assert [(r.phase, r.first, r.second) for r in sorted((r for r in got if r.kind == "event"), key=lambda r: r.seq)] == [
        ("short_previous_repair", "chunk_001999", "chunk_002000"), ("containment_cleanup", "chunk_009999", "chunk_001997"), ("embedding_greedy_merge", "chunk_010000", "chunk_002001")]
    assert [1999, 2000, 2001] in [r.ids for r in got if r.kind == "chunk"] and len({r.segment for r in got}) == 1


class _Letters:
    """Vectors with few different values, so that scores tie and are exact."""

    name, dimension = "letters", 8

    def encode(self, texts):
        return [[float(1 + t.count(c) % 2) / 4 for c in "abcdefgh"] for t in texts]


def _merged_by_hand(pieces, words, s, model):
    """The merge steps word for word: all pairs, again after every step."""
    order = lambda p: (p["ids"][0], p["ids"][-1], len(p["ids"]), re.sub(r"\d+$", "", p["key"]), int((re.findall(r"\d+$", p["key"]) or [-1])[0]), p["key"])
    size = lambda ids: sum(len(words.get(i, "").split()) for i in ids)
    both = lambda a, b: sorted({*a["ids"], *b["ids"]})
    gap = lambda a, b: min(abs(x - y) for x in a for y in b) if a and b else 10**9
    vector = lambda p: np.array(model.encode([" ".join(words[i] for i in p["ids"] if i in words)])[0])
    held, events, number, budget = sorted(pieces, key=order), [], len(pieces), int(len(pieces) * s.budget)
    if len(held) < 2:
        return held, events

    def join(a, b, phase):
        nonlocal held, number
        number += 1
        new = {"key": f"chunk_{number:06d}", "ids": both(a, b), "pages": sorted({*a["pages"], *b["pages"]}), "sources": sorted({*a["sources"], *b["sources"]}), "short": False}
        held = sorted([p for p in held if p is not a and p is not b] + [new], key=order)
        events.append((phase, new["key"], a["key"], b["key"]))

    def clean(phase):
        nonlocal held
        while True:
            for small in reversed(held):
                over = [p for p in held if p is not small and set(small["ids"]) <= set(p["ids"]) and (len(p["ids"]) > len(small["ids"]) or order(p) < order(small))]
                if over:
                    target = min(over, key=lambda p: (-len(p["ids"]), order(p)))
                    target["sources"] = sorted({*target["sources"], *small["sources"]})
                    held = [p for p in held if p is not small]
                    events.append((phase, target["key"], target["key"], small["key"]))
                    break
            else:
                return

    while True:
        for p in held:
            before = [q for q in held if q is not p and q["ids"][-1] + 1 == p["ids"][0]]
            if len(p["ids"]) == 1 and p["short"] and size(p["ids"]) <= s.small_words and before:
                q = min(before, key=lambda x: (-len(x["ids"]), x["ids"][0], order(x)))
                if size(both(q, p)) <= s.most_words:
                    join(q, p, "short_previous_repair")
                    break
        else:
            break
    clean("containment_cleanup")
    while True:
        found = []
        for n, a in enumerate(held):
            for m in range(n + 1, len(held)):
                ratio = len({*a["ids"]} & {*held[m]["ids"]}) / min(len(a["ids"]), len(held[m]["ids"]))
                if ratio >= s.overlap and size(both(a, held[m])) <= s.most_words:
                    found.append((-ratio, size(both(a, held[m])), n, m))
        if not found:
            break
        _, _, n, m = min(found)
        join(held[n], held[m], "high_overlap_merge")
    while len(held) > 1 and sum(e[0] == "embedding_greedy_merge" for e in events) < budget:
        best = None
        for n, a in enumerate(held):
            for m in range(n + 1, len(held)):
                b = held[m]
                pages = gap(a["pages"], b["pages"]) <= 1
                if b["ids"][0] - a["ids"][-1] > s.most_gap and not pages:
                    break
                score = float(vector(a) @ vector(b))
                if (pages or gap(a["ids"], b["ids"]) <= s.most_gap) and score > s.similarity and size(both(a, b)) <= s.most_words and (best is None or score > best[0]):
                    best = (score, a, b)
        if best is None:
            break
        join(best[1], best[2], "embedding_greedy_merge")
    clean("final_containment_cleanup")
    return held, events


def test_merging_by_hand():
    """All five phases over filings whose pages jump back and forth, against the steps taken word for word."""
    phases = set()
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randrange(4, 40)
        words = {i: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 9))) or "a" for i in range(n + 6)}
        s = merging.Settings(similarity=rng.choice([0.3, 0.6, 0.9]), budget=rng.choice([0.4, 0.8]), most_words=rng.choice([9, 20, 60]), overlap=rng.choice([0.5, 0.8]))
        pieces = []
        for k in range(rng.randrange(1, 30)):
            start = rng.randrange(n)
            ids = sorted({start, *(start + rng.randrange(6) for _ in range(rng.randrange(5)))})
            pieces.append({"key": f"chunk_{k + 1:06d}", "ids": ids, "pages": sorted({rng.randrange(5) for _ in range(rng.randrange(3))}), "sources": [f"chunk_{k + 1:06d}"], "short": len(ids) == 1 and rng.random() < 0.5})
        model = _Letters()
        own = [merging._Piece(p["key"], tuple(p["ids"]), tuple(p["pages"]), tuple(p["sources"]), ("numeric_like",) if p["short"] else ()) for p in pieces]
        merger = merging.Merger(own, words, s, model)
        merger.run()
        held, events = _merged_by_hand(pieces, words, s, model)
        assert [(p.key, list(p.ids), list(p.sources)) for p in merger.pieces] == [(p["key"], p["ids"], p["sources"]) for p in held], seed
        # what is cleaned away may be told in another order
        told = [(e["phase"], e["merged"], e["first"], e["second"]) for e in merger.events]
        assert sorted(told) == sorted(events) and [e for e in told if "cleanup" not in e[0]] == [e for e in events if "cleanup" not in e[0]]
        phases |= {e[0] for e in events}
    assert phases == {"short_previous_repair", "containment_cleanup", "high_overlap_merge", "embedding_greedy_merge", "final_containment_cleanup"}


def test_merge_settings_are_checked():
    with pytest.raises(ValueError):
        merging.Settings(overlap=2)


def vectors_of(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(k, ["text", "table", "image"][k % 3], [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, modality string, embedding array<float>")


def test_topk_by_brute_force(spark):
    rows, frame = vectors_of(spark)
    asked = frame.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = {(r.query_id, r.modality, r.rank): r.vec_id for r in vectors.topk(frame.repartition(5), asked, {"text": 3, "table": 2, "image": 30}).collect()}
    want = {}
    for q, _, v in rows[::20]:
        for kind, k in (("text", 3), ("table", 2), ("image", 30)):
            ranked = sorted(((-sum(a * b for a, b in zip(v, e)), i) for i, m, e in rows if m == kind))[:k]
            want |= {(q, kind, n): i for n, (_, i) in enumerate(ranked, 1)}
    assert got == want


def test_topk_edges(spark):
    rows, frame = vectors_of(spark, 6)
    asked = spark.createDataFrame([(1, None), (2, [])], "query_id bigint, embedding array<float>")
    assert vectors.topk(frame, asked).count() == 0
    wide = spark.createDataFrame([(1, [1.0] * 5)], "query_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="width"):
        vectors.topk(frame, wide).count()
    holes = frame.unionByName(spark.createDataFrame([(99, "text", None)], frame.schema))
    assert 99 not in {r.vec_id for r in vectors.topk(holes, wide.selectExpr("query_id", "slice(embedding, 1, 4) AS embedding")).collect()}


def test_raw_fallback(spark):
    hits = spark.createDataFrame([(1, m, k, 0.42, 1) for k, m in enumerate(("text", "table", "image"))], "query_id bigint, modality string, vec_id bigint, score double, rank int")
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    limits = dict.fromkeys(("text", "table", "image"), 0.7)
    traces = {r.query_id: r for r in vectors.trace(vectors.retrieve(hits, asked, limits)).collect()}
    assert (traces[1].mode, traces[1].total, traces[1].below, traces[1].fallback_triggered) == ("raw_fallback", 3, 3, True)
    assert (traces[2].mode, traces[2].total) == ("multimodal", 0)


def test_parser_accounts_for_files(spark):
    record = lambda f: f"[F] {f}\n[T] t\n[M] m\n[C] c\n"
    out = spark.createDataFrame([(1, ["table_1.png", "missing.png"], record("table_1.png") + record("table_1.png") + record("other.png"))], "k int, expected array<string>, output string")
    parsed = enrichment.parse(out, "k")
    assert sorted((r.filename, r.status) for r in parsed.collect()) == [("other.png", "unexpected"), ("table_1.png", "duplicate"), ("table_1.png", "item")]
    row = enrichment.accounting(out, parsed, "k").first()
    assert (row.missing, row.unexpected, row.duplicates) == (["missing.png"], ["other.png"], ["table_1.png"])


def test_parser_keeps_inner_indents(spark):
    out = spark.createDataFrame([(1, None, "  [F] a.png  \n[T] T\n[M]   one\n    two  \n[C] x\n\n    y \n\n")], "k int, expected array<string>, output string")
    row = enrichment.parse(out, "k").first()
    assert (row.filename, row.metadata, row.content) == ("a.png", "one\n    two", "x\n\n    y")


def test_retry_rounds(spark):
    assert enrichment.schedule(5) == [5, 2, 1] and enrichment.schedule(1) == [1]

    class Picky:
        name = "picky"

        def describe(self, names, prompt):
            if len(names) > 1:
                raise RuntimeError("too many")
            return f"[F] {names[0]}\n[T] t\n[M] m\n[C] c" if names[0] != "b.png" else ""

    frame = spark.createDataFrame([("d", "a.png"), ("d", "b.png"), ("d", "c.png")], "document_id string, filename string")
    results, attempts = enrichment.enrich(frame, Picky(), batch=5, single_tries=2)
    assert sorted(r.filename for r in results.collect()) == ["a.png", "c.png"]
    assert [r.phase for r in attempts.select("phase").distinct().orderBy("phase").collect()] == ["batch_round_1", "batch_round_2", "batch_round_3", "single_retry_1", "single_retry_2"]
    assert enrichment.counts(results, frame).first()[1:] == (3, 2, 1)
    assert enrichment.enrich(frame.limit(0))[0].count() == 0


def test_evidence(spark):
    rows = [(1, " TABLE ", "a", 3, [81.0, 2.5], 0.5, "T", None, "c " * 5), (1, "table", "b", None, None, None, None, None, None), (1, "text", "c", 0, None, 1.0, None, "c", "c")]
    c = spark.createDataFrame(rows, "query_id bigint, modality string, id string, page int, bbox array<double>, score double, title string, summary string, content string")
    ready = evidence.with_ids(evidence.normalise(c), "id")
    lines = {r.evidence_id: r.line for r in ready.select("evidence_id", evidence.rendered(6).alias("line")).collect()}
    assert lines == {"T1": "[T1]\nLocation: page 3, bbox [81.0, 2.5]\nScore: 0.5\nTitle: T\nContent: c c...", "T2": "[T2]\nContent: None.", "E1": "[E1]\nScore: 1.0\nContent: c"}
    asked = spark.createDataFrame([(1, "what {text_evidence}?"), (2, None)], "query_id bigint, query string")
    prompts = {r.query_id: r.prompt for r in evidence.prompts(asked, ready).collect()}
    assert prompts[1].startswith("Question: what {text_evidence}?\n\nText evidence:\n[E1]") and prompts[1].endswith("Image evidence:\nNone.")
    assert prompts[2].count("None.") == 3
    package = {r.query_id: r for r in evidence.packages(asked, ready).collect()}
    assert (package[1].texts, package[1].tables, package[2].tables) == (1, 2, 0)
    assert json.loads(package[1].package)["contexts_by_modality"]["table"][0]["evidence_id"] == "T1"


def test_catalog(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "document_id string, v int")
    assert sorted(map(tuple, catalog.upsert(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    m = catalog.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("b"), F.lit("2")))
    assert spark.range(1).select(m.alias("m")).first().m == {"a": "1", "b": "2"}
    assert one(spark, catalog.lenient_int, a="x") == 0 and one(spark, catalog.lenient_int, a="7.9") == 7
    assert one(spark, catalog.flag, a=" Yes ") is True and one(spark, catalog.flag, a=None) is False


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "d", 0, 1, 1, "text", "x", [1, 2, 3, 4], "extra", 5)], BLOCKS + ", label string, n int")
    assert blocks.markdown(blocks.fields(rows)).count() == 1
    r, frame = vectors_of(spark, 6)
    asked = frame.where("vec_id = 0").selectExpr("vec_id AS query_id", "embedding", "modality AS score")
    assert vectors.topk(frame.withColumn("score", F.lit(9)).withColumn("rank", F.lit(9)), asked).count() == 6


PAGE = {
    "page_index": 1, "width": 1224, "height": 1584, "page_count": 3,
    "parsing_res_list": [
        {"block_label": "doc_title", "block_content": "Head", "block_bbox": [1, 2, 3, 4], "block_id": 0},
        {"block_label": None, "label": "text", "content": "alias", "bbox": [5, 6, 7, 8]}, {"label": "text", "content": "alias", "coordinate": [5, 6, 7, 8], "my_title": "x"}, 7, "no object",
    ],
}


def test_ocr_json(spark, tmp_path):
    folder = tmp_path / "DocA"
    folder.mkdir()
    (folder / "page_0002.json").write_text(json.dumps(PAGE))
    (folder / "page_0003.json").write_text(json.dumps({"parsing_res_list": [], "layout_det_res": {"boxes": []}}))
    (folder / "page_0004.json").write_text("no json")
    pages = {r.page_index: (r.document_id, r.width) for r in ocr_json.with_document(ocr_json.read_pages(spark, str(folder))).collect()}
    assert pages == {1: ("DocA", 1224.0), 2: ("DocA", None)}
    got = [(r.position, r.block_label, r.block_content, r.block_bbox, r.has_title) for r in ocr_json.read_blocks(spark, str(folder)).orderBy("position").collect()]
    assert got == [(0, "doc_title", "Head", [1.0, 2.0, 3.0, 4.0], False), (1, "", "alias", [5.0, 6.0, 7.0, 8.0], False), (2, "text", "alias", [5.0, 6.0, 7.0, 8.0], True)]
    (tmp_path / "layout.json").write_text(json.dumps({"layout_det_res": [{"boxes": [{"label": "table", "coordinate": [1, 2, 3, 4], "order": 5}]}]}))
    assert [(r.page_index, r.block_label, r.block_order) for r in ocr_json.read_layout(spark, str(tmp_path / "layout.json")).collect()] == [(0, "table", 5)]


def test_files(spark, tmp_path):
    for name in ("a.json", "a.md", "b.json", "b_text.json", "c.PNG"):
        (tmp_path / name).write_text("x")
    listed = files.listing(spark, str(tmp_path))
    assert files.document_pairs(listed).count() == 1 and files.document_pairs(listed, False).count() == 2
    assert files.images(listed).count() == 1 and files.asset_jobs(listed, listed).where("pdf IS NULL").count() == 2


def test_json_tables(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    row = {"asset_index": 1, "filename": "a.png", "page": 1, "asset_bbox": [1, 2, 3, 4], "title": "old"}
    path.write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"title": "new"}) + "\n")
    assert [(r.filename, r.title, r.bbox) for r in json_io.read_manifest(spark, str(path)).collect()] == [("a.png", "new", [1.0, 2.0, 3.0, 4.0])]
    path.write_text(json.dumps({"filename": "", "page": 1}) + "\n")
    with pytest.raises(Exception, match="manifest row"):
        json_io.read_manifest(spark, str(path)).collect()


def test_config(tmp_path, monkeypatch):
    good, template = tmp_path / "c.yaml", tmp_path / "c.example.yaml"
    good.write_text("retrieval:\n  candidate_k:\n    text: 3\nkey: todo\n")
    template.write_text("a: 1\n")
    config = Config.load(good)
    assert Retrieval.of(config).candidates == {"text": 3, "table": 5, "image": 5}
    monkeypatch.setenv("KEY", "from env")
    assert config.get("key") == "from env"
    with pytest.raises(ValueError):
        Config.load(template)
    with pytest.raises(FileNotFoundError):
        Config.load(tmp_path / "none.yaml")
    with pytest.raises(ValueError):
        Retrieval({"text": 0, "table": 1, "image": 1}, dict.fromkeys(("text", "table", "image"), 0.5), {})


def test_cli_names():
    from folioloom.__main__ import ALIASES, COMMANDS, parser

    assert len(COMMANDS) == 9 and set(ALIASES.values()) == set(COMMANDS)
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing", "--input", "x"])


def test_from_pages_to_answers(spark, tmp_path):
    folder = tmp_path / "DocA"
    folder.mkdir()
    texts = ["Revenue rose to five million. Costs fell in spring. The board met twice.", "Margins improved. Debt was repaid in full. Cash grew."]
    for n, t in enumerate(texts, 1):
        found = [{"block_label": "text", "block_content": t, "block_bbox": [1, 100, 300, 200], "block_id": 1}, {"block_label": "paragraph_title", "block_content": "Table of margins", "block_bbox": [1, 300, 300, 320], "block_id": 2}, {"block_label": "table", "block_content": "x", "block_bbox": [1, 330, 300, 400], "block_id": 3}]
        (folder / f"page_{n:04d}.json").write_text(json.dumps({"page_index": n - 1, "width": 600, "height": 800, "parsing_res_list": found}))
    pages, rows = pipelines.load_blocks(spark, str(folder))
    lines = pipelines.text_of(rows)
    assert lines.count() == 8
    final = pipelines.final_chunks(pipelines.initial_chunks(lines), lines)
    assert sorted({i for r in final.collect() for i in r.ids}) == list(range(8))
    table_rows = pipelines.describe(rows, pages, kinds=("table",))
    assert sorted(r.filename for r in table_rows.collect()) == ["table_0001_page_0001_Table_of_margins.png", "table_0002_page_0002_Table_of_margins.png"]
    made = pipelines.index(final, table_rows)
    stats = {r.modality: (r["count"], r.dimension) for r in records.manifest_stats(made).collect()}
    assert stats["table"] == (2, 64) and stats["text"][0] == final.count()
    records.write_index(made, str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "debt repaid")], "query_id bigint, query string")
    row = pipelines.answer(asked, again, Retrieval({"text": 5, "table": 2, "image": 1}, dict.fromkeys(("text", "table", "image"), 0.1), {"table": 4, "image": 3}, least_text=1)).first()
    assert row.mode == "text_only" and "Debt was repaid" in row.prompt and row.answer.startswith("Dry run answer")


def test_commands_end_to_end(spark, tmp_path, capsys):
    from folioloom.__main__ import main

    folder = tmp_path / "ocr" / "DocB"
    folder.mkdir(parents=True)
    block = lambda k, label, content, y: {"block_label": label, "block_content": content, "block_bbox": [1, y, 300, y + 50], "block_id": k}
    found = [block(1, "text", "Revenue rose in spring. Costs fell in summer. The board met twice.", 10), block(2, "table", "a", 200)]
    (folder / "page_0001.json").write_text(json.dumps({"page_index": 0, "width": 600, "height": 800, "parsing_res_list": found}))
    source, index = str(folder), str(tmp_path / "index")
    main(["chunk", "--input", source, "--output", str(tmp_path / "c"), "--sentences-output", str(tmp_path / "s"), "--initial-output", str(tmp_path / "i"), "--window", "3", "--overlap", "1"])
    assert spark.read.json(str(tmp_path / "s")).count() == 3 and spark.read.json(str(tmp_path / "i")).count() >= 1
    main(["chunk", "--input", source, "--output", str(tmp_path / "c2"), "--sentences", str(tmp_path / "s"), "--no-merge"])
    assert {i for r in spark.read.json(str(tmp_path / "c2")).collect() for i in r.ids} == {0, 1, 2}
    main(["index", "--input", source, "--output", index, "--catalog", str(tmp_path / "catalog")])
    main(["index", "--input", source, "--output", index, "--catalog", str(tmp_path / "catalog"), "--overwrite"])
    entry = spark.read.json(str(tmp_path / "catalog")).collect()
    assert [(r.document_id, r.modalities.text.dimension, r.modalities.table["count"]) for r in entry] == [("DocB", 64, 1)]
    main(["search", "--input", index, "--document", "DocB", "--query", "costs fell", "--include-below", "--output", str(tmp_path / "hits")])
    hits = spark.read.json(str(tmp_path / "hits")).collect()
    assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1)) and "Costs fell" in hits[0].content
    for wrong in (["--query", " ", "--document", "DocB"], ["--query", "x", "--document", "DocC"], ["--query", "x", "--document", "DocB", "--modality", "image"]):
        with pytest.raises(ValueError):
            main(["search", "--input", index, *wrong])
    main(["query", "--input", index, "--document", "DocB", "--query", "costs fell", "--output", str(tmp_path / "answer")])
    row = spark.read.json(str(tmp_path / "answer")).first()
    assert row.document_id == "DocB" and row.mode in ("multimodal", "raw_fallback", "text_only") and row.answer.startswith("Dry run answer")
    with pytest.raises(SystemExit):
        main(["chunk", "--input", source, "--output", str(tmp_path / "c3"), "--window", "2", "--overlap", "2"])


def test_page_sources(spark, tmp_path):
    """Page files before a single result before its layout boxes; titles told by a key."""
    (tmp_path / "A").mkdir()
    item = {"block_label": "text", "block_content": "page", "block_bbox": [1, 2, 3, 4], "sub_title": "yes"}
    (tmp_path / "A" / "page_0001.json").write_text(json.dumps({"parsing_res_list": [item]}))
    (tmp_path / "A.json").write_text(json.dumps({"parsing_res_list": [item | {"block_content": "single"}]}))
    (tmp_path / "B.json").write_text(json.dumps({"parsing_res_list": [item | {"block_content": "only"}]}))
    (tmp_path / "C.json").write_text(json.dumps({"layout_det_res": [{"boxes": [{"label": "table", "coordinate": [1, 9, 3, 12]}]}]}))
    _, rows = pipelines.load_blocks(spark, [str(tmp_path / "*.json"), str(tmp_path / "A" / "*.json")])
    assert sorted((r.document_id, r.content, r.has_title) for r in rows.collect()) == [("A", "page", True), ("B", "only", True), ("C", "", False)]
    table = rows.where("document_id = 'C'").withColumn("document_id", F.lit("A"))
    titled = assets.nearest_title(assets.assets_of(table), rows.where("document_id = 'A'"))
    assert [r.title for r in titled.collect()] == ["page"]


def test_saved_sentences(spark, tmp_path):
    rows = [{"document_id": "d", "sentence_id": 1, "text": " a  b ", "page_index": 2}, {"document_id": "d", "sentence_id": 1, "text": "later"}, {"document_id": "d", "sentence_id": 2, "text": " "}, {"document_id": "d", "sentence_id": 3, "text": "c", "page": 9}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    got = json_io.read_sentences(spark, str(tmp_path / "s.jsonl")).orderBy("sentence_id").collect()
    assert [tuple(r) for r in got] == [("d", 1, "a b", 3), ("d", 3, "c", 9)]


def test_a_model_splits(spark):
    class Halves:
        def split(self, paragraph):
            return paragraph.split(" / ")

    rows = spark.createDataFrame([(1, "d", 0, 1, 1, "text", "one / two", [1, 2, 3, 4]), (2, "d", 0, 2, 2, "paragraph_title", "A / B", [1, 5, 3, 6])], BLOCKS)
    got = pipelines.text_of(blocks.fields(rows), Halves()).orderBy("sentence_id").collect()
    assert [r.text for r in got] == ["one", "two", "A / B"]


def test_montage_files(spark):
    rows = [(1, "table", "a.png"), (1, "image", "b.png"), (1, "text", "a.png"), (2, "image", "gone.png"), (3, "image", None)]
    contexts = spark.createDataFrame(rows, "query_id bigint, modality string, crop_path string")
    kept = evidence.montage_sources(contexts, spark.createDataFrame([("a.png",), ("b.png",), ("b.png",)], "path string"))
    assert sorted((r.query_id, r.modality) for r in kept.collect()) == [(1, "image"), (1, "table")]
    paths = evidence.montage_paths(kept, "out/", F.lit("Doc"), F.lit("q")).collect()
    assert [(r.query_id, [("table" in x, x.startswith("out/")) for x in r.paths]) for r in paths] == [(1, [(True, True), (False, True)])]
    f = spark.createDataFrame([("x/a.JPG", b"ab"), ("noname", b"")], "path string, content binary")
    assert [r.v for r in f.select(evidence.data_url(F.col("path"), F.col("content")).alias("v")).collect()] == ["data:image/jpeg;base64,YWI=", "data:image/png;base64,"]
    assert evidence.endpoint("http://h/v1/") == evidence.endpoint("http://h/v1/chat/completions") == "http://h/v1/chat/completions"


@pytest.mark.parametrize("seed", range(4))
def test_search_within_documents(spark, seed, monkeypatch):
    """Each query against the records of its document, by hand; a third of the records in one document."""
    rng = random.Random(seed)
    monkeypatch.setattr(vectors, "RECORD_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    doc = lambda: rng.choice(["a", "a", "b", "c", None])
    vector = lambda: rng.choice([None, [], *[[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(9)]])
    stored = [(k, doc(), rng.choice(["text", "table", "image"]), vector()) for k in range(120)]
    asked = [(k, rng.choice(["a", "b", "zz", None]), vector()) for k in range(12)]
    r = spark.createDataFrame(stored, "vec_id bigint, document_id string, modality string, embedding array<float>")
    q = spark.createDataFrame(asked, "query_id bigint, document_id string, embedding array<float>")
    want = []
    for key, d, v in asked:
        for kind, most in (("text", 4), ("table", 2), ("image", 1)):
            scores = sorted((-sum(x * y for x, y in zip(v, w)), n) for n, e, m, w in stored if e == d and m == kind and w) if v and d else []
            want += [(key, kind, n, -s, at) for at, (s, n) in enumerate(scores[:most], 1)]
    got = vectors.topk(r, q, {"text": 4, "table": 2, "image": 1}, within=True)
    assert sorted((x.query_id, x.modality, x.vec_id, x.score, x["rank"]) for x in got.collect()) == sorted(want)
    assert vectors.topk(r.limit(0), q, within=True).count() == 0 == vectors.topk(r, q.limit(0), within=True).count()


def test_retrieval_without_hits_above(spark):
    """One raw hit below its threshold for each modality."""
    hits = spark.createDataFrame([(1, m, k, 0.42, 1) for k, m in enumerate(("text", "table", "image"))], "query_id bigint, modality string, vec_id bigint, score double, rank int")
    row = vectors.trace(vectors.retrieve(hits, spark.createDataFrame([(1,)], "query_id bigint"), dict.fromkeys(("text", "table", "image"), 0.7))).first()
    assert (row.mode, row.texts, row.tables, row.images, row.total, row.below, row.threshold_fallback, row.fallback_triggered) == ("raw_fallback", 1, 1, 1, 3, 3, True, True)


def test_evidence_without_contexts(spark):
    contexts = spark.createDataFrame([], "query_id bigint, modality string, evidence_id string, id string, page int, score double, title string, summary string, content string, place int, bbox array<double>")
    row = evidence.packages(spark.createDataFrame([(1, "q")], "query_id bigint, query string"), contexts).first()
    assert (row.texts, row.tables, row.images) == (0, 0, 0) and json.loads(row.package)["query"] == "q"


def test_written_tables_are_cleared(spark):
    from folioloom.sources import durable

    frame = durable.written(spark.range(3))
    path = frame.inputFiles()[0].removeprefix("file://")
    assert Path(path).exists() and durable.clear(spark) >= 1 and not Path(path).exists()


def test_values_of_settings(spark, tmp_path):
    from folioloom import config

    assert config.backend_of("vllm") == "vllm-server" and config.backend_of(" off ") is None and config.backend_of(None) is None
    assert config.switch_of(" Yes ") and not config.switch_of("0") and config.one_of(" Table ", config.MONTAGES, "kind") == "table" and config.document_id_of(" d ") == "d"
    for wrong in (lambda: config.backend_of("x"), lambda: config.switch_of("maybe"), lambda: config.one_of("text", config.MONTAGES, "kind"), lambda: config.document_id_of(" ")):
        with pytest.raises(ValueError):
            wrong()
    assert config.relative(tmp_path / "a" / "b", tmp_path) == "a/b" == config.relative("a/b", tmp_path) and config.relative(" ", tmp_path) == "" and config.relative("/x/y", tmp_path) == "/x/y"
    f = spark.createDataFrame([("12",), ("x",), (" ",), (None,)], "v string")
    assert [tuple(r) for r in f.select(catalog.lenient_int(F.col("v")), catalog.lenient_number(F.col("v"))).collect()] == [(12, 12.0), (0, 0.0), (0, 0.0), (0, 0.0)]
    assert [r.v for r in f.where("v IS NULL OR v <> 'x'").select(catalog.optional(F.col("v"), "int").alias("v")).collect()] == [12, None, None]
    for column in (catalog.strict(F.col("v"), "int", "size"), catalog.optional(F.col("v"), "int")):
        with pytest.raises(Exception, match="(size must be int|CAST_INVALID)"):
            f.select(column).collect()
    assert enrichment.batch_prompt("Look:\n{filenames}\n{{json}}", ["a{b}.png", "c.png"]) == "Look:\n- a{b}.png\n- c.png\n{json}"


def test_jobs_need_their_pdf(spark, tmp_path):
    for name in ("a.json", "a_text.json", "b.json", "a.pdf"):
        (tmp_path / name).write_text("x")
    held = files.listing(spark, str(tmp_path))
    assert sorted((r.json.rsplit("/", 1)[1], bool(r.pdf)) for r in files.asset_jobs(held, held).collect()) == [("a.json", True), ("b.json", False)]
    with pytest.raises(Exception, match="no PDF for"):
        files.asset_jobs(held, held, strict=True).collect()


def test_records_of_model_output(spark):
    """A mark missing, marks in another order, marks inside a line, records without a name."""
    out = "noise\n[F] a.png\n[T] t [M] x\n[M] m\n[C] c\n  more  \n[F] b.png\n[T] t\n[C] c\n[F] \n[T] t\n[M] m\n[C] c\n [F] c.png\n[C] c\n[M] m\n[T] t\n[F] d.png\n[T]\n[M]\n[C] last"
    frame = spark.createDataFrame([("d", ["a.png"], out), ("e", None, None), ("f", [], "")], "document_id string, expected array<string>, output string")
    got = [(r.filename, r.title, r.metadata, r.content, r.status) for r in enrichment.parse(frame, "document_id").orderBy("position").collect()]
    assert got == [("a.png", "t [M] x", "m", "c\n  more", "item"), ("d.png", "", "", "last", "unexpected")]


def test_hashed_words():
    a, b, c = HashedWords(16).encode(["Same words", "same WORDS", ""])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(c)


def test_streaming(spark, tmp_path, tables):
    from folioloom.streaming import ingest

    source = spark.read.parquet(f"{tables}/ocr_blocks.parquet")
    # the blocks of a page come in two batches
    for part in (0, 1):
        source.where(F.pmod("block_key", F.lit(2)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = ingest.write_text(ingest.once(ingest.stream(spark, str(tmp_path / "in"), source.schema)), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out" / "blocks")).drop("batch", "bucket")
    columns = ["document_id", "page_index", "markdown", "blocks"]
    got = ingest.read_text(spark, str(tmp_path / "out")).select(columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, blocks.markdown(blocks.fields(kept)).select(columns).collect()), key=repr)
    assert spark.read.parquet(str(tmp_path / "out" / "pages")).select("batch").distinct().count() == 2
