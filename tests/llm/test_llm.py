"""The operators for training text: labelled cases, brute force, round trips and edge cases."""

import base64
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioloom.llm import encode, leakage, markup, pairs, pii, queries, scan_noise, site_lines, split

BLOCKS = "block_key bigint, document_id string, source string, page_index bigint, block_label string, block_content string"
RUNS = "run_id bigint, query string, expected_answer string, generated_answer string"
QUERIES, SQL = queries.queries(), queries.oracle_sql()
LONG = "word " * 60_000


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(name, spark, tables):
    import duckdb

    got = QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    rows = rows_of(got, *columns)
    assert rows or name == "p2_templates"
    assert len(rows) == len({repr(r) for r in rows})
    if name in SQL:
        con = duckdb.connect()
        for path in Path(tables).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        result = con.sql(SQL[name])
        at = [sorted(result.columns).index(c) for c in columns]
        order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
        assert rows == sorted((tuple(r[order[i]] for i in at) for r in result.fetchall()), key=repr)


def test_found_columns(spark, tables):
    wanted = {
        "p1_found": "run_id bigint, answer_field string, defect string", "p2_found": "block_key bigint, line_no bigint", "p3_found": "chunk_key bigint", "p4_found": "block_key bigint, markup string",
        "p5_found": "block_key bigint, noise string", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint, pii_type string, pii_value string",
    }
    for name, columns in wanted.items():
        assert ", ".join(f"{n} {k}" for n, k in QUERIES[name](spark, tables).dtypes) == columns


# 1: pairs

QUESTION = "Why did net revenues of Alverton change in 3Q 2022?"
GOOD = "Net revenues of Alverton rose by 12% to $45 million owing to higher client activity in trade finance."
CASES = [
    ("", "empty"), (" \t\n", "empty"), ("\u200b", "empty"), ("...", "empty"), ("N/A", "empty"), ("[ ]", "empty"), ("none", "empty"),
    (QUESTION, "copied_query"), (QUESTION.upper(), "copied_query"), (f"{QUESTION} {QUESTION}", "copied_query"), (f'"{QUESTION}"\n', "copied_query"),
    ("I'm sorry, but I cannot answer this from the evidence provided.", "refusal"), ("As a language model, I have no way of determining that. Please consult a licensed adviser.", "refusal"),
    ("My guidelines keep me from commenting on Alverton", "refusal"), ("I must decline to discuss the net revenues of Alverton; could you upload the document again?", "refusal"),
    ("Die Nettoerträge von Alverton stiegen um 12 % auf 45 Mio. EUR, vor allem wegen neuer Mandate im Bereich Zahlungen.", "other_language"),
    ("Les produits nets de Alverton ont augmenté de 12 % pour atteindre 45 millions d'euros dans cette activité.", "other_language"),
    ("Net revenues of Alverton rose by 12% to $45 million owing to hig", "truncated"), (GOOD[:-1] + " mainly because of the", "truncated"), (GOOD[:-1] + " (see the...", "truncated"), (f"{GOOD} Net revenues (", "truncated"),
    (GOOD, None), (GOOD[:-1], None), ("About 12%", None), ("$45 million", None), ("The filing does not state net revenues for Alverton.", None), (f"You asked about this: {QUESTION} {GOOD}", None),
    (f"{GOOD} («informe de gestión»)", None), ("Alverton was unable to renew part of its lines, so net revenues fell to $45 million in 3Q 2022.", None), (None, "empty"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows = []
    # enough sound and broken rows for the statistics
    for k in range(1500):
        name, n = f"Al{rng.choice(['ver', 'mon', 'ter', 'gan'])}ton", rng.randrange(2, 90)
        q = QUESTION.replace("Alverton", name)
        lang = rng.random()
        if lang < 0.12:
            q, a = f"Warum haben sich die Nettoerträge von {name} verändert?", f"Die Nettoerträge von {name} stiegen um {n} % auf {n} Mio. EUR, vor allem wegen neuer Mandate im Bereich Zahlungen."
        elif lang < 0.24:
            q, a = f"Pourquoi les produits nets de {name} ont-ils changé ?", f"Les produits nets de {name} ont augmenté de {n} % pour atteindre {n} millions d'euros dans cette activité."
        else:
            a = rng.choice([GOOD, "The movement is explained by higher client activity in trade finance, worth about $45 million.", "About 12%", "In trade finance, net revenues fell to $45 million in 3Q 2022."]).replace("Alverton", name).replace("12", str(n))
        rows.append((10_000 + k, q, None, a))
    for k, (answer, _) in enumerate(CASES * 3):
        rows.append((k, QUESTION, GOOD if answer is not None else None, answer))
    frame = spark.createDataFrame(rows, RUNS)
    return {(r.run_id, r.answer_field): r.defect for r in pairs.found(frame).collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_defects(judged, number):
    assert judged.get((number, "generated")) == CASES[number][1], CASES[number]


def test_sound_answers_stay(judged):
    wrong = [k for k in judged if k[0] >= 10_000 or k[1] == "expected"]
    assert not wrong


def test_language_asked_for():
    assert pairs.query_language("Why did it fall? Please answer in German.") == ("en", "de")
    assert pairs.query_language("Warum sank der Gewinn? Bitte auf Französisch antworten.") == ("de", "fr")
    assert pairs.query_language("¿Por qué cambió? Responda en inglés.") == ("es", "en")
    assert pairs.query_language(None) == (None, None)


def test_label_model_learns():
    counts = {"11": 40, "10": 5, "1-": 10, "00": 900, "-0": 30, "01": 15}
    posterior = pairs.fit(counts)
    assert posterior["11"] > 0.9 > 0.1 > posterior["00"]
    assert pairs.fit({}) == {}


def test_pieces_of_words_are_cuts():
    stats = pairs.Statistics(words={"renew": 9, "renewal": 50}, pairs={("mandate", "renewal"): (5, 50), ("mandate", "renew"): (6, 6), ("to", "renew"): (1, 40), ("of", "N", ""): (0, 90)}, singles={"renew": (7, 46)})
    assert stats.cut_short("mandate", "renew") and not stats.cut_short("to", "renew") and not stats.cut_short("mandate", "renewal")
    assert stats.end_share("to", "renew", "?") == 1 / 40 and stats.end_share("of", "alverton", "N") == 0.0 and stats.end_share("x", "y", "?") is None


def test_words_that_do_not_travel_are_asked_for(spark):
    rows = [(k, QUESTION, None, f"Net revenues of Alverton rose because of higher word{chr(97 + k % 7)} in trade") for k in range(80)] + [(100, QUESTION, None, QUESTION), (101, QUESTION, None, "I'm sorry, but I cannot answer this."), (102, QUESTION, None, "The words rose because of zzq")]
    frame = spark.createDataFrame(rows, RUNS)
    want = rows_of(pairs.found(frame), "run_id", "defect")
    assert (100, "copied_query") in want and (101, "refusal") in want
    old, pairs.COMMON = pairs.COMMON, 4
    try:
        got = rows_of(pairs.found(frame), "run_id", "defect")
    finally:
        pairs.COMMON = old
    assert [r for r in got if r[1] != "truncated"] == [r for r in want if r[1] != "truncated"]


def _odd_runs(seed=3):
    """Texts of few words in all orders, most of them broken off, with pieces, names, figures and odd signs."""
    rng = random.Random(seed)
    words = "the renewal renew renewals der Erträge stiegen l'an d'euros Mio. Alverton Alver rose roses of in 12% $45 2022 ½ İstanbul ß trade-finance (see «avis» no. zzq Nettoerträge activité más".split()
    rows = []
    for k in range(600):
        answer = " ".join(rng.choice(words[: rng.choice((6, 15, len(words)))]) for _ in range(rng.randrange(1, 14))) + rng.choice(("", "", ".", "...", " ?"))
        rows.append((k, rng.choice((None, "", QUESTION, "Alverton: renewal-rate roses?", "Erträge von Alverton, l'an 2022?", "rose")), rng.choice((None, answer[:9], "")), answer))
    return rows + rows[:5]


@pytest.mark.parametrize("cap", [1, 25])
def test_any_cap_gives_the_same_labels(spark, tables, cap):
    for frame in (spark.read.parquet(f"{tables}/query_summaries.parquet"), spark.createDataFrame(_odd_runs(), RUNS)):
        want = rows_of(pairs.labels(frame).withColumn("posterior", F.round("posterior", 6)), "run_id", "answer_field", "defect", "posterior")
        assert {"truncated", "other_language"} <= {r[2] for r in want}
        old, pairs.COMMON = pairs.COMMON, cap
        try:
            assert rows_of(pairs.labels(frame).withColumn("posterior", F.round("posterior", 6)), "run_id", "answer_field", "defect", "posterior") == want
        finally:
            pairs.COMMON = old


def test_pairs_edges(spark):
    rows = [(1, None, None, None), (2, "", "", ""), (None, None, "x", LONG), (2, "", "", "")]
    frame = spark.createDataFrame([(*r, "extra", "1") for r in rows], RUNS + ", votes string, defect string")
    got = rows_of(pairs.found(frame), "run_id", "answer_field", "defect")
    assert (1, "generated", "empty") in got and (2, "expected", "empty") in got and (1, "expected", "empty") not in got
    assert pairs.found(spark.createDataFrame([], RUNS)).count() == 0
    assert "empty" in {r.defect for r in pairs.labels(frame).collect()}


# 2: site lines


def test_site_lines_by_brute_force(spark):
    rng = random.Random(2)
    lines = ["Share this filing by mail!", "SHARE THIS FILING, by mail 12", "share\u00a0this filing by mail", "Quote reference 1 to the desk", "quote Reference 99 to the desk", "short 1", "Other words of a body line"]
    rows = []
    for k in range(160):
        text = "\n".join(rng.sample(lines, 2) + [f"body {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]} unique words"])
        rows.append((k, f"d{rng.randrange(9)}", rng.choice(["a", "a", "b", None]), 0, rng.choice(["text", None, " Table", "NUMBER ", "header"]), text))
    rows += [(1000, "d1", "a", 0, "text", None), (1001, None, "a", 0, "text", lines[0]), (1002, "d2", "a", 0, "text", "")]
    seen = {}
    for key, doc, site, _, label, text in rows:
        if site and doc and text is not None and (label or "").strip().lower() not in site_lines.SKIPPED_LABELS:
            for n, line in enumerate(text.split("\n"), 1):
                letters = "".join(c for c in line.lower() if c.isalpha())
                if len(letters) >= 10:
                    seen.setdefault((site, letters), []).append((key, n, doc))
    want = sorted(((k, n) for hits in seen.values() if len({d for *_, d in hits}) >= 5 for k, n, _ in hits), key=repr)
    frame = spark.createDataFrame([(*r, 1) for r in rows], BLOCKS + ", leaf int")
    assert rows_of(site_lines.repeated_lines(frame), "block_key", "line_no") == want
    clean = {r.block_key: (r.block_content, r.removed) for r in site_lines.without_repeated(frame).collect()}
    assert len(clean) == len(rows) and clean[1000] == (None, 0) and clean[1002] == ("", 0)
    assert sum(n for _, n in clean.values()) == len(want)
    shown = {r.template for r in site_lines.templates(frame).collect()}
    assert any("<*>" in t for t in shown)
    # the same tree by hand: what stands under one leaf in five documents or more, and what its lines share
    leaves = {}
    for (site, letters), hits in seen.items():
        cut = [letters[i : i + 6] for i in range(0, len(letters), 6)]
        leaves.setdefault((site, len(letters), *cut[:3], letters[-6:]), []).append((cut, hits))
    wide = sorted((leaf[0], len({d for _, h in held for *_, d in h}), sum(len(h) for _, h in held)) for leaf, held in leaves.items() if len({d for _, h in held for *_, d in h}) >= 5)
    assert rows_of(site_lines.templates(frame), "source", "documents", "lines") == sorted(wide, key=repr)
    assert site_lines.repeated_lines(frame.limit(0)).count() == 0


def test_templates_have_slots(spark):
    rows = [(k, f"d{k}", "a", 0, "text", f"This notice of the registry in {town} {k} was filed by e-mail on request\nThis notice was written by {town} only") for k, town in enumerate(["Ostvale", "Brindle", "Quorvan", "Sauvell", "Ostvale", "Merrowi"])]
    rows += [(9, "d9", "a", 0, "text", "THIS NOTICE of the registry in Ostvale was filed by email on request")]
    frame = spark.createDataFrame(rows, BLOCKS)
    got = {r.template: (r.documents, r.lines) for r in site_lines.templates(frame).collect()}
    assert got["THIS NOTICE of the registry <*> <*> <*> <*> by email on request"] == (7, 7)
    assert site_lines.repeated_lines(frame).count() == 0  # no letters agree in five documents
    assert site_lines.shown("a1 bcd 2,500 efghij klm", ["abcdef", None, "m"]) == "a<*> bcd <*> <*> <*>"


# 3: splitting


def test_pieces(spark):
    s = {1: "One two three.", 2: "Four five six seven.", 3: "Eight nine.", 4: "Ten eleven twelve."}
    text = "One two three. Four five six seven.\nEight nine. Ten eleven twelve."
    cuts = split.pieces_of(text, 7, 1, list(s.items()))
    # what is repeated fits beside the first new sentence, so the second line is opened
    assert [(text[a:e].strip(), ids) for a, _, e, ids in cuts] == [("One two three. Four five six seven.", [1, 2]), ("Four five six seven.\nEight nine.", [2, 3]), ("Eight nine. Ten eleven twelve.", [3, 4])]
    cuts = split.pieces_of(text, 5, 1, list(s.items()))
    # four words don't fit beside two
    assert [ids for *_, ids in cuts] == [[1], [2], [3, 4]]
    cuts = split.pieces_of(text, 9, 1, list(s.items()))
    assert [(text[a:e].strip(), ids) for a, _, e, ids in cuts] == [("One two three. Four five six seven.", [1, 2]), ("Four five six seven.\nEight nine. Ten eleven twelve.", [2, 3, 4])]


@pytest.mark.parametrize("seed", range(12))
def test_pieces_are_whole(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["a", "bb", "c;", "d,", "e.", "F", "#", "-", "1."]) for _ in range(n))
    text = "".join(words(rng.randrange(0, 30)) + rng.choice([" ", "\n", "\n\n", "\n## T\n", "\n- x ", "\u00a0", "\u2003"]) for _ in range(rng.randrange(1, 25)))
    known = [(k, words(rng.randrange(1, 9))) for k in range(5)]
    for limit in (1, 3, 10, 40):
        cuts = split.pieces_of(text, limit, rng.randrange(4), known)
        assert "".join(text[n:e] for _, n, e, _ in cuts) == text
        assert all(len(text[a:e].split()) <= limit for a, _, e, _ in cuts)
        assert (len(cuts) > 1) == (len(text.split()) > limit)


def test_split_edges(spark):
    c = spark.createDataFrame(
        [(1, "d", 1, [2, 1, None, 7], "A b. C d.", "x"), (2, "d", 1, None, None, "x"), (3, None, 9, [], LONG, "x"), (4, "d", 1, [1], "", "x"), (5, "d", None, [1], "A b. C d.", "x"), (1, "d", 1, [2, 1, None, 7], "A b. C d.", "x"), (6, "d", 2, [1], LONG, "x")],
        "chunk_key bigint, document_id string, config_id int, sentence_ids array<bigint>, text string, overlap string",
    )
    s = spark.createDataFrame([("d", 1, "A b.", 1), ("d", 1, "A b.", 1), ("d", 2, "C d.", 1), ("d", None, None, 1), (None, 3, "x", 1)], "document_id string, sentence_id bigint, text string, words int")
    k = spark.createDataFrame([(1, 2, 1), (2, 500, None), (9, None, 1)], "config_id int, max_tokens int, overlap int")
    got = split.split_chunks(c, s, k).orderBy("chunk_key", "piece_no").collect()
    assert [(r.text, r.sentence_ids) for r in got if r.chunk_key == 1] == [("A b.", [1])] * 2 + [(" C d.", [2])] * 2 or [r.text.strip() for r in got if r.chunk_key == 1] == ["A b."] * 2 + ["C d."] * 2
    assert len([r for r in got if r.chunk_key == 6]) == 120 and max(r.words for r in got if r.chunk_key == 6) <= 500
    assert {r.chunk_key for r in got} == {1, 3, 4, 5, 6} and {r.chunk_key for r in got if r.oversized} == {1, 6}
    assert split.split_chunks(c.limit(0), s, k).count() == 0 and split.split_chunks(c, s.limit(0), k.limit(0)).where("oversized").count() == 0


# 4: markup


@pytest.mark.parametrize("text, kinds", [
    ("<p class=note>x", ["html"]), ("a<br/>b", ["html"]), ("<!-- x -->", ["html"]), ("x &amp; y", ["html"]), ("&lt;td&gt;", ["html"]), ("&#8217;", ["html"]),
    ("### Head", ["markdown"]), ("**bold** x", ["markdown"]), ("*As one sentence.*", ["markdown"]), ("__x__", ["markdown"]), ("[a](http://b)", ["markdown"]), ("![a](b.png)", ["markdown"]), ("> Quoted", ["markdown"]), ("`code`", ["markdown"]), ("```\nx\n```", ["markdown"]), ("a | b\n---|---\n1 | 2", ["markdown"]),
    ("[[A|b]]", ["wiki"]), ("{{cite|a=1}}", ["wiki"]), ("'''x'''", ["wiki"]), ("== H ==", ["wiki"]), ("{| class=x\n|-\n| a\n|}", ["wiki"]),
    (r"\section*{A}", ["latex"]), (r"\begin{itemize} \item a \end{itemize}", ["latex"]), (r"\( x \ge 1 \)", ["latex"]), ("x $ ^{1} $", ["latex"]), (r"5\% of \emph{x}", ["latex"]), ("$$ a_1 $$", ["latex"]),
    ("- item\n1. two\n• three", []), ("a < 25% while R&D rose; leverage (>3x)", []), ("A <= 3 and 3 < B", []), ("$5 million and $ 7 million", []), (r"C:\reports\18\final", []), ("a_rev_2025.xlsx", []), ("Adjusted* income; *Short term", []), ("(5 * 78 units) and 6 * 7", []), ("A|B|C", []), ("#1 in x", []), ("{see Note 7}", []), ("BBB+ ~$5", []), ("", []), (None, []),
])
def test_kinds_of_markup(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_clean_text():
    c = markup.convert
    assert c("<h3>Risk</h3>a<UL><LI>one</LI><LI>two &amp; three</LI></UL>") == "# Risk\na\n- one\n- two & three"
    assert c("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>") == "a\tb\n1\t2"
    assert c("|a|b|\n|---|---|\n|1|2|") == "a\tb\n1\t2"
    assert c("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}").strip() == "a\tb\n1\t2"
    assert c("## H\n**b** [t](http://u) `x` {{c}} [[F|l]]") == "# H\nb t x  l"
    assert c(r"\section*{H} \textbf{b} 5\% $\alpha_{1}$").strip() == "# H\nb 5% $\\alpha_{1}$"
    assert c("```\nx = 1\n```\nend") == "    x = 1\n\nend"
    assert c("&lt;td&gt;x").strip() == "x" and c(None) is None and c("plain") == "plain"
    assert c(r"C:\tmp\item and <b>x</b>") == r"C:\tmp\item and x"
    assert c("<div>" * 300 + "x").strip() == "x"


@pytest.mark.parametrize("mark", ["<p>x", "<li>x", "<tr><td>y", "<div>x", "<b>x", "<table><tr><td>x", "<blockquote>x", "<sup>x", "<!-- x", "&lt;p&gt;x", "**a ", "''a ", "\\\\(a ", "\\\\textbf{a ", "[[a", "`a "])
def test_markup_is_read_once(mark):
    """Ten times the marks take some ten times as long, however deep they nest, and nothing recurses."""
    import time

    def seconds(n):
        best = []
        for _ in range(2):
            start = time.perf_counter()
            for step in (markup.kinds_of, markup.subtree_hashes, markup.convert):
                step(mark * n)
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(20_000) < 30 * seconds(2_000) + 0.2


def test_left_out_end_tags():
    c = markup.convert
    assert c("<table><tr><td>a<td>b x<tr><td>1<td>2</table>after") == "a\tb x\n1\t2\nafter"
    assert c("<ul><li>a<li>b <ul><li>c<li>d</ul><li>e</ul>") == "- a\n- b\n- c\n- d\n- e"
    assert c("<p>one<p>two<div>three</div>") == "one\n\ntwo\n\nthree" and c("<pre>\na = 1\n  b\n</pre>z") == "    a = 1\n      b\nz"
    assert len(markup.Tree("<li>x" * 50).elements) == 50 and all(e.end - e.start == 5 for e in markup.Tree("<li>x" * 50).elements)
    assert c(r"\textbf{a \emph{b {c} d}} e") == "a b {c} d e"
    assert markup.kinds_of("drew $180 million from a_rev_2025.xlsx, then $4 million") == [] and markup.kinds_of("*" + "long words of emphasis " * 9 + "end*") == ["markdown"]


def test_tables_are_no_template(spark):
    rows = [(k, f"d{k}", "a", 0, "text", f"<table><tr><td>Settlement fees</td><td>{k}</td></tr></table><p>Shared legal notice {k}\r\nof the site</p>&lt;div&gt;Escaped shared notice&lt;/div&gt;") for k in range(6)]
    clean = {r.block_key: (r.block_content, r.removed_subtrees) for r in markup.without_markup(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert clean == {k: (f"Settlement fees\t{k}", 2) for k in range(6)}


def test_site_templates_go(spark):
    rows = [(k, f"d{k}", "a", 0, "text", f"<div class=n>Share this filing {k} with others</div><p>Body {chr(97 + k)} text</p>") for k in range(6)]
    rows += [(10, "d9", "b", 0, "text", "<div class=n>Share this filing 7 with others</div>"), (11, None, None, None, None, None), (12, "d", "a", 0, "text", ""), (13, "d", "a", 0, "text", "<b>" + LONG), (0, "d0", "a", 0, "text", rows[0][5])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], BLOCKS + ", kinds string")
    clean = {r.block_key: (r.block_content, r.removed_subtrees) for r in markup.without_markup(frame).collect()}
    assert clean[3] == ("Body d text", 1) and clean[10] == ("Share this filing 7 with others", 0) and clean[11] == (None, 0) and clean[12] == ("", 0)
    assert markup.site_templates(frame).count() == 1
    assert markup.markup_found(frame.limit(0)).count() == 0
    old, markup.BROADCAST_ROWS = markup.BROADCAST_ROWS, -1
    try:
        assert {r.block_key: (r.block_content, r.removed_subtrees) for r in markup.without_markup(frame).collect()} == clean
    finally:
        markup.BROADCAST_ROWS = old


# 5: scanning noise

BODY = "The committee reviewed the margin agreements and the collateral calls under the recovery plans."


@pytest.fixture(scope="module")
def lexicon():
    words = re.findall(r"\w+", BODY.lower()) + "client board moved weaker exposure governance broad based while term".split()
    return scan_noise.Lexicon({w: 1000 for w in words} | {"doc": 40})


@pytest.mark.parametrize("wrong, right", [("cornmittee", "committee"), ("reviewecl", "reviewed"), ("rnargin", "margin"), ("a9reements", "agreements"), ("collatera1", "collateral"), ("iinder", "under"), ("p|ans", "plans"), ("vveaker", "weaker"), ("dient", "client"), ("chent", "client"), ("govemance", "governance"), ("expo5ure", "exposure"), ("Boarcl", "Board"), ("whilc", "while"), ("tcrm", "term"), ("fhe", "the")])
def test_misread_words(lexicon, wrong, right):
    assert lexicon.right(wrong) == right


def test_sound_words(lexicon):
    assert not any(lexicon.right(w) for w in ["committee", "Zanormdor", "file", "B2B", "2025", "10-K", "CET1", "doc"])


@pytest.mark.parametrize("text, kinds", [
    (BODY, []), ("the mar-\ngin", ["hyphen"]), ("the mar- gin", ["hyphen"]), ("the mar¬\r\ngin", ["hyphen"]), ("broad-\nbased", ["hyphen"]), ("broad- based", ["hyphen"]), ("weaker- and broad-based", []), ("weaker-\nand broad", []), ("2023- 2024", []),
    ("worth $SO.9 million", ["misread"]), ("3O locations", ["misread"]), ("in 2O2S", ["misread"]), ("up 2.l%", ["misread"]), ("Codes O2-48, B10 or B2B; 1H25, CET1", []), ("the cornmittee", ["misread"]),
    ("3", ["pagenum"]), ("Page 3 of 9", ["pagenum"]), ("– 3 –", ["pagenum"]), ("[3]", ["pagenum"]), ("p. 3", ["pagenum"]), ("3 / 9", ["pagenum"]), ("4", []), ("3,000", []), ("3 locations", []), ("", []), (None, []),
])
def test_noise(lexicon, text, kinds):
    assert scan_noise.noise_of(text, 2, lexicon) == kinds


@pytest.mark.parametrize("text, kinds", [
    ("![Chart](imgs/chart_1.jpg)\nthe cornmittee met", ["misread"]), ("| a | b |\n|---|---:|\n| c | 1 |\nthe cornmittee met", ["misread"]), ("the cornmittee met\n| a | b |", ["misread"]), ("the cornmittee met\nfor governance|", ["misread"]),
    ("the board moved\n|imit under a cornmittee", ["misread"]), ('{| class="x"\n! a !! b\n|-\n| c || 1\n|} the cornmittee met', ["misread"]), ("the board\n|ong met |ong", ["misread"]),
    ("| the cornmittee | 3O |\n|rnargin||3O\nthe board", []), ("a | cornmittee |\nthe board", []), ("|p|an|", []), ('{|\n! rnargin\n|-\n|rnargin\n|}\nthe board', []),
])
def test_noise_beside_tables(text, kinds):
    lexicon = scan_noise.Lexicon({w: 1000 for w in "the committee met for governance board moved limit long under margin plan a".split()})
    assert scan_noise.noise_of(text, 2, lexicon) == kinds


def test_repair(lexicon):
    assert scan_noise.repair("the cornmi-\nttee moved $SO.9 million", lexicon)[0] == "the committee moved $50.9 million"
    assert scan_noise.explained("cornrnittee", "committee") and not scan_noise.explained("file", "the")


def test_noise_and_paragraphs(spark):
    rows = [(k, "d", "s", 2, "text", BODY) for k in range(30)]
    rows += [(100, "d", "s", 2, "Header ", "ACME Report 2024"), (101, "d", "s", 2, "text", "Acme report 2025\nThe committee reviewed the mar-\ngin agree- ments\nand moved on.\n3\nThe collateral calls."), (102, "e", "s", 2, "text", "Acme report 2025"), (103, None, None, None, None, "3"), (104, "d", "s", 2, None, None), (105, "d", "s", 2, "table", "3"), (106, "d", "s", 2, "text", LONG), (101, "d", "s", 2, "text", "3")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], BLOCKS + ", noise string")
    assert rows_of(scan_noise.noise_found(frame), "block_key", "noise") == [(101, "hyphen"), (101, "pagenum"), (101, "pagenum"), (101, "running")]
    once = frame.where("NOT (block_key = 101 AND block_content = '3')")
    got = [r.text for r in scan_noise.paragraphs(once).where("block_key = 101").orderBy("paragraph_no").collect()]
    assert got == ["The committee reviewed the margin agreements and moved on.", "The collateral calls."]
    assert scan_noise.noise_found(frame.limit(0)).count() == 0 and scan_noise.paragraphs(frame.limit(0)).count() == 0


def _long_tail(seed=5):
    """Blocks over a vocabulary whose rare words hold far less than 1e-5 of all words, with misreadings of rare ones."""
    rng = random.Random(seed)
    rare = sorted({"".join(rng.choice("aeiou") + rng.choice("bdgklmnprstv") for _ in range(4)) + "ing" for _ in range(60)})
    rows, wrong = [], {}
    for k, word in enumerate(rare):
        rows += [(1000 * k + j, "d", "s", 0, "text", f"The {BODY[4:].lower()} {word} plans of the margin") for j in range(25)]
        bad = word.replace("m", "rn", 1) if "m" in word else word.replace("d", "cl", 1) if "d" in word else word.replace("i", "1", 1)
        rows.append((1000 * k + 999, "d", "s", 0, "text", f"under the {bad} of the mar-\ngin agree- ments"))
        wrong[1000 * k + 999] = word
    filler = " ".join(["the committee reviewed the agreements"] * 5_000)
    return rows + [(10**6 + k, "d", "s", 0, "text", filler) for k in range(120)], wrong


def test_rare_words_are_repaired_both_ways(spark):
    rows, wrong = _long_tail()
    frame = spark.createDataFrame(rows, BLOCKS)
    total = sum(len(r[5].split()) for r in rows)
    assert 25 / total < 1e-5
    got = rows_of(scan_noise.noise_found(frame), "block_key", "noise")
    found = {k for k, noise in got if noise == "misread"}
    assert len(found & set(wrong)) >= 0.9 * len(wrong) and not found - set(wrong)
    text = rows_of(scan_noise.paragraphs(frame), "block_key", "paragraph_no", "text")
    assert sum(wrong[k] in t for k, _, t in text if k in wrong) >= 0.9 * len(wrong)
    old, scan_noise.BROADCAST_FORMS = scan_noise.BROADCAST_FORMS, 20
    try:
        assert rows_of(scan_noise.noise_found(frame), "block_key", "noise") == got
        assert rows_of(scan_noise.paragraphs(frame), "block_key", "paragraph_no", "text") == text
    finally:
        scan_noise.BROADCAST_FORMS = old


def _odd_scans(seed=7):
    """Blocks over frequent and rare words, then what a size of the lexicon might change; the last key of the frequent ones."""
    rng = random.Random(seed)
    rare = ["".join(rng.choice("aeou") + rng.choice("gkprstv") for _ in range(4)) for _ in range(150)] + ["x", "ß", "ray", "year", "٣٤"]
    texts = [f"{BODY} so so"] * 200 + ["golden hcll " * 10] * 150 + ["ring bell " * 10] * 130 + ["the bcll"] * 60 + [" ".join(rare)] * 5
    first = len(texts)
    texts += ["reviewed the cornmit-\n3\ntee", "a 50-\nyear note", "the ring bcll", "a golden bcll", "of the x-\nray", "a- b|c- d", "the ß-\nray and ٣٤-\nyear", "x|mar- gin|c- so", "the cornmit- tee¬so-\nyear"]
    words = BODY.split() + rare + "cornmit tee mar gin 50 10 x ß a b|c |imit bell hcll ring golden and <b> | a@b CET1 2O2S 3 reviewecl agree ments".split()
    texts += ["".join(rng.choice(words) + rng.choice((" ", " ", " ", "-\n", "- ", "¬", "\n", "\n3\n", "|", " | ")) for _ in range(rng.randrange(2, 12))) for _ in range(400)]
    return [(k, "d", "s", 2, "text", text) for k, text in enumerate(texts)], first


def test_size_of_the_lexicon_changes_nothing(spark):
    rows, first = _odd_scans()
    frame = spark.createDataFrame([*rows, *rows[first : first + 9]], BLOCKS)
    once = spark.createDataFrame(rows, BLOCKS)
    noise = rows_of(scan_noise.noise_found(frame), "block_key", "noise")
    text = rows_of(scan_noise.paragraphs(once), "block_key", "paragraph_no", "text")
    assert noise.count((first, "misread")) == 2
    assert {(first + 1, 1, "a 50-year note"), (first + 2, 1, "the ring bell"), (first + 3, 1, "a golden hcll"), (first + 4, 1, "of the x-ray")} <= set(text)
    old = scan_noise.BROADCAST_FORMS
    for scan_noise.BROADCAST_FORMS in (150, 2):
        try:
            assert rows_of(scan_noise.noise_found(frame), "block_key", "noise") == noise
            assert rows_of(scan_noise.paragraphs(once), "block_key", "paragraph_no", "text") == text
        finally:
            scan_noise.BROADCAST_FORMS = old


def test_strokes_as_a_column(spark):
    forms = ["cornmittee", "mwduhbi1|et0589qz62", "", "straße"]
    frame = spark.createDataFrame([(f,) for f in forms], "form string")
    assert [r.s for r in frame.select(scan_noise._stroked(F.col("form")).alias("s")).collect()] == [scan_noise.skeleton(f) for f in forms]


# 6: token ids


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path = f"{encode.TOKENIZER_DIR}/{encode.RANK_FILE}"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("test", pat_str=encode.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library(spark, library, tables):
    rng = random.Random(6)
    texts = [None, "", " ", "\n\n \t", "é e\u0301 ½ ٣ 漢字 😀 \u200b<|endoftext|>", "don't we'LL", "a" * 70_000, LONG, "x\r\ny  z   "] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    frame = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)] + [(0, None, 7)], "doc_id bigint, text string, ids int")
    got = encode.encode_texts(frame).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "")
    back = {r.doc_id: r.text for r in encode.decode_ids(encode.encode_texts(frame)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert encode.encode_texts(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["letters", "zh", "repeated", "signs", "dashes", "mixed", "base64"])
def test_long_words_match_the_library(library, name):
    rng = random.Random(name)
    word = {
        "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12_000)), "zh": "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4_000)), "repeated": "a" * 70_001, "signs": "ÃÂ" * 900,
        "dashes": "\u2500" * 5_003, "mixed": "".join(rng.choice(["abc" * 40, "th", "\u2588" * 9, "e"]) for _ in range(300)), "base64": base64.b64encode(rng.randbytes(30_000)).decode(),
    }[name]
    encoder = encode.Encoder.of(f"{encode.TOKENIZER_DIR}/{encode.RANK_FILE}")
    texts = [word, "x " + word[:4_001], word[:33], word[1:32], word[:49]]
    assert encoder.encode(texts).to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert not Path(".tmp").exists()


# 7: leaks


def test_leaks_by_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(20)) if k < 8 else t) for k, t in enumerate([None] * 8 + [None, "", "too short"])]
    docs = []
    for k in range(120):
        i = items[rng.randrange(8)][1].split()
        a = rng.randrange(14)
        copied = i[a : a + rng.choice([5, 7, 8, 9, 12, 20])]
        style = rng.randrange(4)
        text = [" ".join(copied), ", ".join(copied).upper(), "**" + "** _x_ **".join([" ".join(copied)]) + "**", "<b>" + "</b>\r\n<i>".join(copied)][style]
        docs.append((k, " ".join(rng.choice(words) for _ in range(5)) + " zz " + text + " zz " + " ".join(rng.choice(words) for _ in range(5))))
    docs += [(200, None), (201, ""), (202, LONG + items[0][1]), (5, docs[5][1])]
    plain = lambda t: re.findall(r"[a-z0-9]+", re.sub(r"<[^>]*>", " ", (t or "").lower()))
    want = []
    for d, t in docs:
        own = plain(t)
        grams = {tuple(own[i : i + 8]) for i in range(len(own) - 7)}
        for key, item in items:
            w = plain(item)
            covered = {p + o for p in range(len(w) - 7) if tuple(w[p : p + 8]) in grams for o in range(8)}
            if w and len(covered) >= 0.4 * len(w):
                want.append((d, key))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, covered int")
    held = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert rows_of(leakage.leaks(frame, held), "doc_id", "item_id") == sorted(want, key=repr)
    cleaned = leakage.without_leaks(frame, held).collect()
    assert len(cleaned) == len(docs) and {r.doc_id for r in cleaned if r.removed_words} == {d for d, _ in want}
    again = spark.createDataFrame([(r.doc_id, r.text) for r in cleaned], "doc_id bigint, text string")
    assert leakage.leaks(again, held).count() == 0
    assert leakage.leaks(frame, held.limit(0)).count() == 0 and leakage.leaks(frame.limit(0), held).count() == 0
    full = rows_of(leakage.leaks(frame, held), "doc_id", "item_id", "covered", "item_words")
    old, leakage.WORDS_PER_BLOCK, leakage.MAP_BITS = (leakage.WORDS_PER_BLOCK, leakage.MAP_BITS), 60, 12
    try:
        assert rows_of(leakage.leaks(frame, held), "doc_id", "item_id", "covered", "item_words") == full
        assert rows_of(leakage.without_leaks(frame, held), "doc_id", "text", "removed_words") == sorted([tuple(r) for r in cleaned], key=repr)
        assert leakage.leaks(frame.limit(0), held).count() == 0
    finally:
        leakage.WORDS_PER_BLOCK, leakage.MAP_BITS = old


# 8: personal information


def test_personal_information(spark):
    given = "Alda Benno Carla Dorit Emil Frida".split()
    last = "Frostmere Kremidge Urbacker Stovander".split()
    rows, n = [], 0
    for g in given:
        for s in last:
            rows += [(n, f"Ms. {g} {s} (912-{n:02d}-1000) signed.", 1), (n + 100, f"Prepared by {g} {s} and reviewed by T. {s} before release.\nTel. 212-555-01{n:02d}", 1)]
            rows += [(n + 200, f"The board met. Payroll file: {s}, {g} | SSN 912-{n:02d}-2000 | {n + 1} Old Quay Road, Suite {n}, Grauwald QX1 2ZZ", 1)]
            n += 1
    special = {
        500: "The Alda Kremidge Foundation of Grauwald met. Benno Street Partners LLP audited it. Reference 12 12 18; ISIN XS000000001308; 5 @ 1.40; @Alverton.",
        501: "Write to CARLA URBACKER or mail c.urbacker [at] alverton [dot] ir [dot] example; also x@y.test and z9(at)w.invalid",
        502: "The ledger line reads 912-33-4444 without remark. Contact: 212-555-0199", 503: "wohnhaft Gerberstraße 63a, Merrowick", 504: "12 bis, rue des Tisserands, 00116 Sauvelle", 505: "calle de los Molinos, n.º 83, Pontrieul",
        506: None, 507: "", 508: LONG + " Ms. Alda Kremidge",
    }
    rows += [(k, t, 1) for k, t in special.items()] + [(501, special[501], 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = {}
    for r in pii.personal(frame).collect():
        got.setdefault(r.doc_id, set()).add((r.pii_type, r.pii_value))
    assert got[0] == {("name", "Alda Frostmere"), ("id_number", "912-00-1000")}
    assert got[100] == {("name", "Alda Frostmere"), ("name", "T. Frostmere"), ("phone", "212-555-0100")}
    assert got[200] == {("name", "Frostmere, Alda"), ("id_number", "912-00-2000"), ("address", "1 Old Quay Road, Suite 0, Grauwald QX1 2ZZ")}
    assert 500 not in got and 506 not in got and 507 not in got
    assert got[501] == {("name", "CARLA URBACKER"), ("email", "c.urbacker [at] alverton [dot] ir [dot] example"), ("email", "x@y.test"), ("email", "z9(at)w.invalid")}
    assert got[502] == {("id_number", "912-33-4444"), ("phone", "212-555-0199")}
    assert [got[k] for k in (503, 504, 505)] == [{("address", v)} for v in ("Gerberstraße 63a, Merrowick", "12 bis, rue des Tisserands, 00116 Sauvelle", "calle de los Molinos, n.º 83, Pontrieul")]
    assert got[508] == {("name", "Alda Kremidge")}
    masked = {r.doc_id: r.text for r in pii.masked(frame).collect()}
    assert masked[0] == "Ms. [NAME] ([ID_NUMBER]) signed." and masked[506] is None and masked[507] == "" and masked[500] == special[500]
    assert pii.masked(frame).count() == len(rows)
    old, pii.BROADCAST_ROWS = pii.BROADCAST_ROWS, -1
    try:
        assert {(r.doc_id, r.pii_type, r.pii_value) for r in pii.personal(frame).collect()} == {(k, *v) for k, values in got.items() for v in values}
    finally:
        pii.BROADCAST_ROWS = old
    # rows are told apart by key and hash: the same text under another key has its own spans
    twice = frame.where("doc_id = 0").unionByName(frame.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(frame.where("doc_id <> 0"))
    assert [r.text for r in pii.masked(twice).where("doc_id IS NULL").collect()] == [masked[0]]
    assert pii.personal(frame.limit(0)).count() == 0


def test_subpackage_stands_alone():
    """Nothing outside the subpackage imports it but the entry file, which asks first."""
    root = Path(queries.__file__).resolve().parents[1]
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any("folioloom.llm" in p.read_text() for p in others)
    assert F is not None
