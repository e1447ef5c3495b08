"""Operators of the archive on small cases, and against plain Python versions on random ones."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from periodika.functions import text as X
from periodika.operators import quality as D
from periodika.operators import search as R
from periodika.operators import taxonomy as K
from periodika.operators import toc as T
from periodika.operators.ranks import ranks
from periodika.sources import archive as S
from periodika.sources.stored import Files, HashStore, Unit
from periodika.streaming import jobs as J
from periodika.streaming.ingest import SCHEMAS, Ingestion


def one(spark, values, f, schema="v string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["x"] for r in df.select("i", f.alias("x")).orderBy("i").collect()]


def test_norm_is_accent_free_lower_case(spark):
    words = ["Crème", "ÉTÉ", "Œuvre", "straße", "ŁÓDŹ", "naïve café", "plain", "", None, "été"]
    got = one(spark, words, X.norm(F.col("v")))
    for w, g in zip(words, got, strict=True):
        if w is not None and "Ł" not in w and "Œ" not in w:
            assert g == "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).casefold()
    assert got[-2] is None


def test_issue_metadata(spark):
    cases = [
        ("60 Millions De Consommateurs - 580 - 2022-05", "60 Millions De Consommateurs", ("580", 2022, 5, "Mai")),
        ("Ca M'interesse - 514 - 12-2023", None, ("514", 2023, 12, "Décembre")),
        ("AD Digest France - Septembre-Octobre 2026", None, (None, 2026, 9, "Septembre-Octobre")),
        ("Computer Music 316 January 2023", None, ("316", 2023, 1, "Janvier")),
        ("60 Millions De Consommateurs Hors-Série - Impôts", "60 millions de consommateurs", (None, None, None, None)),
        ("Revue 03-04-2021 n 77", None, ("77", 2021, 3, "Mars-Avril")), ("Revue 2021-03-03", None, (None, 2021, 3, "Mars")), ("Annuel 1998", None, (None, 1998, None, None)), ("Sans date", None, (None, None, None, None)),
    ]
    got = one(spark, [(t, c) for t, c, _ in cases], X.issue_metadata(F.col("v"), F.col("c")), "v string, c string")
    for (title, _, want), g in zip(cases, got, strict=True):
        assert (g["issue_number"], g["year"], g["month"], g["label"]) == want, title
    assert str(got[0]["publication_date"]) == "2022-05-01" and str(got[7]["publication_date"]) == "1998-01-01"


def test_issue_types_and_titles(spark):
    assert one(spark, ["Hors-Série 12", "hors séries", "HS auto", "Spéciaux", "special", "respectacle", "normal"], X.issue_type(F.col("v"))) == ["hs", "hs", "hs", "sp", "sp", "normal", "normal"]
    titles = ["607-sommaire.indd", "HS_COUV_v3.indd", "Les fraudes perdurent GRAND TEST 607-titre.indd", "MIX", "Q&A", "GT3 RS", "couv fr.pdf", "About .net and co"]
    assert one(spark, titles, X.clean_title(F.col("v"))) == ["", "", "Les fraudes perdurent GRAND TEST", "MIX", "Q&A", "GT3 RS", "", "About .net and co"]
    assert one(spark, ["Le n°45 paraît", "N° 123", "no sign", "4321"], X.cover_number(F.col("v"))) == ["45", "123", None, None]
    assert one(spark, ["en 1998", "4321", "12019"], X.cover_year(F.col("v"))) == [1998, None, None]


def test_error_summary(spark):
    noise = "    1 [tesseract] lots of diacritics"
    cases = [f"{noise}\nOutput file: The generated PDF is INVALID\n{noise}", "1 Error: /syntaxerror in --runpdf--\nOperand stack:\na\nb\nc\nd\ne\nf", noise, "", None]
    got = one(spark, cases, X.error_summary(F.col("v")))
    assert got[0] == "Output file: The generated PDF is INVALID"
    assert got[1] == "1 Error: /syntaxerror in --runpdf-- | b | c | d | e"
    assert got[2] == noise.strip() and got[3] == got[4] == "(aucune sortie d'erreur)"
    assert one(spark, ["cannot open /srv/a b/c.pdf now\nmore"], X.sanitize_error(F.col("v"))) == ["cannot open a b/c.pdf now"]


def test_highlight_escapes_and_marks(spark):
    got = one(spark, ["a <b> C++ & c++"], X.highlight(F.col("v"), ["c++"]))
    assert got == ["a &lt;b&gt; <mark>C++</mark> &amp; <mark>c++</mark>"]


def test_keywords(spark):
    titles = ["Ouvrir une porte", "Les UV au banc d'essai", "Les crèmes  solaires testées", "Crème solaire", "Solaire sans creme", "C++ et autres", "Des bijoux", "Le bus"]
    articles = spark.createDataFrame(list(enumerate(titles)), "id long, title string").withColumn("magazine_id", F.lit(1))
    sub = spark.createDataFrame([(1, ["UV"]), (2, ["crème solaire"]), (3, []), (4, [" ", "zzz"]), (5, ["bijou"]), (6, ["++"]), (7, ["bus"])], "id int, keywords array<string>")
    got = {(r["subtheme_id"], r["article_id"]) for r in K.attach_keywords(articles, sub).collect()}
    assert got == {(1, 1), (2, 2), (2, 3), (5, 6), (7, 7)}
    assert [(r["subtheme_id"], r["keyword"]) for r in K.sterile_keywords(articles, sub).orderBy("subtheme_id").collect()] == [(4, "zzz"), (6, "++")]


def test_blocked_join_loses_no_match(spark):
    rng = random.Random(1)
    letters = ["a", "s", "x", "as", "es", "bus", "gas", "été", "l'art", "e-mail", "s-max", "x", "mots"]
    titles = [" ".join(rng.choice(letters) + rng.choice(["", "s", "x", "!"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    keys = [" ".join(rng.choice(letters) for _ in range(rng.randrange(1, 3))) for _ in range(60)]
    articles = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    sub = spark.createDataFrame([(i, [k]) for i, k in enumerate(keys)], "id int, keywords array<string>")
    got = {(r["subtheme_id"], r["article_id"]) for r in K.attach_keywords(articles, sub).collect()}
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    want = set()
    for i, k in enumerate(keys):
        pattern = re.compile(r"\b" + r"\s+".join(re.escape(w) + "[sx]?" for w in plain(k).split()) + r"\b")
        want |= {(i, j) for j, t in enumerate(titles) if pattern.search(plain(t))}
    assert got == want and want


def test_keyword_join_is_no_nested_loop_over_words(spark):
    articles = spark.range(10).select("id", F.lit("red ring").alias("title"))
    sub = spark.createDataFrame([(1, ["ring"])], "id int, keywords array<string>")
    blocked = K.keywords_of(sub).filter("block <> ''")
    plan = K.keyword_matches(articles, blocked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def _page(spark, text, page=1, magazine=1):
    return D.page_lines(spark.createDataFrame([(magazine, page, text)], "magazine_id long, page_number int, raw_text string"))


def _parse(spark, text):
    rows = T.parse_entries(T.classify_lines(_page(spark, text))).orderBy("line_no").collect()
    return [(r["title"], r["start_page"], r["end_page"]) for r in rows]


def test_entries_of_each_style(spark):
    assert _parse(spark, "Le grand test . . . . . p. 6\nUn autre titre      12-15") == [("Le grand test", 6, None), ("Un autre titre", 12, 15)]
    assert _parse(spark, "100 /  La rénovation\nd'une toiture\n/ 5\n106 /  Le bois") == [("La rénovation d'une toiture / 5", 100, None), ("Le bois", 106, None)]
    assert _parse(spark, "18\nContrôle médical\nsuite\n\n42\nAutre titre") == [("Contrôle médical suite", 18, None), ("Autre titre", 42, None)]
    assert _parse(spark, "Premier titre\n12\nSecond titre\n14") == [("Premier titre", 12, None), ("Second titre", 14, None)]
    assert _parse(spark, "Dossier ensuite\nENQUÊTE\nLe titre. . . 7") == [("Le titre", 7, None)]
    assert _parse(spark, "100La rénovation") == []


def _by_pattern(kinds):
    """Entries (anchor line, title) of a page by regular expressions over a string with a letter for each line's kind.

    Letters: e blank, l label, t trailing, n leading (number first), b bare, x text. The page falls into stretches that begin at any of e, l, t, n.
    """
    line = "".join({"blank": "e", "label": "l", "trailing": "t", "leading": "n", "bare": "b", "text": "x"}[k] for k in kinds)
    out, loose = [], {}  # loose: for each stretch's end the texts that wait for a number
    for stretch in re.finditer(r"[eltn]?[bx]*", line):
        at, body = stretch.start(), stretch[0]
        # texts before a number wait for it, as long as no number stood alone or in front
        plain = re.match(r"[elt]?(?:x+b)*x*", body)[0] if not body.startswith("n") else ""
        waits = plain[: len(plain) - len(re.search(r"x*$", plain)[0])]
        for m in re.finditer(r"(x+)b", plain):
            out.append((at + m.end() - 1, range(at + m.start(1), at + m.end(1))))
        rest = body[len(waits) :] if "b" in body[len(plain) :] or body.startswith("n") else ""
        first = len(body) - len(rest)
        for m in re.finditer(r"[nb](x*)", rest):
            if rest[m.start()] == "n" or m[1]:
                if first + m.start() >= len(plain) or body.startswith("n"):
                    out.append((at + first + m.start(), [at + first + m.start(), *range(at + first + m.start(1), at + first + m.end(1))][0 if rest[m.start()] == "n" else 1 :]))
        if len(plain) == len(body):
            loose[stretch.end()] = range(at + len(waits), at + len(plain)) if waits else range(at + len(re.match(r"[elt]?", body)[0]), at + len(plain))
    for m in re.finditer("t", line):
        before = loose.get(m.start(), ())
        out.append((m.start(), [*before][-3:] + [m.start()]))
    word = lambda i: f"own{i}" if kinds[i] in ("leading", "trailing") else f"txt{i}"
    return sorted((a, " ".join(map(word, [*t][-4:] if kinds[a] == "trailing" else [*t][-3:]))) for a, t in out)


def test_windows_equal_patterns_over_line_kinds(spark):
    rng = random.Random(2)
    kinds = ["blank", "label", "trailing", "leading", "bare", "text", "text", "text"]
    cases = [[rng.choice(kinds) for _ in range(rng.randrange(1, 14))] for _ in range(1500)]
    spell = {"blank": "", "label": "LABEL", "trailing": "own{i} ..... {n}", "leading": "{n} Own{i}", "bare": "{n}", "text": "txt{i}"}
    rows = [(m, 1, i, spell[k].format(i=i, n=i + 1), k) for m, case in enumerate(cases) for i, k in enumerate(case)]
    df = spark.createDataFrame(rows, "magazine_id long, page_number int, line_no int, line string, kind string")
    got: dict = {}
    for r in T.parse_entries(df).collect():
        got.setdefault(r["magazine_id"], []).append((r["line_no"], r["title"].replace("Own", "own")))
        assert r["start_page"] == r["line_no"] + 1
    assert {m: sorted(v) for m, v in got.items()} == {m: a for m, c in enumerate(cases) if (a := _by_pattern(c))}


def test_headings(spark):
    strict = ["SOMMAIRE", "Sommaire interactif", "S O M M A I R E", "Contents", "sommaire", "Sommairement", "contents et cela", "cm/contenis"]
    assert one(spark, strict, T.is_heading(F.col("v"))) == [True, True, True, True, False, False, False, False]
    lines = ["cm/contents", "cm/contenis", "S O M M A I R E", "sommaire", "cm/inbox", "Des lecteurs"]
    df = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(lines)], "magazine_id long, page_number int, line_no int, line string")
    assert sorted(r["line_no"] for r in T.fuzzy_headings(df).collect()) == [0, 1, 2]


def test_pages_of_the_contents(spark):
    entry = "\n".join(f"Article {chr(65 + i)} ..... {i + 7}" for i in range(5))
    pages = [(1, 4, "SOMMAIRE\n" + entry), (1, 5, entry.replace("Article", "Suite")), (1, 6, "de la prose"), (2, 3, "cm/contenis\n12\n14\n16"), (2, 7, entry), (3, 6, entry.replace("Article", "Sujet")), (3, 40, "Sommaire\n" + entry), (4, 2, "prose")]
    lines = D.page_lines(spark.createDataFrame(pages, "magazine_id long, page_number int, raw_text string"))
    got = sorted((r["magazine_id"], r["page_number"]) for r in T.find_toc_pages(lines).collect())
    assert got == [(1, 4), (1, 5), (2, 3), (3, 6)]


def test_running_headers_hide_bare_numbers_unless_kept(spark):
    pages = spark.createDataFrame([(1, i, f"Revue {i}\n{i}\ntext {'abc'[i]}") for i in range(3)], "magazine_id long, page_number int, raw_text string")
    lines = D.page_lines(pages)
    left = lambda **k: sorted({r["line"] for r in D.without_repeated_lines(lines, **k).filter("line <> ''").collect()})
    assert left() == ["text a", "text b", "text c"]
    assert left(keep_bare_numbers=True) == ["0", "1", "2", "text a", "text b", "text c"]


def test_garbled_documents(spark):
    prose = "le chat et la souris sont dans la maison pour que le chien et le loup soient avec les autres dans un champ"
    junk = " ".join("qzx" + "abcdefgh"[i % 8] * 2 for i in range(20))
    rows = [(1, i, junk) for i in range(3)] + [(1, 9, prose)] + [(2, 0, junk), (2, 1, junk), (2, 2, prose)] + [(3, 0, "court")] + [(4, i, junk if i < 3 else prose) for i in range(100)]
    df = spark.createDataFrame(rows, "magazine_id long, page_number int, raw_text string")
    assert {r["magazine_id"]: r["garbled"] for r in D.garbled_documents(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r["magazine_id"]: r["decision"] for r in D.ocr_decision(df).collect()} == {1: "force-ocr", 2: "copy", 3: "skip-text", 4: "copy"}


def test_page_language_against_known_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = docs.select(F.col("doc_id").alias("magazine_id"), F.lit(1).alias("page_number"), F.col("text").alias("raw_text"))
    rows = D.page_language(pages).join(docs.select(F.col("doc_id").alias("magazine_id"), "lang"), "magazine_id").groupBy("lang", "language").count().collect()
    n = {(r["lang"], r["language"]): r["count"] for r in rows}
    for lang in ("fr", "en"):
        assert n[lang, lang] / sum(c for (a, _), c in n.items() if a == lang) > 0.8


def test_batches(spark):
    articles = spark.range(1000).select("id", F.lit("a title").alias("title"))
    got = K.pack_batches(articles, 1000).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [300, 300, 300, 100]
    # '{"article_id": 7, "titre": "a title", "collection": null}' and two digits more are 15 tokens, 66 of which fit
    got = [r["count"] for r in K.pack_batches(articles, 99_000).groupBy("batch").count().orderBy("batch").collect()]
    assert sum(got) == 1000 and got[:15] == [66] * 15
    costs = spark.createDataFrame([([50, 60, 10, 200, 5],)], "c array<int>")
    assert costs.select(K.fold_batches(F.col("c"), 2, 100).alias("b")).first()["b"] == [0, 1, 1, 2, 3]


def test_an_item_costs_what_its_json_adds_to_a_request(spark):
    import json
    import math

    texts = ["plain", "", 'with "quotes" and \\ back', "line\nend\ttab\r\x0c\x08", "\x01\x1f", "accents é 한 \U0001f600", None]
    rows = [(i * 37, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(rows, "id long, title string, collection string")
    for empty in (0, 1, 2, 3, 1021):
        got = {r["id"]: r["cost"] for r in df.select("id", K.item_cost(F.col("id"), F.col("title"), F.col("collection"), empty).alias("cost")).collect()}
        whole = lambda items: math.ceil((empty - 2 + len(json.dumps(items, ensure_ascii=False))) / 4)  # noqa: B023, E731
        assert got == {i: whole([{"article_id": i, "titre": a, "collection": b}]) - whole([]) for i, a, b in rows}


def test_packing_in_ranges_is_greedy_packing(spark):
    import random

    rng = random.Random(5)
    rows = [(c, i * 3, rng.choice([0, 1, 5, 9, 30, 120])) for c, n in ((1, 900), (2, 1), (3, 20), (None, 70)) for i in range(n)]
    want, state = {}, {}
    for c, i, cost in rows:
        batch, n, total = state.get(c, (0, 0, 0))
        batch, n, total = (batch + 1, 1, cost) if n and (n >= 7 or total + cost > 100) else (batch, n + 1, total + cost)
        state[c] = want[c, i] = (batch, n, total)
    df = spark.createDataFrame(rows, "c int, id long, cost int").repartition(5)
    got = {(r["c"], r["id"]): r["batch"] for r in K.pack_ranges(df, "c", 7, 100, width=16).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    plan = K.pack_batches(df.withColumn("title", F.lit("x")), 99_900, "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_scan_classes(spark):
    files = spark.createDataFrame([("a", "h1", 1, 100), ("b", "h9", 2, 100), ("c", "h2", 3, 100), ("d", "h3", 4, 1), ("e", "h3", 4, 1), ("f", "h4", 5, 1)], "path string, file_hash string, size long, mtime long")
    known = spark.createDataFrame([(1, "a", "h1", 1, 100), (2, "b", "h8", 2, 50), (3, "old", "h2", 3, 100), (4, "gone", "h7", 1, 1)], "id long, path string, file_hash string, size long, mtime long")
    got = {(r["path"], r["class"]) for r in S.classify_scan(files, known).collect()}
    want = {("a", "unchanged"), ("b", "modified"), ("c", "relocated"), ("d", "new"), ("e", "duplicate"), ("f", "new"), ("gone", "missing")}
    assert got == want
    asked = []

    def hashes(left):
        asked.extend(r["path"] for r in left.collect())
        return left.join(files.select("path", F.col("file_hash")), "path").select("path", "file_hash")

    out = S.classify_scan(files.drop("file_hash"), known, hashes=hashes)
    assert {(r["path"], r["class"]) for r in out.collect()} == want and sorted(asked) == ["b", "c", "d", "e", "f"]
    twice = spark.createDataFrame([(1, "x", "h", 1, 1), (2, "a", "h", 1, 1)], known.schema)
    own = spark.createDataFrame([("a", "h", 9, 9)], files.schema)
    assert [tuple(r) for r in S.classify_scan(own, twice).filter("class <> 'missing'").collect()] == [("a", 2, "unchanged")]


def _times(df, function: str) -> int:
    """How often an optimized plan calls a function."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(function + "(")


def test_page_language_splits_a_text_once(spark):
    pages = spark.createDataFrame([(1, 1, "the house and the garden of the king")], "magazine_id long, page_number int, raw_text string")
    assert _times(D.page_language(pages), "regexp_extract_all") == 1
    assert [r["language"] for r in D.page_language(pages).collect()] == ["en"]


def test_what_pages_are_read_by_is_made_once(spark):
    """Language stands in the page's own row, white space goes without a pattern, a title's normal form and a repeated line are looked up once."""
    pages = spark.createDataFrame([(1, 1, "the house and the garden of the king", 7)], "magazine_id long, page_number int, raw_text string, more int")
    out = D.with_language(pages)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in out.collect()] == [(1, 1, "the house and the garden of the king", 7, "en")]
    titles = spark.createDataFrame([("Revue 03-04-2021 n 77", "x")], "v string, c string").repartition(1)
    assert _times(titles.select(X.issue_metadata(F.col("v"), F.col("c")).alias("m")), "translate") == 1
    lines = spark.createDataFrame([(1, p, 1, "Revue ... " + str(p)) for p in range(3)] + [(1, 1, 2, "prose")], "magazine_id long, page_number int, line_no int, line string")
    cleared = D.without_repeated_lines(lines)
    assert "strategy=broadcast" in cleared._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["line"] for r in cleared.collect()) == ["", "", "", "prose"]


def test_white_space_lines_and_headings_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    signs = ["\r", "\n", "\x0b", "\x1c", "\x85", "\u2028", " ", "\t", "\xa0", "\u3000", "\u200b", "\u180e", "a", "é", "7"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(600)] + [None]
    assert one(spark, texts, X.strip(F.col("v"))) == one(spark, texts, F.regexp_replace(F.col("v"), r"(?U)^\s+|\s+$", ""))
    assert one(spark, texts, X.lines(F.col("v"))) == one(spark, texts, F.split(F.col("v"), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1))
    heads = ["".join(rng.choice([w, w.upper(), w.title(), " ".join(w.upper()), "\u0130" + w[1:], w + "x"]) for w in [rng.choice(T.HEADINGS)]) + rng.choice(["", " 3", "é", ".", "  of all that is in this issue"]) for _ in range(300)]
    heads = [rng.choice(["", " ", "\xa0", "("]) + h for h in heads] + [None, ""]
    c = T.collapsed(F.col("v"))
    plain = c.rlike(r"^\p{Lu}") & (F.length(c) <= T.MAX_HEADING) & c.rlike("(?iu)^(?:" + "|".join(T.HEADINGS) + r")(?!\p{L})")
    assert one(spark, heads, T.is_heading(F.col("v"))) == one(spark, heads, plain)
    ends = ["A title ... p. 12", "A title    3-5  ", "Title 12", "A title ..... 12345", "a .... 7 x", "Text … … 8\n", None, "", "12", "LABEL 9"]
    assert one(spark, ends, F.col("v").rlike(T.LAST_DIGIT) & F.col("v").rlike(T.TRAILING)) == one(spark, ends, F.col("v").rlike(T.TRAILING))


def test_snippet_splits_a_text_once_and_marks_are_told_by_one_look(spark):
    texts = spark.createDataFrame([("one two Ete\u0301 three",)], "v string").repartition(1)
    out = texts.select(X.snippet(F.col("v"), "ete", 2).alias("x"))
    assert _times(out, "split") <= 2 and out.first()["x"] == "two Ete\u0301"
    marks = [chr(c) for c in range(0x80, 0x10000) if unicodedata.combining(chr(c))]
    assert one(spark, ["x" + m + "y" for m in marks], X.norm(F.col("v"))) == [X.norm_text("x" + m + "y") for m in marks] == ["xy"] * len(marks)


def test_index_counts_words_within_their_pages(spark):
    """Words are made once, no row for each of them is shuffled, and pages of several rows are one page."""
    docs = spark.createDataFrame([("1-1", 1, "b a b", "T a"), ("2-1", 2, None, "T"), ("3-1", 3, "", None), ("1-1", 1, "b c", "T a")], "page_id string, magazine_id int, raw_text string, magazine_title string")
    index = R.build_inverted_index(docs)
    assert _times(index, "regexp_extract_all") == 2 and "Generate" not in index._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["term"], r["attr"], r["page_id"]): (r["tf"], sorted(r["positions"])) for r in index.collect()}
    assert got == {("b", 0, "1-1"): (3, [0, 0, 2]), ("a", 0, "1-1"): (1, [1]), ("c", 0, "1-1"): (1, [1]), ("t", 1, "1-1"): (2, [0, 0]), ("a", 1, "1-1"): (2, [1, 1]), ("t", 1, "2-1"): (1, [0])}
    assert all(list(r["positions"]) == sorted(r["positions"]) for r in index.collect())


def test_listing_of_many_files_takes_few_tasks(spark, tmp_path):
    S.write_files(spark.range(700).select(F.concat("id", F.lit(".pdf")).alias("path"), F.col("id").cast("string").alias("content")), f"file://{tmp_path}/many")
    listing = S.list_files(spark, f"file://{tmp_path}/many")
    assert S.scan_files(spark, f"file://{tmp_path}/many").rdd.getNumPartitions() > listing.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert listing.columns == ["path", "modificationTime", "length"] and listing.agg(F.count_distinct("path"), F.sum("length")).first()[:] == (700, sum(len(str(i)) for i in range(700)))


def test_a_listing_has_empty_files_and_leaves_the_driver_none(spark, tmp_path):
    """Empty files are files; folders of any depth are listed by tasks, no scan of the plan is over the files, and hidden names stay out."""
    names = {"a.pdf": b"", "x/b 1%.pdf": b"abc", "x/y/z/c.pdf": b"", "x/y/d.pdf": b"d", "x/e.txt": b"no", "_hidden/f.pdf": b"no", ".g.pdf": b"no", "x/é=1/h.pdf": b"hh"}
    for name, content in names.items():
        (tmp_path / "deep" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "deep" / name).write_bytes(content)
    (tmp_path / "deep/none").mkdir()
    listing = S.list_files(spark, f"file://{tmp_path}/deep")
    want = {f"file:{tmp_path}/deep/{n}": c for n, c in names.items() if c != b"no"}
    assert {r["path"]: r["length"] for r in listing.collect()} == {p: len(c) for p, c in want.items()}
    assert "binaryFile" not in listing._jdf.queryExecution().toString() and all("/deep/" not in f for f in listing.inputFiles())
    read = S.scan_files(spark, f"file://{tmp_path}/deep")
    assert {r["path"]: bytes(r["content"]) for r in read.collect()} == want
    times = {r["path"]: r["modificationTime"] for r in read.filter("length > 0").collect()}
    assert {r["path"]: r["modificationTime"] for r in listing.filter("length > 0").collect()} == times
    assert [r["path"].rpartition("/")[2] for r in S.list_files(spark, f"{tmp_path}/deep", "[cd].p?f").orderBy("path").collect()] == ["d.pdf", "c.pdf"]
    with pytest.raises(FileNotFoundError):
        S.list_files(spark, f"file://{tmp_path}/nowhere")


def test_documents_without_text_are_files_of_a_scan(spark, tmp_path):
    """An empty text is a file of no bytes, for s1_scan_files and s3_scan_folder as for their SQL."""
    from pathlib import Path

    import duckdb

    from periodika import plans

    duckdb.sql(f"COPY (SELECT i AS doc_id, CASE WHEN i % 4 = 0 THEN '' WHEN i % 9 = 5 THEN NULL ELSE 'text ' || (i % 20) END AS text, 'en' AS lang, 'src1' AS source, 5 AS n_chars FROM range(60) t(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("part", "events", "customer"):
        (tmp_path / f"{name}.parquet").write_bytes(Path(f"/root/testdata/sf0.001/{name}.parquet").read_bytes())
    for name in ("s1_scan_files", "s3_scan_folder"):
        got, want = plans.QUERIES[name](spark, str(tmp_path)), con.execute(plans.ORACLES[name]).df()
        assert sorted(map(str, got.select(*want.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None))), name


def test_ascii_texts_are_only_lowered(spark):
    texts = [chr(c) + "Aa" for c in range(128)] + ["É" + chr(c) for c in range(128)] + [None]
    assert one(spark, texts, X.norm(F.col("v"))) == [None if t is None else X.norm_text(t) for t in texts]
    assert _times(spark.createDataFrame([("a",)], "v string").repartition(1).select(X.norm(F.col("v")).alias("n")), "octet_length") == 1


def test_variants_are_written_when_they_are_asked_for(spark, tmp_path):
    from periodika.operators.search_store import SearchStore

    schema = "page_id string, magazine_id long, page_number int, raw_text string, magazine_title string"
    store = SearchStore(spark, f"file://{tmp_path}/store", buckets=2, partitions=2)
    store.build(spark.createDataFrame([("1-1", 1, 1, "alpha", "title"), ("2-1", 2, 1, "gamma", "title")], schema))
    store.refresh(spark.createDataFrame([("2-1", 2, 1, "delta", "title")], schema), spark.createDataFrame([(2,)], "magazine_id long"))
    assert not store.files.names("variants")
    want = {tuple(r) for r in R.term_variants(spark.createDataFrame([(t,) for t in ("alpha", "gamma", "delta", "title")], "term string")).collect()}
    assert {tuple(r) for r in store.variants().collect()} == want and store.variants().count() == len(want)
    delta = spark.read.parquet(f"{store.root}/variants/batch=1")
    assert {r["term"] for r in delta.collect()} == {"delta"}


def test_several_files_at_one_path_count_each(spark):
    """Three files of one path (two of equal content) and a copy elsewhere: four rows, each with its own hash."""
    files = spark.createDataFrame([(1, "a", "h1", 1, 1), (2, "a", "h2", 1, 2), (3, "a", "h2", 1, 3), (4, "b", "h1", 1, 4)], "id long, path string, file_hash string, size long, mtime long")
    known = spark.createDataFrame([], files.schema)
    out = S.classify_scan(files.drop("file_hash"), known, hashes=lambda left: left.join(files.select("id", "file_hash"), "id").select("id", "file_hash"), entry="id")
    assert sorted((r["path"], r["class"]) for r in out.collect()) == [("a", "duplicate"), ("a", "new"), ("a", "new"), ("b", "duplicate")]


def test_a_scan_opens_what_has_changed_and_that_once(spark, tmp_path):
    """40 files, of which 3 aren't as they were: three are opened, once each, and no scan of the plan reads contents."""
    root = f"file://{tmp_path}/archive"
    S.write_files(spark.createDataFrame([(f"d{i % 4}/f {i}%.pdf", b"x" * (1 + i)) for i in range(40)], "path string, content binary"), root)
    listing = S.scan_files(spark, root).select(F.element_at(F.split("path", "/archive/"), -1).alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    assert listing.count() == 40
    known = listing.withColumns({"id": F.xxhash64("path"), "file_hash": F.concat(F.lit("h"), F.col("path"))}).withColumn("size", F.when(F.col("path").isin("d0/f 0%.pdf", "d1/f 1%.pdf"), 0).otherwise(F.col("size"))).filter("path <> 'd3/f 3%.pdf'")
    marks = tmp_path / "opened"
    marks.mkdir()

    def opened(at):
        import uuid

        real = S._input(at)

        def one(path):
            (marks / f"{uuid.uuid4().hex}").write_text(path)
            return real(path)

        return one

    out = S.classify_scan(listing, known, hashes=lambda left: S.hash_files(left, root, opened=opened))
    rows = {r["path"]: r["class"] for r in out.collect()}
    out.count()
    assert {p: c for p, c in rows.items() if c != "unchanged"} == {"d0/f 0%.pdf": "modified", "d1/f 1%.pdf": "modified", "d3/f 3%.pdf": "new"} and len(rows) == 40
    assert sorted(m.read_text() for m in marks.iterdir()) == ["d0/f 0%.pdf", "d1/f 1%.pdf", "d3/f 3%.pdf"]
    hashed = S.hash_files(listing.filter("path LIKE 'd0%'").unionByName(spark.createDataFrame([("gone.pdf", 1, 1)], listing.schema)), root).collect()
    import hashlib

    assert {r["path"]: r["file_hash"] for r in hashed} == {f"d0/f {i}%.pdf": hashlib.sha256(b"x" * (1 + i)).hexdigest() for i in range(0, 40, 4)}


def test_files_of_one_hash_are_not_one_task(spark):
    """Equal files: one is new, the others are duplicates, and no window orders them in one task."""
    files = spark.range(500).select(F.format_string("p%03d", "id").alias("path"), F.lit("same").alias("file_hash"), F.lit(0).alias("size"), F.lit(1).alias("mtime"))
    known = spark.createDataFrame([], "id long, path string, file_hash string, size long, mtime long")
    out = S.classify_scan(files, known)
    assert {(r["class"], r["n"]) for r in out.groupBy("class").agg(F.count("*").alias("n")).collect()} == {("new", 1), ("duplicate", 499)}
    assert out.filter("class = 'new'").first()["path"] == "p000" and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_files_logs_and_exports(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/a.pdf").write_bytes(b"abc")
    (tmp_path / "x/b.txt").write_bytes(b"no")
    rows = S.file_hash(S.scan_files(spark, str(tmp_path))).select("path", "length", "file_hash").collect()
    assert len(rows) == 1 and rows[0]["file_hash"].startswith("ba7816bf")
    (tmp_path / "w.log").write_text('{"timestamp": "2024-01-01T10:00:00+02:00", "level": "ERROR", "message": "late"}\nnot json\n{"timestamp": "2024-01-01T09:00:00", "level": "ERROR", "message": "later"}\n{"timestamp": "?", "level": "ERROR", "message": "last"}\n')
    (tmp_path / "api.log.1").write_text('{"timestamp": "2024-01-01T11:00:00", "level": "ERROR", "message": "other", "component": "worker"}\n')
    read = S.read_logs(spark, str(tmp_path / "*.log*"))
    assert [r["message"] for r in S.latest_logs(read, "error", "w").collect()] == ["later", "late", "last"]
    assert [r["message"] for r in S.latest_logs(read, "error", "api").collect()] == ["other"]
    S.write_export_json(spark.range(2), str(tmp_path / "export"))
    assert [r["id"] for r in spark.read.option("multiLine", "true").json(str(tmp_path / "export")).orderBy("id").collect()] == [0, 1]
    S.write_corpus_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_taxonomy_files_are_checked(spark):
    docs = ['{"thematiques": [{"nom": "A", "sous_thematiques": [{"nom": "a", "mots_cles": ["x", " "]}, {"nom": "b", "mots_cles": []}]}]}', "[]", '{"thematiques": []}']
    good, bad = K.parse_taxonomy(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert [(r["theme"], r["subtheme"], r["keywords"]) for r in good.collect()] == [("A", "a", ["x"])]
    assert sorted(r["reason"] for r in bad.collect()) == ["no keyword", "no list of themes", "no list of themes"]


def test_malformed_elements_lose_nothing_else(spark):
    doc = '{"thematiques": ["stray", 3, {"nom": "Énergie", "sous_thematiques": ["x", {"nom": "é", "mots_cles": ["a", {}, null]}]}, {"sous_thematiques": 4}]}'
    good, bad = K.parse_taxonomy(spark.createDataFrame([(doc,)], "value string"))
    assert [(r["theme"], r["subtheme"], r["keywords"][0]) for r in good.collect()] == [("Énergie", "é", "a")]
    assert sorted(r["reason"] for r in bad.collect()) == ["subtheme without name", "theme without name", "theme without name", "theme without name"]
    themes = spark.createDataFrame([(1, "T")], "id int, name string")
    subthemes = spark.createDataFrame([(5, 1, "Energie", ["x"])], "id int, theme_id int, name string, keywords array<string>")
    batch = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "batch_id long, article_id long")
    answer = '["stray", {"article_id": 1, "sous_thematique_id": 5}, {"article_id": "no"}, {"article_id": 2, "nouvelle": {"thematique": " t ", "nom": "ÉNERGIE "}}, {"article_id": 3, "nouvelle": {"thematique": "T", "nom": "Neuf", "mots_cles": ["Vent", "le"]}}]'
    links, created = K.apply_labels(batch, spark.createDataFrame([(0, answer), (1, "no json")], "batch_id long, answer string"), themes, subthemes, spark.createDataFrame([(1, "x")], "id long, title string"))
    assert sorted((r["article_id"], r["subtheme_id"], r["new_key"]) for r in links.collect()) == [(1, 5, None), (2, 5, None), (3, None, "neuf")]
    assert [(r["name"], r["keywords"]) for r in created.collect()] == [("Neuf", ["vent"])]


def test_accents_in_queries_and_snippets(spark):
    docs = spark.createDataFrame([("p1", 1, "la crème_brûlée", "t"), ("p2", 1, "creme", "t"), ("p3", 2, "rien", "t")], "page_id string, magazine_id long, raw_text string, magazine_title string")
    index = R.build_inverted_index(docs)
    found = lambda q: sorted(r["page_id"] for r in R.match_pages(index, q).collect())
    assert found("crème") == found("CREME") == ["p1", "p2"] and found('"creme brulee"') == found("crème_brûlée") == ["p1"]
    text = " ".join(f"mot{i}" for i in range(100)) + " été fini"
    assert one(spark, [text], X.snippet(F.col("v"), ["hiver", "ÉTÉ"], 4)) == ["mot98 mot99 été fini"]


def test_phrases_prefixes_and_typos(spark):
    docs = spark.createDataFrame([("p1", 1, "the red ring of fire", "t"), ("p2", 1, "ring the red", "t"), ("p3", 2, "rings are redder", "t")], "page_id string, magazine_id long, raw_text string, magazine_title string")
    index = R.build_inverted_index(docs)
    found = lambda q, **k: sorted(r["page_id"] for r in R.match_pages(index, q, **k).collect())
    assert found("ring") == ["p1", "p2", "p3"] and found("ring fire") == ["p1"] and found('"red ring"') == ["p1"] and found("nothing") == []
    assert found("rimgs x") == [] and found("rimgs", typos=True) == ["p3"] and found("") == []


def test_pacific_days_across_the_change_of_clocks(spark):
    times = ["2026-03-08 07:59:00", "2026-03-08 08:00:00", "2026-03-09 06:59:00", "2026-03-09 07:00:00", "2026-01-15 12:00:00", "2026-07-15 12:00:00"]
    ts = F.to_timestamp(F.col("v"))
    assert [str(x) for x in one(spark, times, J.pacific_day(ts))] == ["2026-03-07", "2026-03-08", "2026-03-08", "2026-03-09", "2026-01-15", "2026-07-15"]
    got = one(spark, times, F.date_format(J.next_pacific_midnight(ts), "MM-dd HH:mm"))
    assert got == ["03-08 08:00", "03-09 07:00", "03-09 07:00", "03-10 07:00", "01-16 08:00", "07-16 07:00"]


def test_admission(spark, tmp_path):
    import pandas as pd

    rows = [(1, i, pd.Timestamp("2026-01-15 10:00:00") + pd.Timedelta(seconds=i), 10) for i in range(7)] + [(1, 7, pd.Timestamp("2026-01-15 10:01:00"), 10), (1, 8, pd.Timestamp("2026-01-15 10:02:00"), 999), (2, 9, pd.Timestamp("2026-01-15 10:00:00"), 5)]
    rows += [(3, 20 + i, pd.Timestamp("2026-01-15 12:00:00") + pd.Timedelta(minutes=i), 1) for i in range(12)] + [(3, 40, pd.Timestamp("2026-01-16 08:00:00"), 1)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["account", "id", "ts", "tokens"])).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("account long, id long, ts timestamp, tokens long").parquet(str(tmp_path / "in"))
    out = {r["id"]: r for r in J.run_available(spark, J.admit(stream, 5, 100, 12), f"file://{tmp_path}/out").collect()}
    assert [out[i]["admitted"] for i in range(9)] == [True] * 5 + [False, False, True, False]
    assert out[5]["reason"] == "minute" and str(out[5]["until"]) == "2026-01-15 10:01:00" and out[6]["reason"] == "pause" and out[9]["admitted"]
    assert [out[20 + i]["admitted"] for i in range(12)] == [True] * 10 + [False, False] and out[30]["reason"] == "day" and str(out[30]["until"]) == "2026-01-16 08:00:00" and out[40]["admitted"]


def test_late_requests_are_refused(spark, tmp_path):
    import pandas as pd

    at = pd.Timestamp("2026-01-15 10:00:00")
    rows = [(1, 1, at + pd.Timedelta(seconds=61), 1), (1, 2, at + pd.Timedelta(seconds=62), 1)]
    later = [(1, 3, at + pd.Timedelta(seconds=59), 1), (1, 4, at + pd.Timedelta(seconds=63), 1)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, part in enumerate((rows, later)):
        spark.createDataFrame(pd.DataFrame(part, columns=["account", "id", "ts", "tokens"])).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema("account long, id long, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = {r["id"]: (r["admitted"], r["reason"]) for r in J.run_available(spark, J.admit(stream, 2, 100, 12), f"file://{tmp_path}/out").collect()}
    assert out == {1: (True, None), 2: (True, None), 3: (False, "late"), 4: (False, "minute")}


def _hashes(spark, tmp_path, *parts):
    for name, hashes in parts:
        df = spark.createDataFrame([(h,) for h in hashes], "file_hash string").withColumn("ts", F.lit(f"2026-01-{name} 00:00:00").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{name}"))
    return spark.readStream.schema("file_hash string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))


def test_a_run_of_one_name_goes_on_where_it_stopped(spark, tmp_path):
    """The second run reads new files only, late ones too, and no hash comes twice."""
    folder = f"file://{tmp_path}/out"
    stream = _hashes(spark, tmp_path, ("05", ["a", "b"]), ("06", ["b", "c", None]))
    assert {r["file_hash"]: r["batch"] for r in J.dedupe_files(spark, stream, folder, "scan").collect()} == {"a": 0, "b": 0, "c": 1}
    again = J.run_available(spark, stream, folder, name="plain")
    assert again.count() == 5
    stream = _hashes(spark, tmp_path, ("01", ["a", "d"]))
    assert {r["file_hash"]: r["batch"] for r in J.dedupe_files(spark, stream, folder, "scan").collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    seen = []
    assert J.run_available(spark, stream, folder, name="plain", each=lambda b, n: seen.append((n, b.count()))).count() == 7 and seen == [(2, 2)]
    assert J.dedupe_files(spark, stream, folder, "scan").count() == 4  # nothing new, nothing changes


def test_hash_runs_merge_and_batches_can_come_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(HashStore, "MERGED", 3)
    store = HashStore(spark, f"file://{tmp_path}/hashes")
    want = {}
    for n in range(11):
        batch = spark.createDataFrame([(f"{x % 16:x}{x}",) for x in (n, n + 1, 3 * n)], "file_hash string")
        for _ in range(2 if n % 2 else 1):  # odd batches are run twice
            store.add(store.unseen(batch, n), n)
        for x in (n, n + 1, 3 * n):
            want.setdefault(f"{x % 16:x}{x}", n)
    assert store.runs() == [(0, 8), (9, 9), (10, 10)]
    assert {r["file_hash"]: r["batch"] for r in store.table().collect()} == want
    assert {r["file_hash"] for r in store.table(prefixes=["1"]).collect()} == {h for h in want if h[0] == "1"}
    plan = store.table(prefixes=["1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]


DOCUMENTS = "id long, title string, file_path string, file_hash string, extra string"
SUBTHEMES = [(1, ["ring"]), (2, ["bolt"])]


def _documents(*rows):
    """Rows (id, title, hash): what a stream of documents has."""
    return [(i, t, None if t is None else f"Rev/{t}.pdf", h, "x") for i, t, h in rows]


def _pages(spark, ids):
    """Four pages for each document with an id below 90: cover, contents and two of prose."""
    text = F.concat(F.lit("SOMMAIRE\nThe small ring of "), F.col("magazine_id").cast("string"), F.lit(" ..... 3\nAnother great thing ..... 4\nA bolt for the gate ..... 2\n"))
    page = F.array(F.lit("Revue n° 12, mars 1987"), text, F.lit("the ring and the bolt of that are for this"), F.lit(None).cast("string"))
    return ids.filter("magazine_id < 90").select("magazine_id", F.posexplode(page).alias("at", "raw_text")).select("magazine_id", (F.col("at") + 1).alias("page_number"), "raw_text")


def _intake(spark, root):
    return Ingestion(spark, root, lambda ids: _pages(spark, ids), spark.createDataFrame(SUBTHEMES, "id int, keywords array<string>"), fuzzy=False)


def _content(intake, how="current"):
    return {t: sorted((tuple(r) for r in getattr(intake, how)(t).collect()), key=repr) for t in SCHEMAS}


def test_ingestion_from_documents_to_orphans(spark, tmp_path):
    root, arrived = f"file://{tmp_path}/archive", str(tmp_path / "arrived")
    first = _documents((1, "Rev - 70 - Mars 1990", "h1"), (2, "copy", "h1"), (95, "no pages", "h2"), (None, "no id", "h3"), (4, "no hash", None))
    spark.createDataFrame(first, DOCUMENTS).write.parquet(arrived)
    intake = _intake(spark, root)
    intake.run(spark.readStream.schema(DOCUMENTS).parquet(arrived), "intake")
    got = _content(intake)
    assert [(r[0], r[1], r[2], r[4], str(r[5]), r[7]) for r in got["documents"]] == [(1, "h1", "Rev", "70", "1990-03-01", "done"), (95, "h2", "Rev", None, "None", "failed")]
    assert [r[:2] for r in got["pages"]] == [(1, n) for n in range(1, 5)] and got["pages"][2][3] == "en" and got["pages"][3][3] is None
    assert got["contents"] == [(1, "done", None)]
    assert got["articles"] == [(1, "1-1", 1, "A bolt for the gate", 2, 2), (1, "1-2", 2, "The small ring of 1", 3, 3), (1, "1-3", 3, "Another great thing", 4, 4)]
    assert got["links"] == [(1, 1, "1-2"), (1, 2, "1-1")] and got["orphans"] == [(1, "1-3", "Another great thing")]

    # later: a known content under another id, new content of a known id, a cover that says what the title doesn't
    later = _documents((7, "again", "h1"), (1, "new version", "h9"), (8, "Plain title", "h8"))
    spark.createDataFrame(later, DOCUMENTS).write.mode("append").parquet(arrived)
    again = _intake(spark, root)
    again.run(spark.readStream.schema(DOCUMENTS).parquet(arrived), "intake")
    got = _content(again)
    assert [(r[0], r[1], r[4], str(r[5])) for r in got["documents"]] == [(1, "h9", "12", "1987-01-01"), (8, "h8", "12", "1987-01-01"), (95, "h2", None, "None")]
    assert len(got["articles"]) == 6 and len(_content(again, "table")["articles"]) == 9  # the first version is still stored
    before = _content(again, "table")
    again.run(spark.readStream.schema(DOCUMENTS).parquet(arrived), "intake")
    assert _content(again, "table") == before and again.unit.committed() == [0, 1]


def test_a_batch_that_breaks_off_is_taken_in_once(spark, tmp_path, monkeypatch):
    """Failures between two tables, after the hashes and at the commit show nothing; the next run of that name writes the whole batch."""
    arrived, root, clean = str(tmp_path / "arrived"), f"file://{tmp_path}/archive", f"file://{tmp_path}/clean"
    spark.createDataFrame(_documents((1, "Rev - 70 - Mars 1990", "h1"), (2, "Rev - 80", "h2")), DOCUMENTS).write.parquet(arrived)
    stream = lambda: spark.readStream.schema(DOCUMENTS).parquet(arrived)
    for at in (root, clean):
        _intake(spark, at).run(stream(), "intake")
    spark.createDataFrame(_documents((3, "Rev - 90", "h3"), (1, "Rev - 70 - Avril 1990", "h4"), (5, "copy", "h2")), DOCUMENTS).write.mode("append").parquet(arrived)

    real_put, real_add, real_mark = Unit.put, HashStore.add, Files.mark
    for broken in ("links", "hashes", "commit"):

        def put(self, df, name, number, broken=broken):
            if name == broken:
                raise RuntimeError("disk full")
            return real_put(self, df, name, number)

        def add(self, hashes, number, broken=broken):
            real_add(self, hashes, number)
            if broken == "hashes":
                raise RuntimeError("disk full")  # after the hashes are there, before the commit

        def mark(self, name, broken=broken):
            if broken == "commit" and name.startswith("commits"):
                raise RuntimeError("disk full")
            real_mark(self, name)

        with monkeypatch.context() as m:
            m.setattr(Unit, "put", put)
            m.setattr(HashStore, "add", add)
            m.setattr(Files, "mark", mark)
            with pytest.raises(Exception, match="disk full"):
                _intake(spark, root).run(stream(), "intake")
        assert _intake(spark, root).unit.committed() == [0]
        assert {r[0] for r in _intake(spark, root).current("documents").collect()} == {1, 2}
    for at in (root, clean):
        _intake(spark, at).run(stream(), "intake")
    assert _content(_intake(spark, root), "table") == _content(_intake(spark, clean), "table")
    assert _intake(spark, root).unit.committed() == [0, 1]


def test_an_empty_batch_and_texts_in_any_script(spark, tmp_path):
    intake = _intake(spark, f"file://{tmp_path}/archive")
    intake.batch(spark.createDataFrame([], DOCUMENTS), 0)
    assert all(not rows for rows in _content(intake).values()) and intake.unit.committed() == [0]
    words = ["Россий", "Ελλάδα", "한국", "m²", "crème", "ΣΑΣ", "Ｆｕｌｌ", "ﬁn", "Straße", "שָׁלוֹם", "й", "x_y"]
    index = R.build_inverted_index(spark.createDataFrame([(str(i), i, w, "") for i, w in enumerate(words)], "page_id string, magazine_id int, raw_text string, magazine_title string"))
    for i, w in enumerate(words):
        for q in (w, w.upper(), unicodedata.normalize("NFD", w) if w != "한국" else w):
            assert str(i) in {r["page_id"] for r in R.match_pages(index, q).collect()}, q
        assert one(spark, [f"left {w} right"], X.snippet(F.col("v"), w, 2)) == [f"left {w}"]
    assert one(spark, words, X.norm(F.col("v"))) == [X.norm_text(w) for w in words]
    assert [" ".join(t) for t in one(spark, words, X.terms(F.col("v")))] == [" ".join(X.plain_terms(w)) for w in words]


def test_a_stored_search_is_refreshed_in_place(spark, tmp_path, monkeypatch):
    """Changed magazines rewrite their buckets only, the index sees changes at once, and compacting changes nothing but its files."""
    from periodika.operators import search_store

    monkeypatch.setattr(search_store, "MOST_GENERATIONS", 3)
    store = search_store.SearchStore(spark, f"file://{tmp_path}/search", buckets=8, partitions=2)
    schema = "page_id string, magazine_id int, page_number int, raw_text string, magazine_title string"
    pages = {(m, p): f"word{m} common text{p}" for m in range(12) for p in (1, 2)}
    table = lambda rows: spark.createDataFrame([(f"{m}-{p}", m, p, t, f"Title {m}") for (m, p), t in rows.items()], schema)
    changed = lambda *ids: spark.createDataFrame([(i,) for i in ids], "magazine_id int")
    store.build(table(pages))

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "search/documents").rglob("*.parquet")}

    def same():
        rebuilt = R.build_inverted_index(store.documents())
        row = lambda r: (r["term"], r["attr"], r["page_id"], r["tf"], tuple(r["positions"]))
        assert sorted(map(row, store.index().collect())) == sorted(map(row, rebuilt.collect()))
        assert {(r["magazine_id"], r["page_number"]): r["raw_text"] for r in store.documents().collect()} == pages

    same()
    before = files()
    for step, (ids, new) in enumerate([((3,), {(3, 1): "fresh wörd", (3, 7): "more"}), ((5, 40), {(40, 1): "entirely new"}), ((), {}), ((3,), {(3, 1): "fresh again"})]):
        pages = {k: t for k, t in pages.items() if k[0] not in ids} | new
        store.refresh(table(pages | {(0, 1): "not asked for"}), changed(*ids))
        pages = pages | {}
        same()
        if step == 0:
            kept = files()
            bucket = store._bucketed(changed(3)).first()["bucket"]
            assert {p for p in before if before[p] == kept.get(p)} == {p for p in before if f"bucket={bucket}" not in str(p)}
    assert store.unit.committed() == [0, 1, 2, 3, 4, 5] and store._since() == 4  # compacted after three, then one more
    assert {r["page_id"] for r in R.match_pages(store.index(), "comon", typos=True, variants=store.variants()).collect()} == {f"{m}-{p}" for m, p in pages if m not in (3, 40)}
    store.clean()
    assert store.unit.committed() == [4, 5]
    same()
    plan = R.matching_pages(store.index(), "fresh")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "StartsWith(term,fresh)" in plan


def test_generations_are_sorted_runs_and_texts_are_not_shuffled_for_them(spark, tmp_path, monkeypatch):
    """The index of whole pages has no exchange, in runs that are sorted by term; pages of several rows are one page, whatever the join."""
    from periodika.sources import stored as stored_module

    rng = random.Random(3)
    schema = "page_id string, magazine_id int, raw_text string, magazine_title string"
    rows = [(f"{i}-1", i, None if i % 50 == 7 else " ".join(rng.choice(["é", "b", "le", "zoo", "Ωx", f"w{i}"]) for _ in range(rng.randint(0, 60))), None if i % 9 == 4 else f"Title {i % 5}") for i in range(400)]
    row = lambda r: (r["term"], r["attr"], r["page_id"], r["magazine_id"], r["tf"], tuple(r["positions"]))
    for name, extra in (("whole", []), ("repeated", [("3-1", 3, "b zoo", "T"), ("3-1", 3, "b", None), (None, 5, "b", "x"), (None, 5, "b c", "x"), ("4-1", 40, "other", "x")])):
        spark.createDataFrame(rows + extra, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        want = sorted(map(str, map(row, R.build_inverted_index(docs).collect())))
        for most in (stored_module.BROADCAST_ROWS, -1):
            monkeypatch.setattr(stored_module, "BROADCAST_ROWS", most)
            runs = R.index_runs(docs)
            assert sorted(map(str, map(row, runs.collect()))) == want
        if not extra:
            assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
            terms = [r["term"] for r in runs.collect()]
            assert terms == sorted(terms, key=lambda t: t.encode())
        monkeypatch.undo()


def test_a_refresh_stages_no_copy_and_small_files_are_dealt_anew(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from periodika.operators import search_store

    monkeypatch.setattr(search_store, "BUCKET_FILES", 2)
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    kept = {p.name for p in shared.glob("kept-*")}
    schema = "page_id string, magazine_id int, page_number int, raw_text string, magazine_title string"
    pages = {m: f"word{m}" for m in range(40)}
    table = lambda rows: spark.createDataFrame([(f"{m}-1", m, 1, t, "T") for m, t in rows.items()], schema)
    store = search_store.SearchStore(spark, f"file://{tmp_path}/search", buckets=2, partitions=2)
    store.build(table(pages))
    most = 0
    for turn in range(4):
        new = {m: f"turn{turn} of{m}" for m in range(turn, 40, 3)}
        pages |= new
        store.refresh(table(new), spark.createDataFrame([(m,) for m in new], "magazine_id int"))
        assert {r["magazine_id"]: r["raw_text"] for r in store.documents().collect()} == pages and store.documents().count() == 40
        most = max(most, len(list((tmp_path / "search/documents").rglob("*.parquet"))))
    assert {p.name for p in shared.glob("kept-*")} == kept and most <= 3 * 2 * 4  # buckets, their files, and tasks that write one of each
    assert {r["page_id"] for r in R.match_pages(store.index(), "turn3").collect()} == {f"{m}-1" for m in range(3, 40, 3)}


def test_terms_near_a_word_are_those_that_comparing_all_finds(spark):
    rng = random.Random(11)
    letters = "abcdé"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(1500)} | {"x" * n for n in range(36, 46)} | {"ab" * 30}
    words |= {w[:3] + w[4:] for w in list(words)[:300]} | {w[:2] + "z" + w[2:] for w in list(words)[:300]}
    terms = spark.createDataFrame([(w,) for w in sorted(words) if w], "term string")
    variants = R.term_variants(terms).cache()
    asked = ["abcde", "abcdabcd", "abcdabcda", "ab", "x" * 38, "x" * 40, "x" * 42, "aedcbabcde"] + rng.sample(sorted(words), 12)
    got = {(r["i"], r["term"]) for r in R.near_terms(variants, asked).collect()}
    pairs = terms.crossJoin(spark.createDataFrame([(i, w, R._typos(w)) for i, w in enumerate(asked) if R._typos(w)], "i int, w string, d int"))
    assert got == {(r["i"], r["term"]) for r in pairs.filter(F.levenshtein("term", "w") <= F.col("d")).collect()}
    plan = R.near_terms(variants, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_many_near_terms_are_joined(spark, monkeypatch):
    index = R.build_inverted_index(spark.createDataFrame([(str(i), i, w, "") for i, w in enumerate(["magazine", "magazines", "magasine", "other", "magazone paper", "papers"])], "page_id string, magazine_id int, raw_text string, magazine_title string"))
    variants = R.term_variants(index.select("term").distinct())
    want = {r["page_id"] for r in R.match_pages(index, "magazine", typos=True).collect()}
    assert want == {"0", "1", "2", "4"}
    assert {r["page_id"] for r in R.match_pages(index, "magazine", typos=True, variants=variants).collect()} == want
    monkeypatch.setattr(R, "LITERAL_TERMS", 1)
    assert {r["page_id"] for r in R.match_pages(index, "magazine", typos=True, variants=variants).collect()} == want
    assert {r["page_id"] for r in R.match_pages(index, "magazine paper", typos=True, variants=variants).collect()} == {"4"}


def test_ranks_need_no_task_that_holds_all(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("k"), F.format_string("p%05d", "id").alias("page"))
    out = ranks(df, F.desc("k"), F.col("page"))
    got = [(r["k"], r["page"]) for r in out.orderBy("rank").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and sorted(r["rank"] for r in out.collect()) == list(range(1, 3001))
    assert ranks(df.limit(0), F.col("k")).count() == 0
    index = spark.createDataFrame([("a", 0, str(i), i, 1 + i % 3, [0]) for i in range(20)], "term string, attr int, page_id string, magazine_id int, tf long, positions array<int>")
    for limit in (None, 5):
        got = R.match_pages(index, "a", limit=limit)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, (limit or 20) + 1))
    names = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "name string")
    out = S.get_or_create_dimension(names, spark.createDataFrame([(5, "c")], "id int, name string"))
    assert sorted((r["id"], r["name"]) for r in out.collect()) == [(5, "c"), (6, "a"), (7, "b")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def _boxes(page: int, rows: list[list[tuple[float, str]]]) -> list[tuple]:
    """Word boxes of physical lines, each a list of (left edge, text) of its columns; the stored order is that of the lines."""
    out = []
    for line, columns in enumerate(rows):
        for x, text in columns:
            for i, w in enumerate(text.split()):
                out.append((1, page, 0, line, len(out), w, x + 12.0 * i, x + 12.0 * i + 10, 12.0 * line, 12.0 * line + 10))
    return out


def test_two_columns_on_common_lines_are_read_by_columns(spark):
    """Read as stored, two entries on a line become one with a wrong title; by columns all are found, without the running header."""
    left = [f"A tale of number {i} . . . . . {i + 2}" for i in range(6)]
    right = [f"Another story {i} . . . . . {i + 20}" for i in range(6)]
    boxes = _boxes(2, [[(0.0, "SOMMAIRE")], *([(0.0, a), (320.0, b)] for a, b in zip(left, right, strict=True)), [(0.0, "Revue 1 . . . . . 7")]])
    words = spark.createDataFrame(boxes, "magazine_id int, page_number int, block int, line int, n int, text string, x0 double, x1 double, y0 double, y1 double")
    stored_lines = [(1, 2, i + 1, t) for i, t in enumerate(["SOMMAIRE", *(f"{a} {b}" for a, b in zip(left, right, strict=True)), "Revue 1 . . . . . 7"])]
    stored_lines += [(1, p, 1, f"Revue 1 . . . . . {p}") for p in (3, 4, 30)]
    lines = spark.createDataFrame(stored_lines, "magazine_id int, page_number int, line_no int, line string")
    found = T.find_toc_pages(lines, fuzzy=False)
    entries = T.entries_of_readings(words, lines, found, lines)
    counts = {r["strategy"]: r["n"] for r in entries.groupBy("strategy").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 6, 1: 12, 2: 6}
    best = T.best_reading(entries).orderBy("line_no").collect()
    assert [(r["strategy"], r["title"], r["start_page"]) for r in best] == [(1, f"A tale of number {i}", i + 2) for i in range(6)] + [(1, f"Another story {i}", i + 20) for i in range(6)]


def test_blocks_stored_the_wrong_way_round_are_read_by_rows(spark):
    """A title in the left block whose page number stands in the right one, which is stored first."""
    rows = []
    for k in range(4):
        for side, text in ((1, str(3 + k)), (0, f"The story that begins number {'abcd'[k]}")):
            for i, w in enumerate(text.split()):
                rows.append((1, 2, 2 * k + (1 - side), 0, len(rows), w, 320.0 * side + 12 * i, 320.0 * side + 12 * i + 10, 30.0 * k, 30.0 * k + 10))
    words = spark.createDataFrame(rows, "magazine_id int, page_number int, block int, line int, n int, text string, x0 double, x1 double, y0 double, y1 double")
    read = {s: [r["line"] for r in T.readings(words).filter(F.col("strategy") == s).orderBy("line_no").collect()] for s in range(3)}
    assert read[0][:2] == ["3", "The story that begins number a"] and read[2][:2] == ["The story that begins number a", "3"]
    assert read[1] == [f"The story that begins number {c}" for c in "abcd"] + ["3", "4", "5", "6"]


def test_progress_is_forgotten(spark, tmp_path):
    """State ends on completion, and an hour of event time after the last update."""
    import pandas as pd

    at = pd.Timestamp("2026-01-15 10:00:00")
    parts = [
        [(1, 1, at, 3, 10), (1, 2, at + pd.Timedelta(minutes=1), 4, 10), (2, 3, at, 10, 10), (3, 4, at, 1, 10)],
        [(1, 5, at - pd.Timedelta(minutes=5), 2, 10), (3, 6, at + pd.Timedelta(minutes=30), 2, 10)],
        [(4, 7, at + pd.Timedelta(minutes=75), 9, 9)],  # the watermark passes 11:01, not 11:30
        [(5, 8, at + pd.Timedelta(hours=5), 9, 9)],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, seen, states = "document long, id long, ts timestamp, current long, total long", [], []
    for i, part in enumerate(parts):
        spark.createDataFrame(pd.DataFrame(part, columns=["document", "id", "ts", "current", "total"])).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    J.run_available(spark, J.progress_stream(stream), f"file://{tmp_path}/out", "update", each=lambda b, n: seen.append(sorted((r["document"], r["current"], r["state"]) for r in b.collect())), told=states.append)
    assert seen[0] == [(1, 4, "running"), (2, 10, "done"), (3, 1, "running")] and seen[1] == [(3, 2, "running")]
    assert [x for s in seen[2:] for x in s] == [(4, 9, "done"), (1, 4, "forgotten"), (5, 9, "done"), (3, 2, "forgotten")]
    assert states[0][-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_late_rows_are_counted_over_restarts(spark, tmp_path):
    """Two runs of one name; the windowed job keeps what is counted as kept, at least."""
    import pandas as pd

    at, folder = pd.Timestamp("2026-01-15 10:00:00"), f"file://{tmp_path}/out"
    minutes = [[0, 1, 30], [5, 21, 40, None], [5, 29, 31, 90], [200, 100, 79]]
    want, last = {}, None
    for i, part in enumerate(minutes):
        late = sum(1 for m in part if m is not None and last is not None and m + 1 <= last - 10)
        want[i] = (len(part), len([m for m in part if m is not None]) - late, late)
        last = max([m for m in part if m is not None] + ([last] if last is not None else []))
    for i, part in enumerate(minutes):
        rows = [(None if m is None else (at + pd.Timedelta(minutes=m)).to_pydatetime(), 1) for m in part]
        spark.createDataFrame(rows, "ts timestamp, account long").withColumn("tokens", F.lit(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, account long, tokens int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if i % 2:
            counts = J.count_late(spark, stream, folder, "counted")
            windows = J.run_available(spark, J.rate_windows(stream), folder, name="windows")
    assert {r["batch"]: (r["rows"], r["kept"], r["late"]) for r in counts.collect()} == want
    ended = 200 - 10
    still_open = sum(1 for p in minutes for m in p if m is not None and m + 1 > ended)
    kept, late = (sum(x[i] for x in want.values()) for i in (1, 2))
    assert kept - still_open <= windows.agg(F.sum("requests")).first()[0] <= kept + late - still_open


def _quota(rows, per_minute, tokens_a_minute, per_day, state=None):
    """The contract of admission, row by row, for one account."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    minute, requests, tokens, day, today, pause = state or (-1, 0, 0, None, 0, datetime(1970, 1, 1))
    out = {}
    for id, ts, cost in rows:
        m, local = int(ts.replace(tzinfo=timezone.utc).timestamp()) // 60, ts.replace(tzinfo=timezone.utc).astimezone(ZoneInfo("America/Los_Angeles"))
        if m < minute:
            out[id] = (False, "late", None)
            continue
        if m != minute:
            minute, requests, tokens = m, 0, 0
        if local.date() != day:
            day, today = local.date(), 0
        reason = "pause" if ts < pause else "day" if today >= per_day - 2 else "minute" if requests >= per_minute or tokens + cost > tokens_a_minute else None
        if reason is None:
            requests, tokens, today = requests + 1, tokens + cost, today + 1
        elif reason == "day":
            pause = (datetime(day.year, day.month, day.day) + timedelta(days=1)).replace(tzinfo=ZoneInfo("America/Los_Angeles")).astimezone(timezone.utc).replace(tzinfo=None)
        elif reason == "minute":
            pause = ts.replace(second=0, microsecond=0) + timedelta(minutes=1)
        out[id] = (reason is None, reason, pause if reason else None)
    return out, (minute, requests, tokens, day, today, pause)


def test_admission_of_a_hot_account_in_bounded_memory(spark, tmp_path):
    """300 000 requests of one account in one micro-batch go through a task Arrow batch by Arrow batch; a second run goes on with its counters."""
    from datetime import datetime, timedelta

    n, folder = 300_000, f"file://{tmp_path}/out"
    at = F.timestamp_micros(F.lit(1_768_400_000_000_000) + F.col("id") * 1_300_000)
    hot = spark.range(n).select(F.lit(7).cast("long").alias("account"), "id", at.alias("ts"), (F.col("id") % 90).alias("tokens"))
    few = spark.range(200).select((F.col("id") % 5 + 100).alias("account"), (F.col("id") + 1_000_000).alias("id"), at.alias("ts"), F.lit(10).cast("long").alias("tokens"))
    hot.unionByName(few).orderBy(F.rand(3)).coalesce(1).write.parquet(str(tmp_path / "in0"))
    stream = lambda: spark.readStream.schema("account long, id long, ts timestamp, tokens long").parquet(str(tmp_path / "in*"))
    J.admit_batches(spark, stream(), folder, "quota", 20, 800, 15_000)
    end = 1_768_400_000 + int(n * 1.3)
    more = [(7, 2_000_000 + i, datetime(1970, 1, 1) + timedelta(seconds=end + x), 30) for i, x in enumerate([-500, 0, 1, 2, 100])] + [(None, 1, datetime(2026, 1, 20), 1), (7, 2, None, 1)]
    spark.createDataFrame(more, "account long, id long, ts timestamp, tokens long").coalesce(1).write.parquet(str(tmp_path / "in1"))
    out = J.admit_batches(spark, stream(), folder, "quota", 20, 800, 15_000)
    got = {(r["account"], r["id"]): (r["admitted"], r["reason"], r["until"]) for r in out.collect()}
    first = [(i, datetime(1970, 1, 1) + timedelta(microseconds=1_768_400_000_000_000 + i * 1_300_000), i % 90) for i in range(n)]
    want, state = _quota(first, 20, 800, 15_000)
    again, _ = _quota([(i, t, c) for _, i, t, c in more[:5]], 20, 800, 15_000, state)
    assert {i: v for (a, i), v in got.items() if a == 7} == want | again and len(got) == n + 205
    assert {v[1] for v in want.values()} == {None, "minute", "pause", "day"} and again[2_000_000][1] == "late"

    frames = []  # what a task holds at a time
    run = J._decided(20, 800, 15_000)
    sorted_rows = [[(7, i, 1_768_400_000_000_000 + i, 1, 1, 1, None, None, None, None, None, None) for i in range(k, k + 1000)] for k in range(0, 10_000, 1000)]
    import pyarrow as pa

    def batches():
        for rows in sorted_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f"c{i}" for i in range(12)])

    for b in run(batches()):
        frames.append(b.num_rows)
    assert frames == [1000] * 10 + [1]
