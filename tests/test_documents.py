"""Documents, changes and retrieval: round trips and plain versions."""

from __future__ import annotations

import re
import string

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import changes as C
from tessera.operators import documents as D
from tessera.operators import mutations as M
from tessera.operators import retrieval as R
from tessera.plans.catalogue import QUERIES

TEXT = st.text(alphabet=string.ascii_letters + " \n😀é", max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 9))
def test_page_chunks_lose_nothing(spark, pages, size):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "d long, p int, t string")
    found = D.page_chunks(rows, "d", "p", "t", size).orderBy("chunk_no").collect()
    whole = "".join(pages)
    assert "".join(x.chunk for x in found) == whole
    assert all(len(x.chunk) == size for x in found[:-1])


def test_packed_paragraphs(spark):
    text = "aa\nbb\n\n  \ncccccc\ndd\nee"
    got = spark.range(1).select(D.packed_paragraphs(F.lit(text), 6).alias("x")).first()["x"]
    assert got == ["aa\nbb", "cccccc", "dd\nee"]


def test_contents_page(spark):
    toc = "\n".join(f"Chapter {i} ....... {i}" for i in range(6))
    check = lambda t: spark.range(1).select(D.is_contents_page(F.lit(t)).alias("x")).first()["x"]
    assert check(toc) and not check("just a line\nand another")


def test_gate(spark):
    word = "minimum age and qualification " * 20
    cases = {"": (True, "no text"), "short": (False, "too short"), "Admit card " + word: (False, "admit card"), "x" * 400: (False, "no eligibility wording"), word: (True, "ok"), word + " 2026": (False, "year 2026 instead of 2027")}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = rows.select("t", D.gate(F.col("t"), ["minimum age", "qualification"], [("admit card", "admit card")], F.lit("2027")).alias("g")).collect()
    assert {x.t: (x.g.ok, x.g.reason) for x in got} == cases


def test_heading_dedupe_depends_on_what_was_kept(spark):
    rows = spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate([("A", 1), ("a", 2), ("A", 3), ("B", 3), ("A", 4)])], "d long, i int, t string, p long")
    got = D.dedupe_headings(rows, "d", "i", "t", F.col("p"), 5, 1).orderBy("i").collect()
    assert [x.i for x in got] == [0, 2, 3]


def test_heading_shapes(spark):
    rows = spark.createDataFrame([("1. Eligibility criteria",), ("ELIGIBILITY CRITERIA",), ("and so it went on and on until it was at last over for all of them.",), ("B1.2",), ("Section 2",)], "t string")
    got = {x.t: (x.c, x.n) for x in rows.select("t", D.heading_confidence(F.col("t"), F.lit(False)).alias("c"), D.is_noise(F.col("t"), ["INDEX"]).alias("n")).collect()}
    assert [got[x] for x in ("1. Eligibility criteria", "ELIGIBILITY CRITERIA")] == [(0.65, False), (0.4, False)]
    assert got["B1.2"][1] and got["Section 2"][1] and got["and so it went on and on until it was at last over for all of them."][0] == 0.0


def test_document_links(spark):
    score = lambda u, t: spark.range(1).select(D.document_link_score(F.lit(u), F.lit(t), ["gate"], ["2027"]).alias("x")).first()["x"]
    assert score("https://h.org/gate/2027/notification.pdf", "") == 5 + 7 + 4 + 5
    assert score("https://h.org/gate.pdf", "brochure 2026") == 5 + 7 + 4 - 8
    assert score("https://h.org/gate/2026/notification.pdf", "") == score("https://h.org/x.pdf", "") == score("https://h.org/gate_answer_key.pdf", "") == -100
    assert score("https://h.org/gate-answer-key.pdf", "") == 9  # only the listed spellings reject
    best = spark.range(1).select(D.source_score(F.lit("Official notification"), F.lit(None).cast("string"), F.lit("upsc.gov.in")).alias("x")).first()["x"]
    assert best == 12 + 10 + 8 + 8


def test_nested_json(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "d": null, "e": []}'), (2, "no json")], "k long, j string")
    got = {(x.k, x.path, x.value) for x in C.flatten_json(rows, "k", "j").collect()}
    assert got == {(1, "a.b[0]", "1"), (1, "a.b[1].c", '"x"')}


def test_get_or_create_numbers_without_gaps(spark):
    known = spark.createDataFrame([("a", 7)], "key string, id long")
    wanted = spark.createDataFrame([(c,) for c in "abcdefgh"], "key string")
    got = {x.key: (x.id, x.created) for x in M.get_or_create(known, wanted, "key", "id").collect()}
    assert got == {"a": (7, False)} | {c: (8 + i, True) for i, c in enumerate("bcdefgh")}


def plain_pack(rows, budget):
    """rows: i -> (section, score, text) of one document."""
    cost = {i: -(-len(t) // 3) + 4 for i, (_, _, t) in rows.items()}
    order = sorted(rows, key=lambda i: (-rows[i][1], i))
    chosen, used = [], 0
    for i in order:
        if rows[i][1] < 0.25 * rows[order[0]][1] or rows[order[0]][1] <= 0:
            break
        if used + cost[i] <= budget:
            chosen.append(i)
            used += cost[i]
    by_place = sorted(rows)
    for i in list(chosen):
        k = by_place.index(i)
        for j in by_place[max(0, k - 1) : k] + by_place[k + 1 : k + 2]:
            if j not in chosen and rows[j][0] == rows[i][0] and rows[j][1] > 0 and used + cost[j] <= budget:
                chosen.append(j)
                used += cost[j]
    return {i: cost[i] for i in chosen}


def test_packs_of_many_documents(spark):
    """Gaps in the numbers, ranges' borders, ties, documents without a score, passages larger than the budget."""
    import random

    r = random.Random(6)
    docs = {}
    for d in range(25):
        places = r.sample(range(4000, 12_500, r.choice([1, 4, 700])), r.choice([1, 3, 9]) if d % 5 else 12)
        docs[d] = {i: (f"sec{i // 3000}", float(r.choice([0, 0.1, 1, 2, 5, 8]) if d != 7 else 0), "w" * r.choice([0, 3, 30, 90, 200, 900])) for i in places}
    rows = [(d, i, *x) for d, own in docs.items() for i, x in own.items()]
    scored = spark.createDataFrame(rows, "doc long, i long, sec string, score double, text string").repartition(5)
    for budget in (40, 150, 2000):
        got = {(x.doc, x.i): x.tokens for x in R.pack(scored, "doc", "i", "sec", "text", budget).collect()}
        assert got == {(d, i): c for d, own in docs.items() for i, c in plain_pack(own, budget).items()}


def test_pack_equals_plain_version(spark):
    rows = [("s", i, f"sec{i // 3}", float((i * 7) % 11), "word " * (3 + (i * 5) % 17)) for i in range(30)]
    scored = spark.createDataFrame(rows, "doc string, i long, sec string, score double, text string")
    got = {x.i for x in R.pack(scored, "doc", "i", "sec", "text", 200).collect()}
    cost = {i: -(-len(t) // 3) + 4 for _, i, _, _, t in rows}
    score, sec = {r[1]: r[3] for r in rows}, {r[1]: r[2] for r in rows}
    chosen, used = [], 0
    order = sorted(score, key=lambda i: (-score[i], i))
    for i in order:
        if score[i] < 0.25 * score[order[0]]:
            break
        if used + cost[i] <= 200:
            chosen.append(i)
            used += cost[i]
    for i in list(chosen):
        for j in (i - 1, i + 1):
            if j in score and j not in chosen and sec[j] == sec[i] and score[j] > 0 and used + cost[j] <= 200:
                chosen.append(j)
                used += cost[j]
    assert got == set(chosen)


def test_quotes(spark):
    page = "Application Portal closing | Sunday, September 27, 2026"
    quotes = spark.createDataFrame([(1, 1, "September 27, 2026"), (1, 2, "application portal closing sunday"), (1, 3, "Applications close on 5 November")], "doc long, q long, quote string")
    passages = spark.createDataFrame([(1, 0, page)], "doc long, p long, text string")
    got = {x.q: x.exact for x in R.locate_quotes(quotes, passages, "q", "quote", "doc", "p", "text").collect()}
    assert got.keys() == {1, 2} and got[1]


def test_links(spark):
    html = '<a href="/a.pdf">One</a><a href="javascript:x()">no</a><a href="#t">no</a><a HREF=\'https://o.org/b\'>Two <b>x</b></a><a href="/a.pdf">One longer</a><a href="http://o.org/c">plain</a>'
    rows = spark.createDataFrame([(1, "https://h.org/dir/page", html)], "k long, u string, h string")
    got = {(x.link, x.ord, x.label) for x in D.links(rows, "k", "u", "h").collect()}
    assert got == {("https://h.org/a.pdf", 0, "One"), ("https://o.org/b", 3, "Twox")}
    assert re.match("https", next(iter(got))[0]) and isinstance(rows.toPandas(), pd.DataFrame)


def test_merge_scalar_sees_late_turns(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (2, 5, "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: (x.merged, x.conflict) for x in QUERIES["merge_scalar"](spark, str(tmp_path)).collect()}
    assert got == {1: ("a", True), 2: ("c", False)}


def test_excerpts_keep_short_and_repeating_texts(spark, tmp_path):
    line = "".join(chr(97 + i * i % 23) for i in range(60))
    again = "x" * 99 + line + "y" * 140 + line + "z" * 300  # what stands at character 300 stands at 100 first
    docs = {1: "short", 2: "", 3: again, 4: "x" * 299 + line + "z" * 300}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.part for x in QUERIES["excerpts"](spark, str(tmp_path)).collect()}
    assert got == {1: "short", 2: "", 3: again[49:149], 4: docs[4][249:349]}


def test_quote_candidates_lose_no_find(spark):
    words = "the cat sat on a mat while seven other dogs ran round and round it until night came over them all".split()
    docs = {0: " ".join(words), 1: "bobcat saturated", 2: " ".join(words[:18] + ["x", "y"]), 3: "The CAT, sat!", 4: "none of it", 5: "onthe cat satyr"}
    quotes = {30: " ".join(words), 31: "cat sat", 32: "the cat sat", 33: "none", 34: " ".join(words[2:9]), 35: "abc"}
    d = spark.createDataFrame(list(docs.items()), "doc long, text string")
    q = spark.createDataFrame(list(quotes.items()), "q long, quote string")
    locate = lambda pairs: {(x.doc, x.q, x.exact) for x in R.locate_quotes(pairs, d.withColumn("p", F.lit(0).cast("long")), "q", "quote", "doc", "p", "text").collect()}
    whole = locate(q.crossJoin(d.select("doc")))
    assert locate(R.quote_candidates(q, d, "q", "quote", "doc", "text")) == whole
    assert {(1, 31, True), (5, 32, True), (4, 33, True), (2, 30, False)} <= whole


def test_section_passages(spark):
    """Headings on four levels, a table that is cut with its header, page borders, a contents page."""
    rows_ = ["row %02d of a wide table" % i for i in range(6)]
    pages = [
        (1, 1, "before any heading\n# Rules\nfirst\n## Age\nsecond\n### Upper\nthird\n## Fees\nfourth"),
        (1, 2, "\n".join(f"entry {i} ...... {i}" for i in range(8))),
        (1, 3, "still fees\n[TABLE]\n# head | of table\n" + "\n".join(rows_) + "\n[/TABLE]\nafter"),
        (1, 4, "# Next\n#### Deep\n" + "x" * 70 + "\n" + "y" * 70 + "\nz"),
        (2, 1, "   "),
        (3, 1, "only"),
    ]
    got = R.section_passages(spark.createDataFrame(pages, "doc long, page long, text string").repartition(3), "doc", "page", "text", size=60)
    found = [(r.doc, r.passage, r.page, r.section, r.is_table, r.text) for r in got.orderBy("doc", "passage").collect()]
    head = "# head | of table"
    assert found == [
        (1, 0, 1, "Document", False, "before any heading"), (1, 1, 1, "Rules", False, "first"), (1, 2, 1, "Rules > Age", False, "second"),
        (1, 3, 1, "Rules > Age > Upper", False, "third"), (1, 4, 1, "Rules > Fees", False, "fourth"), (1, 5, 3, "Rules > Fees", False, "still fees"),
        (1, 6, 3, "Rules > Fees", True, "\n".join([head, *rows_[:4]])), (1, 7, 3, "Rules > Fees", True, "\n".join([head, *rows_[4:]])),
        (1, 8, 3, "Rules > Fees", False, "after"), (1, 9, 4, "Next > Deep", False, "x" * 70), (1, 10, 4, "Next > Deep", False, "y" * 70), (1, 11, 4, "Next > Deep", False, "z"),
        (3, 0, 1, "Document", False, "only"),
    ]


def test_cited_passage_first(spark):
    passages = spark.createDataFrame([(1, 0, "the same words here"), (1, 1, "the same words here"), (1, 2, "other")], "doc long, passage long, text string")
    quotes = spark.createDataFrame([(1, 7, "same words", 1), (1, 8, "same words", None), (1, 9, "same words", 2)], "doc long, q long, quote string, cited long")
    found = R.locate_quotes(quotes, passages, "q", "quote", "doc", "passage", "text", cited="cited")
    assert {r.q: r.passage for r in found.collect()} == {7: 1, 8: 0, 9: 0}


def test_candidates_of_short_quotes(spark):
    """Quotes of one and two words meet only documents that have their rarest piece, and lose none that has them."""
    texts = ["alpha beta gamma", "alphabet soup", "Beta, alpha!", "gamma rays here", "nothing", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    quotes = spark.createDataFrame([(1, "alpha"), (2, "Beta gamma"), (3, "unseen"), (4, "abc"), (5, "the gamma rays here now")], "q long, quote string")
    pairs = R.quote_candidates(quotes, docs, "q", "quote", "doc", "text")
    found = R.locate_quotes(pairs, docs.withColumn("p", F.lit(0).cast("long")), "q", "quote", "doc", "p", "text")
    assert {(x.q, x.doc) for x in found.where("exact").collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert (3, 0) not in {(x.q, x.doc) for x in pairs.collect()}
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_sections_and_latch_inside_a_row(spark):
    docs = {1: "before\nH one\na\nb\nH two", 2: "H first\nx", 3: "none", 4: "", 5: None, 6: "H a\nH b\n\nc"}
    rows = spark.createDataFrame(list(docs.items()), "d long, t string")
    found = D.sections(rows, "d", "t", lambda x: x.startswith("H"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, 0, None, "before"), (1, 1, "H one", "a\nb"), (1, 2, "H two", ""), (2, 1, "H first", "x"), (3, 0, None, "none"), (4, 0, None, ""), (6, 1, "H a", ""), (6, 2, "H b", "\nc")], key=str
    )
    latch = D.from_keyword_on(rows, "d", "t", "^H (one|b)")
    assert sorted(map(tuple, latch.collect())) == [(1, 1, "H one"), (1, 2, "a"), (1, 3, "b"), (1, 4, "H two"), (6, 1, "H b"), (6, 2, ""), (6, 3, "c")]
    for df in (found, latch):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_words_end_where_sql_ends_them(spark, tmp_path):
    from tessera.plans.documents import gate, section_scores

    texts = ["x der undä " + "and the que " * 40, "nheit vonächü " + "and the que " * 40, "a vonnn " + "and the que " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["score"] for r in section_scores(spark, str(tmp_path)).collect()} == {0: 2.0, 1: 4.5, 2: 4.5}
    assert {r["doc_id"]: r["reason"] for r in gate(spark, str(tmp_path)).collect()} == {0: "ok", 1: "other kind", 2: "ok"}


def test_json_opens_in_one_pass(spark):
    texts = ['{"a": {"b": {"c": {"d": {"e": {"f": {"g": [1]}}}}}}, "x": [[], {}, [2, null]], "": 3}', "[]", "{}", "7", '["y"]', "null", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, j string")
    found = C.flatten_json(rows, "k", "j")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # read and parsed once
    got = {(x.k, x.path, x.value) for x in found.collect()}
    assert got == {(0, "a.b.c.d.e.f", '{"g":[1]}'), (0, "x[2][0]", "2"), (0, "", "3"), (3, "", "7"), (4, "[0]", '"y"')}


def test_a_links_text_is_made_once(spark):
    links = spark.createDataFrame([("https://h.org/a.pdf", "Gate notice")], "u string, t string").select(D.document_link_score(F.upper("u"), F.upper("t"), ["gate"], []).alias("x"))
    assert links._jdf.queryExecution().optimizedPlan().toString().count("upper(u") == 1  # not for every word looked for
    assert links.first()["x"] == 5 + 4 + 1
