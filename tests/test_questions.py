"""Many questions against a catalogue: matches, searches and answer contexts against one question at a time."""

from __future__ import annotations

import datetime
import random
import re


from tessera.operators import profiles as A
from tessera.operators import questions as Q

FILLERS = {"in", "of", "for", "and", "the", "a", "an", "to", "on"}


def short(name):
    s = "".join(w[0].lower() for w in re.findall("[A-Za-z]+", name) if w.lower() not in FILLERS)
    return {s[:k] for k in range(3, 7) if k <= len(s)}


def words(text):
    return {t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) > 1 and t not in A.QUESTION_WORDS and not re.match("^(19|20)[0-9]{2}$", t)}


def catalogue(r, n):
    pool = ["Graduate", "Aptitude", "Test", "in", "Engineering", "Civil", "Services", "2026", "2027", "Bank", "Officer", "of", "Medical", "GATE", "Clerk"]
    return [(i, " ".join(r.choice(pool) for _ in range(r.randrange(1, 6))), r.choice([None, "", "civil posts", "a bank test", "nursing"])) for i in range(n)]


def test_matched(spark):
    r = random.Random(2)
    items = catalogue(r, 120)
    pool = ["graduate", "test", "gat", "gate", "bank", "posts", "nursing", "the", "2026", "engineering", "civil", "services", "unknown", "csb"]
    asked = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(7)))) for i in range(80)] + [(100, None), (101, "  "), (5, "bank clerk bank"), (5, "bank clerk bank")]
    want = []
    for key, message in asked:
        scored = []
        for i, name, told in items:
            n = len(words(message) & (words(name) | short(name))) or int(bool(words(message) & words(told)))
            if n:
                scored.append((-n, name, i))
        want += [(key, i, name, -n, k + 1) for k, (n, name, i) in enumerate(sorted(scored)[:3])]
    docs = spark.createDataFrame(items, "item long, name string, told string").repartition(4)
    got = Q.matched(spark.createDataFrame(asked, "id long, message string").repartition(3), "id", "message", docs, "item", "name", "told")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert Q.matched(spark.createDataFrame([], "id long, message string"), "id", "message", docs, "item", "name", "told").count() == 0


def test_searched(spark):
    r = random.Random(7)
    items = [(i, name, f"{name} {told or ''} R&D+") for i, name, told in catalogue(r, 90)] + [(500, None, None)]
    pool = ["grad", "te", "a", "gat", "bank", "posts", "civ serv", "&d+", "+", "graduate aptitude", "x", "ati", "NG", "zzz"]
    asked = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(1, 4)))) for i in range(70)] + [(100, None), (101, " "), (3, "bank")]
    want = []
    for key, message in asked:
        q = (message or "").strip().lower()
        tokens = re.findall("[a-z0-9]+", q)
        for i, name, text in items:
            hay = (text or "").lower()
            if q and (q in hay or (tokens and all(t in hay or t in short(name or "") for t in tokens))):
                want.append((key, i))
    docs = spark.createDataFrame(items, "item long, name string, hay string").repartition(4)
    got = Q.searched(spark.createDataFrame(asked, "id long, message string"), "id", "message", docs, "item", "name", "hay")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_contexts(spark):
    day = datetime.date
    exams = spark.createDataFrame([(1, "Civil Services", "UG", "posts", "https://x"), (2, "Bank Clerk", "PG", None, None), (3, "Bank Officer", None, "", None)], "exam_id long, name string, type string, description string, url string")
    notices = [(10, 1, "old", None, None, None, None, "APPROVED"), (11, 1, "new", day(2026, 1, 2), day(2026, 2, 1), None, "short", "APPROVED"), (12, 1, "draft", day(2027, 1, 1), None, None, None, "PENDING")]
    notices += [(20, 2, "b", None, None, None, None, "APPROVED"), (21, 2, "b2", None, None, None, None, "APPROVED")]
    notices = spark.createDataFrame(notices, "notification_id long, exam_id long, title string, release_date date, application_start_date date, application_end_date date, summary string, approval_status string")
    dates = spark.createDataFrame([(1, 11, day(2026, 5, 2), day(2026, 5, 3)), (2, 11, day(2026, 5, 1), day(2026, 5, 1))], "exam_date_id long, notification_id long, start_date date, end_date date")
    groups = spark.createDataFrame([(11, 1, None, 1, "AND"), (11, 2, 1, 1, "OR"), (21, 3, None, 1, "AND")], "notice long, group_id long, parent_group_id long, group_number int, logical_operator string")
    rules = spark.createDataFrame([(1, 1, "CGPA", ">=", "7", "numeric"), (2, 2, "State", "=", "Kerala", "text"), (3, 2, "State", "=", "Goa", "text"), (4, 3, "Height", "=", "1", "text")], "rule_id long, group_id long, attribute string, operator string, value string, data_type string")
    people = spark.createDataFrame([(7, {"cgpa": "8", "state": "Goa"}, [])], "student_id long, facts map<string,string>, work array<string>")
    flags = spark.createDataFrame([(7, True, False, True, False)], "student_id long, has_date_of_birth boolean, has_nationality boolean, has_state boolean, has_academics boolean")
    asked = spark.createDataFrame([(1, 7, "when is civil services"), (2, None, "civil"), (3, 7, "bank"), (4, 8, " "), (5, 9, "zoo")], "question_id long, student_id long, message string")
    got = {x.question_id: x for x in Q.answer_contexts(asked, exams, notices, dates, groups, rules, people, flags).collect()}
    facts = "EXAM: Civil Services\nType: UG\nDescription: posts\nOfficial page: https://x\nLatest official notification: new\nNotification release date: 2026-01-02\nApplication start date: 2026-02-01\n"
    facts += "Exam date window: 2026-05-01 to 2026-05-01\nExam date window: 2026-05-02 to 2026-05-03\nNotification summary: short\nEligibility rules:\n- (AND) CGPA >= 7\n  - (OR) State = Kerala OR State = Goa"
    assert got[2].details == facts and got[2].profile == "" and got[2].grounded
    assert got[1].details == facts + "\nThis student's computed eligibility: ELIGIBLE. Reasons: All applicable eligibility requirements were satisfied."
    assert got[1].profile == "STUDENT PROFILE STATUS: date of birth saved; nationality not saved; state saved; academic details not added."
    assert [s.name for s in got[3].sources] == ["Bank Clerk", "Bank Officer"]
    assert got[3].details.split("\n\n")[0].endswith("Latest official notification: b\nEligibility rules:\n- (AND) Height = 1")
    assert got[3].details.split("\n\n")[1].startswith("EXAM: Bank Officer\nNo approved official notification")
    assert (got[4].grounded, got[5].grounded, got[5].details, got[5].sources) == (False, False, "", [])


def test_rule_lines_of_an_empty_tree(spark):
    groups = spark.createDataFrame([(1, 1, None, 1, "AND")], "notice long, group_id long, parent_group_id long, group_number int, logical_operator string")
    rules = spark.createDataFrame([], "rule_id long, group_id long, attribute string, operator string, value string")
    assert Q.rule_lines(groups, rules).count() == 0


def test_a_search_finds_every_copy_and_looks_once(spark):
    items = spark.createDataFrame([(i, "steel pin", "steel pin big") for i in range(50)] + [(50, "brass pin", "brass pin")], "item long, name string, text string")
    asked = spark.createDataFrame([("a", "eel"), ("b", "pin brass"), ("c", "pin")], "k string, message string")
    found = Q.searched(asked, "k", "message", items, "item", "name", "text")
    assert sorted(map(tuple, found.collect())) == sorted([("a", i) for i in range(50)] + [("b", 50)] + [("c", i) for i in range(51)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_id" in plan  # pairs are made of different texts
