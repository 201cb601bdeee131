import re

from hydrolens.llm import license_scan
from hydrolens.llm.license_scan import NOTICES, PHRASES, Notice, Scanner
from hydrolens.llm.queries import op2_license_notices
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import nothing, odd


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_query_equals_brute_force(spark, sf_dir):
    notices = [Notice(text, label) for text, label in NOTICES.items()]
    expected = []
    for doc in table(spark, sf_dir, "documents").collect():
        own = words(doc.text)
        places = [
            (i, label) for text, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(text.split())] == text.split()
        ]
        joined = " ".join(own).encode()
        fuzzy = {n.label for n in notices if n.matcher.search(joined)}
        starts, base = [i for i, _ in places], {label for _, label in places}
        bounds = (min(starts), max(starts)) if starts else (None, None)
        expected.append((doc.doc_id, len(own), len(places), *bounds, ",".join(sorted(base)), ",".join(sorted(base | fuzzy))))
    found = op2_license_notices(spark, sf_dir)
    assert any(row[2] for row in expected)
    assert rows(found, *[c for c in found.columns if c != "score"]) == sorted(expected, key=repr)


def test_errors_are_bounded():
    scan = Scanner(PHRASES, NOTICES).scan
    n, places, spans = scan("Released undr the MIT Licence today")
    assert (n, places) == (6, []) and [(s.label, s.first_word, s.n_words, s.errors) for s in spans] == [("mit", 1, 4, 2)]
    assert scan("undr teh MTI Licence")[2] == []
    assert [s.first_word for s in scan("all rights reservd x all rights reserved")[2]] == [0, 4]
    assert scan("small rights reservedly")[2] == []


def test_other_licenses_are_no_typing_errors():
    scan = Scanner(PHRASES, NOTICES).scan
    for text in ("CC BY 4.0", "CC BY SA", "CC BY ND 4.0", "CC BY"):
        assert scan(f"licensed under {text}")[2] == []
    assert scan("under the MPL license")[2] == [] and scan("Licensed under the Apache License, Version 1.1")[2] == []
    for text in ("licensd undr CC BY-NC 4.0", "licensed under cc bync", "licensed under cc by-sa, licensed under cc by-nc"):
        assert [s.label for s in scan(text)[2]] == ["cc-by-nc"]
    for text in ("undr the MIT licens", "under themit license", "under the mitlicense"):
        assert [s.label for s in scan(text)[2]] == ["mit"]
    assert [s.label for s in scan("Licensed under the Apache Licence, Version 2.0")[2]] == ["apache-2"]


def test_spans(spark):
    docs = spark.createDataFrame([(1, "x\nAll  Rights\nreserved."), (2, None)], "doc_id long, text string")
    assert rows(license_scan.spans(docs)) == [(1, "all-rights-reserved", 1, 3, 0, 1.0)]


def test_odd_rows(spark, sf_dir):
    found = license_scan.labels(odd(spark, sf_dir))
    assert found.count() == odd(spark, sf_dir).count()
    assert rows(found.filter("doc_id = 1")) == [(1, 0, 0, None, None, "", "", 0.0)] * 2
    assert license_scan.labels(nothing(spark)).count() == 0
