import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest

from rankloom.llm import filter_audit
from tests.llm import cases

LABELS = "doc_id long, quality int, toxic int"


def failures(docs):
    """Per row (part, set of failed letters, doc_id), by the contract's words."""
    out = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs) else set()
        out.append((lang or "", f, doc_id))
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    judged, rows, total = failures(docs), {}, Counter()
    for part in {p for p, _, _ in judged}:
        own = [(f, i) for p, f, i in judged if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if letter in f]
                left = [(f, i) for f, i in left if letter not in f]
                total[part, letter] += len(gone)
                fails = sum(letter in f for f, _ in own)
                rows[part, "".join(order), step] = (
                    len(left), len(gone), fails - len(gone), sum(f == {letter} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone),
                )
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


@pytest.mark.parametrize("clash", [False, True])
def test_every_order_against_plain_python(spark, clash):
    docs = cases.documents(spark, clash)
    extra = [(20, cases.words(9, 300, 100), "en", "a", 1), (21, cases.words(9, 300, 1000) + " A# " + "B" * 90, "en", "a", 1), (22, cases.words(9, 300, 1000), "en", "a", 1), (23, cases.words(9, 300, 1000), None, "a", 1)]
    extra += [(None, cases.words(9, 300, 1000), "en", "a", 1), (5, "other", "en", "a", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, cases.SCHEMA), allowMissingColumns=True)
    labels = [(5, 1, 0), (5, 0, 0), (6, 1, 1), (22, 1, None), (23, None, 1), (None, 1, 1), (99, 1, 1)]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r) for r in got} == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert len(got) == 600 * len({r.lang or "" for r in docs.collect()})


def test_polynomial_of_hand_made_masks():
    terms = filter_audit.removal_polynomial({0: 7, 0b001: 2, 0b011: 4, 0b111: 6}, 3)
    assert [filter_audit.corner(terms, s) for s in range(8)] == [0, 12, 10, 12, 6, 12, 10, 12]
    assert [filter_audit.diagonal_integral(terms, i) for i in range(3)] == [2 + Fraction(4, 2) + Fraction(6, 3), Fraction(4, 2) + 2, Fraction(2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(cases.empty(spark), none).count() == 0
    assert filter_audit.audit(cases.documents(spark), none).where("good_lost + toxic_lost > 0").count() == 0
