import random
import re

import pytest

from statuta.functions import tagging
from statuta.functions.matching import Matcher, literals, normal

PATTERNS = [p for ps in tagging.JURISDICTION_PATTERNS.values() for p in ps] + [p for _, ps in tagging.TYPE_PATTERNS for p in ps]


def test_literals():
    assert literals(r"\bGDPR\b") == [("gdpr", True, True, True)]
    assert literals(r"\bUSA?\b") == [("usa", True, True, True), ("us", True, True, True)]
    assert literals(r"Directive \d{4}/\d+/EU") == [("directive ", False, False, False)]
    assert literals(r"\bguidelines?\b") == [("guidelines", True, True, True), ("guideline", True, True, True)]
    assert literals(r"\$[\d,]+ million") == [(" million", False, False, False)] and literals(r"£[\d,]+") == [("£", False, False, False)]
    assert literals(r"\bRegulation \(EU\)") == [("regulation (eu)", True, False, False)]
    with pytest.raises(ValueError):
        Matcher([r"\d+"])


def test_counts_are_those_of_the_expressions():
    """Random texts made of what the patterns look for, in any case, with and without word edges."""
    rng = random.Random(1)
    bits = ["EU", "uk", "Usa", "US", "C.F.R.", "u.s.c.", "Guidelines", "guideline", "fine of", "£1,2", "$3 million", "$3", " million", "Directive 2016/679/EU", "directive 12", "Regulation (EU)", "regulations.gov",
            "Conseil d'État", "conseil d'état", "AI Act", "UK GDPR", "_", " ", ".", "x", "é", "1", "İCO", "ıco", "ſec", "K", "Proposed Rule", "\n", "App", "notice of proposed rulemaking"]
    machine = Matcher(PATTERNS)
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        want = {i: n for i, p in enumerate(PATTERNS) if (n := len(re.findall(p, text, re.IGNORECASE)))}
        assert machine.counts(text) == want, text
        assert len(normal(text)) == len(text)


# Hand-made cases with the results that the rules give.
PLACES = [
    ("under 16 C.F.R. Part 1", {}), ("see C.F.R.x and U.S.C.1", {"US": 2}), ("USA, US and usable", {"US": 2}), ("UK GDPR", {"EU": 1, "UK": 2}), ("reuse the app; APP", {"AU": 2}),
    ("Directive 2016/679/EU", {"EU": 2}), ("le Conseil d'état", {"FR": 1}), ("NEUE euro", {}), ("regulations.gov/x", {"US": 1}), ("", {}), (None, {}),
]
TYPES = [
    ("a Final Rule; complaint", "Regulation"), ("guidelines on fines", "Guidance"), ("a fine of guidance", "Monetary Penalty"), ("$1,200 million", "Monetary Penalty"), ("$1,200 thousand", None),
    ("overruling", None), ("ruling and Federal Notice", "Decision"), ("NPRM, framework", "Proposed Rule"), ("EU Directive ruling", "Directive"), ("federal register notice", "Notice"),
]
REST = [
    ("on 7 May 2022 and 2021-03-04", "2021-03-04", [], []), ("May 7, 2022 or 8 June 2020", "2020-06-08", [], []), ("41 May 2022", "41 May 2022", [], []), ("03/04/2020", "03/04/2020", [], []), ("x2021-03-04", None, [], []),
    ("USD 3.5 bn, £1,000 and € 2m, $7 mild", None, [3.5e9, 1000.0, 2e6, 7.0], []), ("Article 5(1) of the GDPR, article 9a, Article 5(1) of the GDPR", None, [], ["Article 5(1) of the GDPR", "article 9a"]),
    ("no digits: May, USD, Article", None, [], []),
]


def test_tags_by_hand(spark):
    texts = [t for t, _ in PLACES] + [t for t, _ in TYPES] + [r[0] for r in REST]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in rows.select("i", tagging.tags(rows.t).alias("x")).orderBy("i").collect()]
    for x, (t, places) in zip(got, PLACES):
        assert {n: c for n, c in x.places.asDict().items() if c} == places, t
    for x, (t, kind) in zip(got[len(PLACES) :], TYPES):
        assert x.type == kind, t
    for x, (t, date, money, articles) in zip(got[len(PLACES) + len(TYPES) :], REST):
        assert (x.date, x.money, x.articles) == (date, money, articles), t
