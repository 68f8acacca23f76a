"""Personal data: base spans against plain patterns, the method on planted forms, and texts that are costly to search."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import personal_data as pd

DOCS = "doc_id long, text string, spans string, n_email long, `a.b` int, base string, candidates string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def expected(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and is_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base(text):
    return pd.joined(pd.found_in(text)[0]).split(",") if pd.joined(pd.found_in(text)[0]) else []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1209@.-_+() é,%:=", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == expected(text)


@pytest.mark.parametrize("text", [
    "a@b.c@d.e", "a@b@c.d", "@a.b", "x@y..z", "é@b.c a@b.c-", "1.2.3.4.5.6.7.8", "01.002.0003.255", "1.2.3.256 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111",
    "+1 (017) 555-7713", "+1 (487) 555-7209 4736962573099581", "+12", "++1 22 333 4444 55", "+1()()()5", "0000000000000000", "4111  1111 1111 1111", "a@b.c,d@e.f;1.2.3.4",
])
def test_base_spans_of_odd_texts(text):
    assert base(text) == expected(text)


def test_long_runs_take_linear_time():
    began = time.time()
    for unit in ("x", "1", "1.", "1 ", "@", "a@", "+", "+1", "(", "(at)", ":a", "a1", "=", "1-1(", "+1(", "a.b@c.", "token=", "é"):
        pd.found_in(unit * (400_000 // len(unit)))
    assert time.time() - began < 60


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["house", "garten", "agua", "temps", "tree", "Version", "walk", "ünd"], 30)) for _ in range(300)]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        head = "4" + number(14)
        return next(head + str(d) for d in range(10) if is_luhn(head + str(d)))

    def order():
        head = "9" + number(14)
        return next(head + str(d) for d in range(10) if not is_luhn(head + str(d)))

    forms = [
        lambda: f"mail me: user{number(2)}@mail{number(1)}.example.com now", lambda: f"host {number(2)}.{number(2)}.1{number(2)}.7 is up", lambda: f"my card {card()} please", lambda: f"call +1 ({number(3)}) 555-{number(4)} today",
        lambda: f'token = "{hashlib.sha1(number(5).encode()).hexdigest()}" there', lambda: f"phone ({number(3)}) 555-{number(4)} at night", lambda: f"email jane{number(2)} (at) example (dot) org soon", lambda: f"order {order()} was sent",
    ]
    return [(i, p[:80] + " " + forms[i % 9]() + " " + p[80:] if i % 9 < 8 else p, "s", 5, 1, "b", "c") for i, p in enumerate(plain)]


def test_method_adds_planted_forms_and_leaves_clean_texts(spark, texts):
    found = {r.doc_id: r for r in pd.find_personal_data(spark.createDataFrame(texts, DOCS), carry=["doc_id"]).collect()}
    kinds = {0: "email", 1: "ip", 2: "card", 3: "phone", 4: "secret", 5: "phone", 6: "email"}
    for i, text, *_ in texts:
        spans, own = [s for s in found[i].spans.split(",") if s], expected(text)
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == found[i].base_sha256
        assert set(own) <= set(spans)
        assert {s.split(":")[0] for s in spans} == ({kinds[i % 9]} if i % 9 in kinds else set()), text
    assert sum(found[i].n_phone for i, *_ in texts) == len([1 for i, *_ in texts if i % 9 == 3])


def test_reliabilities_are_found_again():
    rng = np.random.default_rng(1)
    true = rng.random(20_000) < 0.3
    right, silent = (0.95, 0.9, 0.8, 0.7, 0.6), (0.1, 0.3, 0.5, 0.2, 0.1)
    votes = np.stack([np.where(rng.random(len(true)) < s, 1, np.where((rng.random(len(true)) < r) == true, 2, 0)) for r, s in zip(right, silent, strict=True)], axis=1)
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, chances, belief = pd.maximised(patterns, n.astype(float))
    assert abs(prior - 0.3) < 0.03
    for k, (r, s) in enumerate(zip(right, silent, strict=True)):
        assert abs(chances[k, 2, 1] - (1 - s) * r) < 0.03 and abs(chances[k, 1, 0] - s) < 0.03
    majority = (votes - 1).sum(axis=1) > 0
    assert ((belief[where.ravel()] > 0.5) == true).mean() > (majority == true).mean()


def test_added_spans_overlap_nothing():
    kept = pd.without_overlaps([[(0, 5)], [], [(3, 9)], []], [(0.9, 4, 8, 12), (0.8, 3, 20, 30), (0.95, 4, 25, 40), (0.7, 0, 9, 20), (0.95, 1, 25, 40)])
    assert kept == [[(0, 5), (9, 20)], [(25, 40)], [(3, 9)], [], []]


def test_odd_rows(spark, texts):
    rows = [(1001, None, "s", 5, 1, "b", "c"), (1002, "", "s", None, None, None, None), (None, "a@b.cd", "s", 1, 1, "b", "c"), (1004, "x" * 300_000 + " a@b.cd", "s", 1, 1, "b", "c"), (1005, "+1 (487) 555-7209 4736962573099581", "s", 1, 1, "b", "c")]
    found = pd.find_personal_data(spark.createDataFrame([*rows, rows[3], *texts], DOCS)).where("doc_id is null or spans_ = 's'")
    assert {"doc_id", "text", "spans_", "n_email_", "a.b", "base_", "candidates_", "spans", "n_email"} <= set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert got[1001].spans == got[1002].spans == "" and got[1001].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].spans == "email:0:6" and got[1004].spans == "email:300001:300007"
    assert got[1005].n_phone == 0 and "phone:0:17" in got[1005].spans
    assert found.count() == len(texts) + len(rows) + 1
    assert pd.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0
