"""Licence rules and dated URL lists on hand-made cases."""

import random
import re
import time
from datetime import datetime

from duskgrid.llm import licenses as L
from duskgrid.llm import url_filter as U


def wrapped(text, width=60):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_rules():
    s = L.SENTENCES
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + wrapped(s["mit-grant"] + ":") + "\n\n" + wrapped(s["mit-notice"] + ".") + "\n\n" + wrapped(s["mit-warranty"] + ".")
    assert [m[0] for m in L.scan(mit)] == ["MIT"]
    bsd = [s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    assert [m[0] for m in L.scan(".\n".join(bsd) + ".")] == ["BSD-3-Clause"]
    assert [m[0] for m in L.scan(".\n".join(bsd[:3]) + ".")] == ["BSD-2-Clause"]
    assert L.scan(".\n".join([bsd[0], *bsd[2:0:-1]])) == []  # out of order
    assert L.scan(".\n".join([bsd[0], "a.", "b.", "c.", "d.", "e.", *bsd[1:3]])) == []  # too far apart
    two = "words here\nReleased under the MIT License.\nmore words. Licensed under CC BY-NC 4.0. and\n"
    assert [m[0] for m in L.scan(two)] == ["MIT", "CC-BY-NC-4.0"] and two[L.scan(two)[0][1] :].startswith("Released")
    assert [m[0] for m in L.scan("This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.")] == ["GPL-3.0-only", "Apache-2.0"]
    assert L.scan("We talk about the MIT License at length.") == []


def plain(ids):
    """Every rule tried everywhere, longest first: what matched() must give."""
    used, out = set(), []
    for name, rule in sorted(L.RULES, key=lambda r: -len(r[1])):
        for i, (n, k) in enumerate(ids):
            if i in used or k != rule[0]:
                continue
            took, last = [i], n
            for want in rule[1:]:
                j = next((j for j in range(took[-1] + 1, len(ids)) if j not in used and ids[j][1] == want and ids[j][0] - last <= L.GAP + 1), None)
                if j is None:
                    break
                took.append(j)
                last = ids[j][0]
            else:
                used.update(took)
                out.append((name, took))
    return out


def test_rules_against_brute_force():
    rng = random.Random(2)
    names = ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "gpl-free", "gpl-hope", "gpl-see", "agpl-free", "agpl-see", "lgpl-hope", "0bsd-grant", "isc-warranty"]
    for _ in range(300):
        at, ids = 0, []
        for _ in range(rng.randint(0, 25)):
            at += rng.choice([1, 1, 1, 2, 3, 5, 7])
            ids.append((at, rng.choice(names)))
        assert sorted(L.matched(ids)) == sorted(plain(ids))


def test_every_sentence_is_known_and_time_is_linear():
    alone = {k for _, r in L.RULES if len(r) == 1 for k in r}
    for k, s in L.SENTENCES.items():
        assert any(w in s.lower() for w in L.WORDS)
        if k in alone:
            assert L.scan(f"Some words here.\n{s}.\nAnd more."), k
    took = []
    for n in (2000, 16_000):
        text = "\n".join([L.SENTENCES["mit-title"]] * n)
        began = time.process_time()
        assert len(L.scan(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 0.5


def test_rows(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (2, "", ""), (None, "SPDX-License-Identifier: MIT", ""), (3, "x " * 50000 + "\nReleased under the MIT License.", "")], "doc_id long, text string, licenses string")
    got = [(r.doc_id, r.licenses) for r in L.licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (2, ""), (None, "MIT"), (3, "MIT")], key=str)
    assert L.licenses(df.limit(0)).count() == 0


def test_dated_lists(spark):
    day = lambda d: datetime(2024, 1, d)
    entries = spark.createDataFrame(
        [("a", "Bad.com", "add", day(5)), ("a", "bad.com", "remove", day(10)), ("a", "bad.com", "add", day(20)), ("b", "x.bad.com", "add", day(1)), ("c", "bad.com", "add", day(3)), ("c", "bad.com", "remove", day(3)), ("d", None, "add", day(1)), ("e", "good.com", "remove", day(1))],
        "list string, domain string, action string, ts timestamp",
    )
    pages = [(1, "http://bad.com/", day(4)), (2, "http://bad.com:80/x", day(5)), (3, "https://u@W.BAD.com./", day(9)), (4, "http://bad.com?q", day(10)), (5, "http://x.bad.com", day(21)), (6, "http://notbad.com", day(21)), (7, None, day(21)), (8, "nonsense", day(21)), (9, "http://bad.com", None), (1, "http://bad.com/", day(4)), (None, "http://good.com", day(4)), (10, "http://good.com@b@bad.com/", day(6)), (11, "http://bad.com@good.com/x@bad.com", day(6))]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, fetched timestamp, list string, until int")
    got = {r.page_id: r.lists for r in U.evaluate(df, entries).collect()}
    assert got == {1: [], 2: ["a"], 3: ["a"], 4: [], 5: ["a", "b"], 6: [], 7: [], 8: [], 9: [], 10: ["a"], 11: [], None: []}
    assert U.evaluate(df.limit(0), entries).count() == 0 and U.evaluate(df, entries.limit(0)).where("blocked").count() == 0


def test_blank_lines_are_read_once():
    """A million line feeds take as long as a million letters, and part paragraphs as the plain rule says."""
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b.", " ", "\n", "\n\n", "\t", "\r", " \n "]) for _ in range(rng.randint(0, 30)))
        plain = [(m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in re.finditer(r"(?:[^\n]|\n(?!\s*\n))+", t) if m[0].strip()]
        assert [(a + len(p) - len(p.lstrip()), p.strip()) for a, p in L.paragraphs(t) if p.strip()] == plain
    began = time.time()
    text = "license" + "\n" * 1_000_000 + "Licensed under the MIT License." + " \n" * 500_000
    L.scan(text)
    assert time.time() - began < 20
