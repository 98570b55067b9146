"""PII, licenses, archives."""

import base64
import hashlib
import random
import re

import pytest
from llm_odd import ODD

from barlens.llm import licenses, pii, warc
from barlens.llm.common import scratch

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(t):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, t or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(m.span())
    return out


def test_pii_base_patterns():
    rnd = random.Random(5)
    for _ in range(20_000):
        t = "".join(rnd.choice("aZ0123456789@@..--+ ()_%é4111\n") for _ in range(rnd.randint(0, 50)))
        t += rnd.choice(["", "", "4111 1111 1111 1111", "+1 (802) 555-9869", "1.2.3.4.5.6.7.8.9", "256.1.1.1.2", "a@b.c@d.e", "x@y..z", "00000001.2.3.4"])
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_takes_no_time_over_long_runs():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + "-" * 200_000, "1 " * 100_000):
        pii.base_spans(t)


def test_pii_of_odd_rows(odd, none):
    got = pii.report(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ODD) and all((r.spans, r.base_sha256, r.n_email) == ("", empty, 0) for r in got)
    assert pii.report(none).isEmpty()


def test_disclosing_terms(make_docs):
    rnd = random.Random(1)
    filler = lambda: " ".join(rnd.choice(["alpha", "bravo", "charlie", "delta", "echo"]) for _ in range(12))
    rows = [(i, f"{filler()} zorblatt to bob@x.org by {filler()}") for i in range(5)] + [(i, filler()) for i in range(5, 60)] + [(60, "zorblatt alone is left")]
    got = {r.doc_id: r.spans for r in pii.report(make_docs(rows)).collect()}
    text = dict(rows)
    for i in range(5):
        a, b = text[i].index("zorblatt"), text[i].index("bob@")
        assert got[i] == f"email:{b}:{b + 9},generalise:{a}:{a + 8}"
    assert all(got[i] == "" for i in range(5, 61))
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}
    assert set(clean) == set(range(5)) and "[term] to [email] by" in clean[0]
    always = [(i, t) for i, t in rows if i != 60]
    assert {r.spans.split(",")[1].split(":")[0] for r in pii.report(make_docs(always)).filter("doc_id < 5").collect()} == {"remove"}


def test_terms_beside_values_of_one_or_two_documents(make_docs):
    rows = [(i, "alpha bravo charlie delta") for i in range(60)] + [(60, "alpha zorblatt bravo bob@x.org charlie")]
    rows += [(i, "alpha quuxine bravo 10.1.2.3 delta") for i in (61, 62)]
    got = {r.doc_id: r.spans for r in pii.report(make_docs(rows)).collect()}
    assert got[60] == "email:21:30,remove:6:14" and got[61] == got[62] == "ip:20:28,remove:6:13"
    assert all(got[i] == "" for i in range(60))


def plain_near(t):
    """Every word against every span."""
    spans = pii.base_spans(t)
    words = [m.span() for m in re.finditer(r"[^\W_]+", t)]
    taken = lambda a, b: any(a < y and x < b for found in spans.values() for x, y in found)
    out = []
    for kind, found in spans.items():
        for x, y in found:
            near = [w for w in words if w[0] < x][-10:] + [w for w in words if w[0] >= y][:10]
            out += [(pii.entity(kind, t[x:y]), t[a:b].lower(), a, b) for a, b in near if not taken(a, b)]
    return out


def test_terms_near_against_brute_force():
    rnd = random.Random(12)
    parts = ["alpha", "Kim", "x" * 500, "bob@x.org", "10.1.2.3", "+1 (802) 555-9869", "4111 1111 1111 1111", ",", "é", "7", "a@b.c", "(", "zu"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "\n"]) for _ in range(rnd.randint(0, 30)))
        assert [(d["entity"], d["term"], d["start"], d["stop"]) for d in pii.near(t, pii.base_spans(t))] == plain_near(t), t


def test_very_many_values_take_no_time():
    t = "write to bob@x.org or " * 20_000
    assert len(pii.near(t, pii.base_spans(t))) == 20_000 * 12 - 12  # of six words, three are parts of the address


def test_short_names_and_codes(make_docs):
    rows = [(i, "alpha bravo Charlie in it 3") for i in range(60)]
    rows += [(60 + i, f"alpha {w} bravo bob{i}@x.org it") for i, w in enumerate(("Kim", "Li", "김철수", "李明", "b12", "77"))]
    got = {r.doc_id: r.spans for r in pii.report(make_docs(rows)).collect()}
    for i, t in rows[60:]:
        w = t.split()[1]
        assert got[i].split(",")[1:] == [f"remove:6:{6 + len(w)}"], t
    assert all(got[i] == "" for i in range(60))


def test_bare_values_count_as_documents_of_the_entity(make_docs):
    rows = [(i, "alpha zorblatt bob@x.org") for i in range(3)] + [(i, "Bob@x.org") for i in range(3, 16)] + [(16, "zorblatt")] + [(i, "alpha") for i in range(17, 64)]
    docs = make_docs(rows)
    assert pii.disclosures(pii._found(docs, "doc_id", "text"), docs).isEmpty()


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_shares_against_brute_force(make_docs, monkeypatch, bound):
    import math

    rnd = random.Random(8)
    names = [f"term{i}" for i in range(12)]
    rows = []
    for d in range(80):
        w = [rnd.choice(names) for _ in range(rnd.randint(3, 9))]
        if rnd.random() < 0.4:
            w.insert(rnd.randint(0, len(w)), f"p{rnd.randint(0, 2)}@x.org")
        rows.append((d, " ".join(w)))
    docs = make_docs(rows)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", bound)
    got = {(r.entity, r.term): (r.n_et, r.n_e, r.n_t) for r in pii.disclosures(pii._found(docs, "doc_id", "text"), docs).collect()}
    want = {}
    for k in range(3):
        e = f"p{k}@x.org"
        for t in names:
            together = sum(e in x.split() and t in x.split() for _, x in rows)
            n_e, n_t = sum(e in x.split() for _, x in rows), sum(t in x.split() for _, x in rows)
            if together >= 3 and math.log2(together * 80 / (n_e * n_t)) / math.log2(80 / n_e) >= pii.GENERALISE:
                want[f"email:{e}", t] = (together, n_e, n_t)
    assert got == want


def brute_license(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), places


def test_license_base(odd, none):
    rnd = random.Random(3)
    parts = ["GNU", "general", "public", "License", "apache", "license", "CC", "BY", "cc-by", "MIT", ",", " ", "\n", "é", "1", "x", "gnu general public license"]
    for _ in range(5000):
        t = rnd.choice([" ", "-", ""]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        n, places, _ = licenses.scan_text(t)
        assert (n, places) == brute_license(t)
    got = licenses.report(odd).collect()
    for r in got:
        assert (r.n_base, r.labels, r.score, r.first_word) == (0, "", 0.0, None)
    assert sorted(r.n_words for r in got) == sorted(brute_license(t)[0] for _, t in ODD)
    assert licenses.report(none).isEmpty()


def labels(t):
    return [(d.label, d.first, d.last) for d in licenses.scan_text(t)[2]]


def test_license_rules():
    assert len(licenses.rules()) > 300 and all(r.needed for r in licenses.rules())
    assert labels("GNU Lesser General Public License v2.1") == [("lgpl-2.1", 0, 6)]
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == [("gpl-3.0", 0, 7)]
    assert labels("CC BY-NC 4.0") == [("cc-by-nc-4.0", 0, 4)]
    assert labels("http://www.apache.org/licenses/LICENSE-2.0") == [("apache", 0, 7)]
    assert ("mit", 2, 6) in labels("it is released under the MIT License.")
    assert labels("das Licht und mit der Lizenz") == [] and labels("please mention the gold bar") == []
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")[0][0] == "mit"


def samples(pattern):
    """Texts that an expression of groups, classes, repeats and plain characters matches: each branch of each group once."""
    from re import _parser

    def of(tree):
        texts = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg)]
            elif name == "IN":
                parts = [chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0])]
            elif name == "ANY":
                parts = ["q"]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                parts = [x * max(arg[0], 1) for x in of(arg[2])] + ([""] if arg[0] == 0 else [])
            elif name == "SUBPATTERN":
                parts = of(arg[3])
            elif name == "BRANCH":
                parts = [x for branch in arg[1] for x in of(branch)]
            else:
                assert name in ("ASSERT",), name
                parts = [""]
            # every part once, with the first of the others
            texts = [texts[0] + p for p in parts] + [t + parts[0] for t in texts[1:]]
        return texts

    return of(_parser.parse(pattern))


def test_every_sample_of_every_rule_is_detected():
    """With its own label, unless what a rule of higher tier, or of the same and longer, found covers it."""
    rules, own = licenses.rules(), 0
    assert len(rules) > 700 and len(licenses.SIGNATURES) > 150
    for order, rule in enumerate(rules):
        for sample in samples(rule.pattern.pattern.decode()):
            joined = f" {sample} ".encode()
            m = rule.pattern.search(joined)
            assert m, (rule, sample)
            assert (order, rule) in licenses.candidates(joined), (rule, sample)
            found = licenses.detect(joined)
            first = joined.count(b" ", 0, m.start()) - 1
            last = first + joined.count(b" ", m.start(), m.end())
            assert any(d.first <= first and last <= d.last and rules[d.rule].tier <= rule.tier for d in found), (rule, sample, found)
            own += rule.label in [d.label for d in found]
    assert own > 0.95 * sum(len(samples(r.pattern.pattern.decode())) for r in rules)


def plain_detect(joined):
    """All rules without a gate, and each detection held against all that are before it."""
    found = [(r.tier, m.start() - m.end(), k, m.start(), m.end(), r) for k, r in enumerate(licenses.rules()) for m in r.pattern.finditer(joined)]
    kept = []
    for x in sorted(found, key=lambda x: x[:5]):
        if not any(y[3] <= x[3] and x[4] <= y[4] for y in kept):
            kept.append(x)
    place = lambda at: joined.count(b" ", 0, at) - 1
    return sorted((place(x[3]), place(x[3]) + joined.count(b" ", x[3], x[4]), x[5].label, x[2]) for x in kept)


def test_detections_equal_those_without_a_gate():
    rnd = random.Random(16)
    parts = [sample for r in licenses.rules() for sample in samples(r.pattern.pattern.decode())[:1]]
    parts += ["gpl", "v3", "the", "license", "cc by", "4 0", "or later", "mit", "word", "licensed under"]
    for _ in range(60):
        joined = f" {' '.join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))} ".encode()
        assert sorted((d.first, d.last, d.label, d.rule) for d in licenses.detect(joined)) == plain_detect(joined)


def test_very_many_detections_take_no_time():
    assert len(licenses.scan_text("released under the MIT License and GPLv3; " * 8000)[2]) == 16_000


@pytest.mark.parametrize(("name", "version", "label"), [
    ("GPL", "3", "gpl-3.0"), ("GPL", "2", "gpl-2.0"), ("LGPL", "2.1", "lgpl-2.1"), ("AGPL", "3", "agpl-3.0"), ("GFDL", "1.3", "gfdl-1.3"), ("ASL", "2", "apache-2.0"), ("CC BY", "4", "cc-by-4.0"),
    ("CC0", "1", "cc0-1.0"), ("PDDL", "1", "pddl-1.0"), ("ODbL", "1", "odbl-1.0"), ("MPL", "2", "mpl-2.0"), ("EPL", "1", "epl-1.0"), ("CDDL", "1", "cddl-1.0"), ("EUPL", "1.2", "eupl-1.2"),
    ("OSL", "3", "osl-3.0"), ("SSPL", "1", "sspl-1"), ("WTFPL", "2", "wtfpl-2"), ("LPPL", "1.3", "lppl-1.3"),
])
def test_versions_glued_to_names(name, version, label):
    for t in (f"{name}v{version}", f"Files are {name}v{version} only"):
        assert label in [d.label for d in licenses.scan_text(t)[2]], t
    assert labels("released under 0BSD") == [("0bsd", 0, 2)]


def test_gates_keep_no_match_out():
    """Against all rules without a gate, over random texts of the parts of names."""
    rnd = random.Random(6)
    parts = ["gpl", "gplv3", "mplv2", "0bsd", "released under", "licensed", "the", "license", "licence", "cc by", "nc", "4 0", "v2", "or later", "gnu", "lesser", "general public", "mit", "bsd", "3 clause", "simple", "osl", "asl2", "x11", "0"]
    for _ in range(400):
        joined = f" {' '.join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))} ".encode()
        for rule in licenses.rules():
            if rule.pattern.search(joined):
                assert all(n in joined for n in rule.needed), (joined, rule)
        assert any(r.pattern.search(joined) for r in licenses.rules()) == bool(licenses.detect(joined))


def test_license_report(make_docs):
    r = licenses.report(make_docs([(1, "Licensed under the Apache License, Version 2.0. CC BY")])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (10, 2, 3, 8, "apache,cc-by", "apache,apache-2.0,cc-by")
    assert r.score == 0.95


PAGES = "page_id bigint, url string, html string"


def brute_warc(rows, least=0):
    out = []
    for k, (i, _, h) in enumerate(rows):
        data = (h or "").encode()
        best = max((x for x in range(len(rows)) if (rows[x][2] or "") == (h or "")), key=lambda x: (rows[x][0] is not None, rows[x][0] or 0, -x))
        response = len(data) < least or k == best
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else rows[best][0]))
    return sorted(out, key=repr)


ROWS = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (None, "u", "<p>x</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]


def test_archive_round_trip(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(ROWS, PAGES).withColumns({"address": F.lit(1), "row": F.lit(2), "payload": F.lit(3)})
    assert sorted((tuple(r) for r in warc.digests(pages).collect()), key=repr) == brute_warc(ROWS)
    warc.write(pages, path := scratch(spark, "test-warc"))
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc.read(spark, path).collect():
        assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert body.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        length = int(re.search(rb"\nContent-Length: (\d+)$", head)[1])
        assert len(body) == length + 4
        assert body.partition(b"\r\n\r\n")[2][:-4] == (bytes(r.payload) if r.record_type == "response" else b"")
    assert warc.digests(pages.limit(0)).isEmpty()


def test_archive_least_bytes_and_damage(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write(pages, path := scratch(spark, "test-warc"), least_bytes=10)
    got = sorted((tuple(r) for r in warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == brute_warc(ROWS, 10)
    from pyspark.sql import functions as F

    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("changed"), "UTF-8"))
    stored.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    try:
        warc.read(spark, f"{path}-bad").select("payload_bytes").collect()
    except Exception as error:
        assert "does not have the digest" in str(error)
    else:
        raise AssertionError("damage was not noticed")
