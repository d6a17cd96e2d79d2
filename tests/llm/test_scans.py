import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from walkloom.llm.licences import DIGESTS, KNOWN, canonical, known_licences, scan_licences
from walkloom.llm.secrets import FEATURES, candidates, compiled, features, fit_forest, labelled_findings, scan_secrets

MIT = next(t for n, k, t in KNOWN if n == "MIT" and k == "text")


def test_licences(spark):
    odd = "Copyright (c) 2020 A. Person\n" + MIT.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;") + "\n\n© B"
    rows = [
        (1, MIT), (2, odd), (3, MIT + " more"), (4, "text\n  Released under the MIT Licence!\nother"), (5, None), (6, ""), (7, "Copyright 2020 x"),
        (8, "licensed under CC BY-NC 4.0\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (8, "x"), (None, "x"), (9, "we are licensed under the MIT License, said he"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licence string")
    got = scan_licences(docs, known_licences(spark)).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got if r.id != 8}
    assert by[1].licence == by[2].licence == "MIT" and by[1].text_digest == by[2].text_digest and by[3].licence is None
    assert (by[4].notices, by[4].notice_lines) == ("MIT", 1) and by[9].notices == ""
    assert by[5].text_digest == by[6].text_digest == by[7].text_digest and by[5].licence is None
    assert sorted((r.notices, r.notice_lines) for r in got if r.id == 8) == [("", 0), ("CC-BY-NC-4.0,MIT", 3)]
    many = scan_licences(docs, known_licences(spark), broadcast_rows=1)
    assert sorted(map(str, many.collect())) == sorted(map(str, got))
    assert scan_licences(docs.limit(0), known_licences(spark)).count() == 0 and scan_licences(docs, known_licences(spark).limit(0)).filter("licence is not null").count() == 0
    assert spark.range(1).select(canonical(F.lit("A  Licence--of\tX.")).alias("c")).first().c == "a license of x"


FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence texts on this machine")
def test_whole_texts_of_long_licences(spark):
    """Texts as published, in other dress (case, line breaks, signs, copyright lines), and with one word changed."""
    rows, want = [], {}
    for name, licence in FILES.items():
        text = (FOLDER / name).read_text()
        for dress in (text, text.upper().replace(",", " -- "), " ".join(text.split("\n")) if name == "MPL-2.0" else text, "(c) 2021 Somebody\n" + text.replace("\n", "\r\n")):
            want[len(rows)] = licence
            rows.append((len(rows), dress))
        rows.append((len(rows), text.replace(" the ", " a ", 1)))
    got = {r.id: r.licence for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known_licences(spark)).collect()}
    assert got == {i: want.get(i) for i, _ in rows} and len({n for n, _ in DIGESTS}) == 13


def test_short_licences_all_match_themselves(spark):
    texts = [(i, t) for i, (_, k, t) in enumerate(KNOWN) if k == "text"]
    got = scan_licences(spark.createDataFrame(texts, "doc_id long, text string"), known_licences(spark)).collect()
    assert {r.id: r.licence for r in got} == {i: KNOWN[i][0] for i, _ in texts}


def test_candidates_match_brute_force(spark):
    rng = random.Random(6)
    parts = ["é", "🙂", " ", "\n", "=", "==", '"', "token ", "a1" * 9, "Zz9+/_-" * 3, "x" * 20, "1" * 17, "short1", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(150)] + [None, "", "ab1" * 50_000]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = [(i, m.start(), m[0]) for i, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9+/_\-]{16,}+={0,2}", t or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    assert sorted((r.id, r.start, r.candidate) for r in candidates(docs).collect()) == want


def test_forest_removes_what_the_candidate_rule_admits(spark):
    """Held-out generated findings in running text, half of them no secrets: the forest removes nearly all of these
    and keeps nearly all secrets."""
    findings = labelled_findings(spark, 6000)
    made = findings.withColumn("n", F.monotonically_increasing_id()).collect()
    forest = fit_forest(labelled_findings(spark, 4000))
    rows = [(i, f"some words {r.before}{r.candidate}{r.after} and more", r.path, r.label) for i, r in enumerate(made[4500:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, label int")
    found = {}
    for r in scan_secrets(docs, forest).collect():
        found[r.id] = found.get(r.id, False) or r.secret
    secrets = [found.get(i, False) for i, _, _, label in rows if label]
    others = [found[i] for i, _, _, label in rows if not label and i in found]
    print("secrets kept", sum(secrets) / len(secrets), "others removed", 1 - sum(others) / len(others), "of", len(others))
    assert sum(secrets) >= 0.97 * len(secrets) and sum(others) <= 0.05 * len(others) and len(others) > 400


def test_secrets(spark):
    forest = fit_forest(labelled_findings(spark, 1500))
    key, sha = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "1eb9c654e721b4f812088970e66a6345cee33dd6"
    rows = [
        (1, f'set token = "{key}" now', "src/a.py"), (2, f"see commit {sha} for it", "src/a.py"), (3, None, None), (4, "", "x"),
        (5, "é" * 30 + f' api_key: "{key}", and uuid 123e4567-e89b-12d3-a456-426614174000', None), (5, "only words here thethethethethethethe", "x"), (None, f"password={key}", "x"),
    ]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, score double")
    got = scan_secrets(docs, forest).collect()
    text = {(i, t) for i, t, _ in rows}
    for r in got:
        assert any(i == r.id and t and t[r.start : r.start + r.length] == r.candidate for i, t in text)
    flat = {(r.id, r.candidate[:8]): r.secret for r in got}
    assert flat[1, key[:8]] and flat[5, key[:8]] and flat[None, key[:8]]
    assert not flat[2, sha[:8]] and not flat[5, "123e4567"] and len(got) == 5
    assert scan_secrets(docs.limit(0), forest).count() == 0
    assert fit_forest(labelled_findings(spark, 100).filter("label = 1")) is None and all(r.secret for r in scan_secrets(docs, None).collect())


def test_words_beside_a_candidate_come_from_the_whole_text(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f"AWS_SECRET_ACCESS_KEY={key}", f"é DATABASE_PASSWORD_PROD={key}\n", f'x\n{key}"{key}:{key[:16]}={key[:16]},{key} end 🙂 {key}', f"{key}", f" {key} "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = candidates(docs).collect()
    assert len(got) == 10
    for r in got:
        t, end = texts[r.id], r.start + len(r.candidate)
        assert (t[r.start : end], t[max(0, r.start - 40) : r.start], t[end : end + 16]) == (r.candidate, r.before, r.after)
    x = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    flags = candidates(docs).filter("id < 2").orderBy("id").select(x["assigned"].alias("a"), x["key_word"].alias("k")).collect()
    assert [r.a for r in flags] == [1, 1] and flags[0].k == 1


def test_forest_expression_equals_model(spark):
    from pyspark.ml.feature import VectorAssembler

    forest = fit_forest(labelled_findings(spark, 600), trees=4, depth=4)
    f = labelled_findings(spark, 900).filter("path is not null")
    x = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(f.select("label", *[c.alias(k) for k, c in x.items()]))
    rows = forest.transform(data.withColumn("ours", compiled(forest))).select("label", "ours", "probability").collect()
    assert max(abs(r.ours - r.probability[1]) for r in rows) < 1e-6
    assert sum((r.ours >= 0.5) == bool(r.label) for r in rows) / len(rows) > 0.97


def test_findings_are_steady(spark):
    a = labelled_findings(spark, 50).collect()
    assert a == labelled_findings(spark, 50).collect() and sum(r.label for r in a) == 25 and all(re.search("[0-9]", r.candidate) for r in a if r.label == 0)
