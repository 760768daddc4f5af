import random
import re

import pytest

from folioforge.llm import common, license_scan


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def grams(ws):
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


GRAMS = {n: grams(words(t)) for n, t in license_scan.TEMPLATES.items()}


def brute(text, least=0.8):
    """Best containment over every window start, with the same margins."""
    h, out = grams(words(text)), []
    every = set(h)
    for name, g in sorted(GRAMS.items()):
        own, m, step = set(g), len(g), max(1, len(g) // 8)
        if len(own & every) < least * len(own):
            continue  # not even the whole text holds enough
        best = max((len(set(h[max(s - step, 0) : s + m + step]) & own) / len(own) for s in range(len(h))), default=0)
        if best >= least:
            out.append(name)
    return ",".join(out)


def test_whole_table_against_brute_force(spark, sf):
    docs = common.table(spark, sf.replace("0.001", "0.01"), "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.licenses, r.n_licenses) for r in license_scan.scan_licenses(docs, license_scan.prepare(spark)).collect()}
    want = {d: brute(t) for d, t in texts.items()}
    assert {d: x[0] for d, x in got.items()} == want
    assert sum(map(bool, want.values())) >= 10 and all(n == len(list(filter(None, x.split(",")))) for x, n in got.values())


def test_changed_copies_and_edge_rows(spark):
    mit = license_scan.TEMPLATES["mit-header"]
    near = mit.replace("charge", "cost", 1)
    filler = " ".join(f"word{i}" for i in range(40000))
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"x {near.upper()} y"), (3, " ".join(mit.split()[:12])), (4, None), (5, ""), (6, "four words only here"), (None, "released under the mit license"), (7, "Released under the MIT License. " * 3), (7, "Released under the MIT License. " * 3), (8, "released under the mit licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "array('a') as matches")
    found = license_scan.prepare(spark)
    got = sorted(((r.doc_id or 0), r.licenses) for r in license_scan.scan_licenses(df, found).collect())
    assert got == sorted(((d or 0), brute(t)) for d, t in rows)
    assert (1, "mit-header") in got and (2, "mit-header") in got
    with pytest.raises(ValueError):
        license_scan.prepare(spark, {"x": "four words are few"})
    assert license_scan.scan_licenses(df.limit(0), found).count() == 0
    assert license_scan.scan_licenses(df, []).filter("n_licenses > 0").count() == 0
    plan = license_scan.scan_licenses(df, found)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("Physical Plan")[1])


def edited(rng, text, share):
    """About ``share`` of the text's words replaced, dropped or doubled, in stretches."""
    ws = text.split()
    for _ in range(round(share * len(ws) / 3)):
        at = rng.randrange(len(ws))
        ws[at : at + rng.randint(1, 3)] = [f"new{rng.randrange(99)}"] * rng.randint(0, 4)
    return " ".join(ws)


def test_recall_on_edited_whole_texts(spark):
    """Whole texts, edited and set into other words, against every window start: nothing may be lost that is long enough."""
    rng = random.Random(8)
    names = sorted(n for n in license_scan.TEMPLATES if len(GRAMS[n]) <= 3000)
    rows = []
    for i in range(240):
        name = names[i % len(names)]
        filler = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(400)))
        rows.append((i, f"{filler()} {edited(rng, license_scan.TEMPLATES[name], rng.choice([0, 0.01, 0.02, 0.03, 0.05]))} {filler()}"))
    got = {r.doc_id: set(r.licenses.split(",")) - {""} for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.prepare(spark)).collect()}
    want = {d: set(brute(t).split(",")) - {""} for d, t in rows}
    held, found = sum(map(len, want.values())), sum(len(got[d] & want[d]) for d in want)
    assert held > 150 and found >= 0.995 * held, (found, held)
    assert all(got[d] <= want[d] for d in want)


def test_long_licenses_are_told_apart(spark):
    whole = {n: t for n, t in license_scan.TEMPLATES.items() if len(GRAMS[n]) > 1000}
    rows = [(i, f"intro words here {t} and an end") for i, t in enumerate(whole.values())]
    got = {r.doc_id: r.licenses.split(",") for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.prepare(spark)).collect()}
    assert all(n in got[i] for i, n in enumerate(whole)) and len(whole) >= 5
    assert all(sum(x in whole for x in got[i]) == 1 for i in got)


def test_many_notices_in_one_text(spark):
    rows = [(1, "Released under the MIT License. " * 20_000), (2, license_scan.TEMPLATES["mit-header"] * 300)]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.prepare(spark)).collect()}
    assert got[1] == brute("Released under the MIT License. " * 3) and "mit-header" in got[2]
