import hashlib
import random
import re

from linewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), list(PATTERNS).index(k), m.end(), k))
    out.sort()
    return out


def want(doc, text):
    found = brute(text)
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (doc, *[sum(x[3] == k for x in found) for k in PATTERNS], hashlib.sha256(listed.encode()).hexdigest())


EDGES = [
    None, "", "a@b.c", "a@b.com_c@d.org x@y", "😀é a.b@c.d.e. 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 255.255.255.256", "+1 (389) 555-5010, +12345 +1 2 3 4 5 6 7 8 9 0 -",
    "4111 1111 1111 1111 4111-1111-1111-1111-2 4111111111111111", "1" * 9000 + " " + "a" * 9000, "1 " * 5000, ".a" * 5000 + "@" + "b.c" * 3000, "+" * 4000 + "1" * 4000,
    "call 212-555-0147 or (212) 555-0148 now", "mail to bob (at) site (dot) com please", "a@@b.c a@b..c %@-.-", "\n5.5.5.5\n+44 20 7946 0958\t",
]


def made(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["1", "23", "4111111111111111", ".", " ", "-", "@", "+", "a", "x.y", "(", ")", "é", "😀", "255"]) for _ in range(rng.randrange(120))) for _ in range(150)]


def test_base_matches_brute_force(spark, sf_dir):
    docs = list(enumerate(EDGES + made(1))) + [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = pii.pii_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(want(*d) for d in docs)
    for r, (d, t) in zip(sorted(rows), sorted(docs, key=lambda x: x[0]), strict=True):
        listed = set(r["spans"].split(",")) - {""}
        assert {f"{k}:{s}:{e}" for s, _, e, k in brute(t)} <= listed


def test_added_spans_and_redaction(spark):
    docs = [(i, f"please call our phone line 212-555-{1000 + i} or mail x{i}@site.com, +1 212 555 {1000 + i}") for i in range(50)] + [(99, "order 212-555-0000 of build 7"), (100, None)]
    d = spark.createDataFrame([(a, b, len(b or ""), "src") for a, b in docs], "doc_id long, text string, n_chars long, pii string")
    rows = {r["doc_id"]: r for r in pii.pii_digest(d).collect()}
    assert all("phone:27:39" in rows[i]["spans"].split(",") for i in range(50))
    out = {r["doc_id"]: r for r in pii.redact_pii(d.drop("pii")).collect()}
    assert out[3]["text"] == "please call our phone line [PHONE] or mail [EMAIL], [PHONE]" and out[3]["n_chars"] == len(out[3]["text"])
    assert out[100]["text"] is None
    assert pii.pii_digest(d.where("false")).count() == 0


def test_no_python_on_executors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = pii.candidates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_reliability_follows_agreement():
    table = [(0, (1, 1, 0, 1), 90), (0, (-1, -1, 0, -1), 60), (0, (0, 1, 1, 1), 10), (0, (0, -1, -1, 0), 10)]
    soft = pii.expectation_maximisation(table)
    w = pii.span_classifier([(k, v, (0, 1, 2), n) for k, v, n in table], soft)[0]
    assert soft[0, (1, 1, 0, 1)] > 0.9 and soft[0, (-1, -1, 0, -1)] < 0.1 and w[0] > 0 and w[1] > 0


def test_loose_phones_need_no_hyphen(spark):
    texts = ["call 212 555 0147 now", "phone 212.555.0147", "tel (212) 555 0147", "(212)555 0147", "call 212-555-0147", "nothing"]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()
    got = {r["doc_id"]: [(x["s"], x["e"]) for x in r["_found"] if x["k"] == 3] for r in rows}
    assert got == {0: [(5, 17)], 1: [(6, 18)], 2: [(4, 18)], 3: [(0, 13)], 4: [(5, 17)], 5: []}


def test_very_many_matches(spark):
    """Texts with tens of thousands of matches, which take time in proportion."""
    import time

    times = []
    for n in (4_000, 16_000):
        text = " ".join(f"x{i}@site.com, 212-555-{i % 9000 + 1000} é" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row, out = pii.pii_digest(docs).first(), pii.redact_pii(docs).first()
        times.append(time.perf_counter() - began)
        assert row["n_email"] == n and out["text"] == " ".join(["[EMAIL], [PHONE] é"] * n)
    assert times[1] < 8 * times[0] + 5


def test_overlaps_and_own_columns(spark):
    texts = ["+1 4111 1111 1111 1111 2 and 1.2.3.4@b.co 10.0.0.1", "a@b.co" * 3, "(212) 555-0147@x.org", "call me at 212 555 0147"]
    docs = spark.createDataFrame([(i, t, "p", 7, "q") for i, t in enumerate(texts)], "doc_id long, text string, pii string, _found int, _base_email string")
    out = {r["doc_id"]: r for r in pii.redact_pii(docs).collect()}
    spans = {r["doc_id"]: [tuple(x) for x in r["pii"]] for r in pii.find_pii(docs.select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for s, k, e, _ in spans[i]:
            if s >= at:
                want += t[at:s] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        assert (out[i]["text"], out[i]["pii"], out[i]["_found"], out[i]["_base_email"]) == (want + t[at:], "p", 7, "q")
