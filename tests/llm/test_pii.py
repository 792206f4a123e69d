import hashlib
import random
import re

from pyspark.sql import functions as F

from ridelens.llm import pii

KINDS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
         "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")))\
                    or (kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)))\
                    or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


TRICKY = ["a@b.c._x@d.e", "é🙂 x.y+z@a-b.co.uk, 1.2.3.4.5.6.7.8 999.1.1.1 0255.01.1.1", "4111 1111 1111 1111-4111",
          "+1 (555) 123-4567 ext +49 . 1", "+1" + " " * 500, "4" * 400, "a." * 3000 + "@x", "a@b" + ".c" * 3000,
          "1.1.1.1 2.2.2.2\n" * 300, "me@x.org " * 700, "@ + . -", "378282246310005 5555-5555-5555-4444"]


def test_base_spans_equal_brute_force(spark, odd_rows):
    rows = [(k, t) for k, t in enumerate([*TRICKY, *(t for _, t in odd_rows)])]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert sorted(map(tuple, r["base"])) == brute(texts[r["doc_id"]])


def test_query_digest_and_added_spans(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kinds = set()
    for r in pii.op4_pii(spark, d).collect():
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in base) for k in KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{a}:{b}" for a, _, k, b in base} <= set(spans)
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)
        kinds |= {s.split(":")[0] for s in spans}
    assert "secret" in kinds


def test_em_finds_the_reliable_labelers():
    table = []
    for votes, n in (((1, 1, 1, 0, 1), 300), ((1, 0, 1, 0, 1), 200), ((1, 1, 0, 0, 1), 150),
                     ((-1, 0, 0, -1, -1), 250), ((-1, 0, 0, 0, -1), 250), ((-1, 1, 0, -1, -1), 50)):
        table.append(("ssn", votes, n))
    m = pii.estimate(table)
    assert m.reliability["strict"][1] > 0.9 and m.weights[0, 1] > 0 > m.weights[0, -1]
    score = lambda v: m.bias["ssn"] + sum(m.weights.get((j, x), 0) for j, x in enumerate(v))
    assert score((1, 1, 1, 0, 1)) > 0 > score((-1, 0, 0, -1, -1))


def test_no_python_on_the_executors(odd_docs):
    text = pii.find_candidates(odd_docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_empty_table(no_docs):
    assert pii.find_pii(no_docs).count() == 0


def test_long_values_are_whole(spark):
    token = "eyJ0" + "aB3_x.Y-" * 125
    name, host = "long.name" * 12, "host-" * 20 + "x"
    texts = [f"token={token} rest", f'secret: "{token}" rest', f"write to {name} (at) {host} (dot) com today",
             "a." * 20_000 + " (at"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: {texts[r["doc_id"]][c["start"]:c["end"]] for c in r["candidates"]}
             for r in pii.find_candidates(rows).collect()}
    assert len(token) > 1000
    assert found == {0: {f"token={token}"}, 1: {f'secret: "{token}"'}, 2: {f"{name} (at) {host} (dot) com"}, 3: set()}


def iban(rng, valid):
    country, body = rng.choice(["DE", "GB", "FR", "XK"]), "".join(rng.choices("0123456789", k=18))
    turned = "".join(str(int(c, 36)) for c in body + country + "00")
    check = 98 - int(turned) % 97
    return f"{country}{check if valid else (check + 5) % 90 + 2:02d}{body}"


def digits(rng, n, first="23456789"):
    return rng.choice(first) + "".join(rng.choices("0123456789", k=n - 1))


VALUES = {  # a true and a false span of each kind
    "iban": (lambda r: iban(r, True), lambda r: iban(r, False)),
    "ipv6": (lambda r: "2a01:" + ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(7)),
             lambda r: ":".join([r.choice(["0", "1111", "0000", "ffff"])] * 8)),
    "local_phone": (lambda r: f"({digits(r, 3)}) {digits(r, 3, '246')}-{digits(r, 4)}",
                    lambda r: r.choice([f"1{digits(r, 2)}-0{digits(r, 2)}-{digits(r, 4)}", "100-000-0000"])),
    "masked_email": (lambda r: f"{r.choice(['ann', 'bob.k', 'cy_12'])}{digits(r, 3)} (at) host{digits(r, 2)} dot com",
                     lambda r: r.choice(["look at this dot pattern", "stay at every dot here", "meet at noon dot sharp"])),
    "name": (lambda r: f"{r.choice(['Dr', 'Mrs.', 'Herr'])} {r.choice(['Anna', 'Peter', 'Maria'])} {r.choice(['Kowalski', 'Brandt'])}",
             lambda r: r.choice(["Dr Pepper", "Dr Who", "St Prof Hall", "Mr Street"])),
    "secret": (lambda r: "password=" + "".join(r.choices("abcdefgh23456789XYZW", k=18)) + "a7",
               lambda r: r.choice(["secret: required", "pwd = changes.every", "secret=optional_value", "pwd: hidden"])),
    "ssn": (lambda r: f"{r.randrange(100, 599)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
            lambda r: r.choice(["000-12-3456", "987-65-4320", "666-11-1111", "999-99-9999", "078-05-1120"])),
}


def corpus(seed, n=60):
    rng, out = random.Random(seed), []
    for kind, makers in VALUES.items():
        for _ in range(n):
            for true, make in zip((True, False), makers):
                helps, hinders = ("call contact my account", "in the", "so"), ("invoice page", "see the table", "in the")
                before = rng.choice(helps if true else (*hinders, "my account"))
                value = make(rng)
                cell = "" if true or rng.random() < 0.6 else " | "
                out.append((kind, true, f"{before}{cell} ", value))
    return out


def test_conflicting_labelers_beat_the_majority(spark):
    spans = corpus(1)
    rows = spark.createDataFrame([(i, b + v + " then") for i, (_, _, b, v) in enumerate(spans)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_candidates(rows).collect()}
    reported = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find_pii(rows).collect()}
    refused, tally = set(), {"model": [0, 0, 0], "majority": [0, 0, 0]}
    for i, (kind, true, _, _) in enumerate(spans):
        votes = [c["votes"] for c in found[i]["candidates"] if c["kind"] == kind]
        for way, said in (("model", kind in reported[i]), ("majority", any(sum(v) > 0 for v in votes))):
            t = tally[way]
            t[0], t[1], t[2] = t[0] + (said and true), t[1] + (said and not true), t[2] + (not said and true)
        if not true and votes and kind not in reported[i]:
            refused.add(kind)
    score = {w: (tp / (tp + fp), tp / (tp + fn)) for w, (tp, fp, fn) in tally.items()}
    print(score, refused)
    assert refused == set(pii.SHAPES)
    assert score["model"][0] >= score["majority"][0] and score["model"][1] >= score["majority"][1]
    assert min(score["model"]) > 0.9


def test_iban_checksum(spark):
    rng = random.Random(2)
    values = [(iban(rng, k % 2 == 0), k % 2 == 0) for k in range(40)] + [("GB82 WEST 1234 5698 7654 32", True)]
    got = spark.createDataFrame(values, "v string, ok boolean").select(
        (pii.mod97(F.col("v")) == 1).alias("got"), "ok").collect()
    assert all(r["got"] == r["ok"] for r in got)
