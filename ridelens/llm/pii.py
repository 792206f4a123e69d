"""Personal data by weak supervision, in built-in functions only.

Four base kinds (email, ip, card, phone) have fixed patterns and checks and
are always reported.  Further candidates come from one looser pattern; regex,
gazetteer, context, checksum and column labelers vote on each; they conflict on
purpose (a valid shape with a wrong checksum, a personal word before a number
of a table), and no kind is accepted for its shape alone.  The vote patterns are counted
over all documents; expectation-maximisation on that table (its size is
bounded by kinds and labelers, not by the corpus) estimates how reliable each
vote is, and its posteriors train a logistic span classifier, which is
compiled back into a column expression.  Candidates it accepts join the spans.

Positions need no user function: splitting a text by a pattern gives the gaps
between its matches, and running sums over gaps and matches give the offsets.

Edge cases: null and empty texts have no spans; repeated rows are judged one
by one; an empty table gives no rows; spans of different kinds may overlap;
extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import pick, read_table, stored

# The base patterns, written so that they match in one pass
# (possessive repeats; a run of the first class is entered at its start only).
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
BASE_KINDS = ("email", "ip", "card", "phone")

# Shapes of the further kinds and the words that speak for or
# against them.
SHAPES = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "local_phone": r"(?<![0-9+(-]|[0-9+]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "masked_email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,}+"
                     r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,}+\b"),
    "name": (r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.?"
             r"(?:\x20[\p{Lu}][\p{Ll}]{1,30}){1,3}"),
    "secret": (r"\b(?:AKIA[0-9A-Z]{16}\b|(?i:password|passwd|pwd|secret|token|api[_-]?key)"
               r"\x20?[=:]\x20?\"?[A-Za-z0-9_+/.-]{6,}+\"?)"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = (*BASE_KINDS, *SHAPES)
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
STRICT = {
    "iban": r"^[A-Z]{2}[0-9]{2}", "ipv6": r"[1-9A-Fa-f]",
    "local_phone": r"^\(?[2-9][0-9]{2}\D{1,2}[2-9]", "masked_email": r"^[A-Za-z]",
    "name": r"\x20\S+\x20\S+", "secret": r"(?=.*[0-9])(?=.*[A-Za-z]).{16,}",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
GAZETTEER = {
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", "ipv6": r"^(?:2|fe80|fd)",
    "local_phone": r"555", "masked_email": r"(?i)(?:com|org|net|edu|de|fr|es|uk|io)$",
    "name": (r"\b(?:Anna|Anne|Carlos|Claire|David|Emma|Hans|James|Jean|John|José|Juan|Laura|Maria|"
             r"Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Thomas)\b"),
    "secret": r"^(?:AKIA|(?i:password|passwd|token|api))", "ssn": r"^[0-7]",
}
FOR = (r"(?i)\b(?:account|address|call|contact|e-?mail|iban|key|login|mobile|name|password|phone|"
       r"secret|social|ssn|tel|token|write|konto|telefon|anruf|tél|appel|correo|teléfono)\b")
AGAINST = r"(?i)\b(?:figure|invoice|isbn|issue|order|page|part|ref|serial|table|version)\b"
# Numbers known from advertisements and leaflets, nobody's own.
SAMPLE_SSN = r"^(?:078-05-1120|219-09-9999|457-55-5462|123-45-6789)$"
FICTIONAL_PHONE = r"555\D01[0-9]{2}$"
CELL = r"(?:[0-9][0-9.,%/-]*[\x20\t]*[\t|;,]|\|)[\x20\t]*$"  # a number's table cell ends before it
LABELERS = ("strict", "gazetteer", "context", "contrary", "variety", "checksum", "column")
BLOCK = 256


def running(values: Column) -> Column:
    """Exclusive running sums of an array, in two levels so that the cost of
    appending stays far below the square of its length."""
    def sums(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last),
                         lambda b: sums(F.slice(values, b * BLOCK + 1, BLOCK)))

    def join(bs: Column) -> Column:
        bases = sums(F.transform(bs, lambda b: b["s"]))["a"]
        return F.flatten(F.zip_with(bs, bases, lambda b, base: F.transform(b["a"], lambda p: p + base)))
    return F.get(F.transform(F.array(blocks), join), 0)


def located(text: Column, pattern: str, probe: Column | None = None) -> Column:
    """Matches of `pattern` as array<struct<start, end, text, before>>, in code
    points; `before` is the end of the gap before the match.  Texts that fail
    `probe` cannot match and are not searched."""
    lit = F.lit(pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string>>")

    def place(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)),
                           lambda g: F.struct(F.char_length(g).cast("long").alias("n"),
                                              F.right(g, F.lit(40)).alias("tail")))

        def offsets(gs: Column) -> Column:
            steps = F.zip_with(gs, found, lambda g, m: g["n"] + F.char_length(m))
            return F.zip_with(F.arrays_zip(gs.alias("g"), found.alias("m")), running(steps),
                              lambda x, at: F.struct(
                                  (at + x["g"]["n"]).alias("start"),
                                  (at + x["g"]["n"] + F.char_length(x["m"])).alias("end"),
                                  x["m"].alias("text"), x["g"]["tail"].alias("before")))
        return F.when(F.size(found) == 0, none).otherwise(
            F.get(F.transform(F.array(gaps), offsets), 0))
    search = F.get(F.transform(F.array(F.regexp_extract_all(text, lit, F.lit(0))), place), 0)
    return search if probe is None else F.when(probe, search).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value),
                        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": located(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(located(text, IP), lambda s: s["text"].rlike(OCTETS)),
        "card": F.filter(located(text, CARD, text.rlike("[0-9]")), lambda s: F.when(
            F.length(_digits(s["text"])).between(12, 19), luhn(_digits(s["text"]))).otherwise(False)),
        "phone": F.filter(located(text, PHONE, F.contains(text, F.lit("+"))),
                          lambda s: F.length(_digits(s["text"])).between(9, 15)),
    }


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN's number, its country and check digits moved to the
    end and letters written as 10 to 35; 1 where it is valid."""
    s = F.regexp_replace(iban, "\\x20", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    signs = F.filter(F.split(turned, ""), lambda x: x != "")
    return F.aggregate(F.transform(signs, lambda x: F.ascii(x)), F.lit(0), lambda acc, x: F.when(
        x < 65, (acc * 10 + x - 48) % 97).otherwise((acc * 100 + x - 55) % 97))


def checked(kind: Column, m: Column) -> Column:
    """What the value itself proves: 1 a checksum or the look of chance, -1 that it
    cannot be one, 0 nothing."""
    value = F.regexp_replace(m, r"^[A-Za-z_-]+\x20?[=:]\x20?\"?|\"$", "")
    signs = F.filter(F.array_distinct(F.split(value, "")), lambda x: x != "")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    rules = {
        "iban": F.when(mod97(m) == 1, 1).otherwise(-1),
        "ipv6": F.when(m.rlike(r"^([0-9A-Fa-f]{1,4})(?::\1){7}$|^(?i)2001:0?db8:"), -1).otherwise(0),
        "local_phone": F.when(m.rlike(FICTIONAL_PHONE) | m.rlike(r"([0-9])\1\D?[0-9]?\1{3}"), -1).otherwise(0),
        "masked_email": F.when(m.rlike(r"(?i)\b(?:look|meet|be|stay|is|was|are|point)\x20at\x20"), -1).otherwise(0),
        "name": F.when(m.rlike(r"\x20(?:Street|Road|Avenue|Hall|Hospital|University|Who|Pepper)\b"), -1).otherwise(0),
        "secret": F.when(mixed & (2 * F.size(signs) >= F.least(F.length(value), F.lit(16))), 1)
                   .when(value.rlike(r"^(?:[A-Za-z]+(?:[_./-][A-Za-z]+)*[_./-]?|[0-9.]+)$"), -1).otherwise(0),
        "ssn": F.when(m.rlike(SAMPLE_SSN) | m.rlike(r"^([0-9])\1\1-\1\1-\1{4}$"), -1).otherwise(0),
    }
    out = F.lit(0)
    for k, rule in rules.items():
        out = F.when(kind == k, rule).otherwise(out)
    return out


def _by_kind(kind: Column, patterns: dict[str, str], of: Column) -> Column:
    out = F.lit(False)
    for k, p in patterns.items():
        out = F.when(kind == k, of.rlike(p)).otherwise(out)
    return out


def voted(candidate: Column) -> Column:
    """kind, start, end and the votes (1 for, -1 against, 0 silent)."""
    kind = F.lit(None).cast("string")
    for k, p in reversed(SHAPES.items()):
        kind = F.when(candidate["text"].rlike(f"^(?:{p})$"), k).otherwise(kind)
    m, before = candidate["text"], candidate["before"]

    def votes(k: Column) -> Column:
        variety = F.size(F.array_distinct(F.split(F.lower(m), "")))
        return F.struct(
            k.alias("kind"), candidate["start"].alias("start"), candidate["end"].alias("end"),
            F.array(
                F.when(_by_kind(k, STRICT, m), 1).otherwise(-1),
                F.when(_by_kind(k, GAZETTEER, m), 1).otherwise(0),
                F.when(before.rlike(FOR), 1).otherwise(0),
                F.when(before.rlike(AGAINST), -1).otherwise(0),
                F.when(variety >= 6, 1).when(variety <= 4, -1).otherwise(0),
                checked(k, m), F.when(before.rlike(CELL), -1).otherwise(0)).alias("votes"))
    # matches that only held by their neighbours keep the kind of the full shape
    kind = F.coalesce(kind, F.lit("secret"))
    return F.get(F.transform(F.array(kind), votes), 0)


@dataclass(frozen=True)
class SpanModel:
    """reliability[labeler][vote] = P(vote | span is personal); the classifier's
    bias by kind and weights by (labeler, vote)."""
    reliability: dict[str, dict[int, float]]
    bias: dict[str, float]
    weights: dict[tuple[int, int], float]

    def accepts(self, c: Column) -> Column:
        score = F.lit(-math.inf)
        for k, b in self.bias.items():
            score = F.when(c["kind"] == k, F.lit(b)).otherwise(score)
        for (j, v), w in self.weights.items():
            score = score + F.when(F.get(c["votes"], F.lit(j)) == v, F.lit(w)).otherwise(F.lit(0.0))
        return score >= 0


def estimate(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> SpanModel:
    """EM over (kind, votes, count) rows, then the span classifier."""
    if not table:
        return SpanModel({}, {}, {})
    kinds = sorted({k for k, _, _ in table})
    n = np.array([c for _, _, c in table], float)
    v = np.array([x for _, x, _ in table])
    which = np.array([kinds.index(k) for k, _, _ in table])
    p = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))  # first guess: the majority
    values = (-1, 0, 1)
    for _ in range(rounds):
        # weak beliefs keep a vote "for" from ever counting against, and back
        yes = np.array([[(n * p)[v[:, j] == x].sum() + (2 if x > 0 else 1) for x in values]
                        for j in range(v.shape[1])])
        no = np.array([[(n * (1 - p))[v[:, j] == x].sum() + (2 if x < 0 else 1) for x in values]
                       for j in range(v.shape[1])])
        ratio = np.log(yes / yes.sum(axis=1, keepdims=True)) - np.log(no / no.sum(axis=1, keepdims=True))
        ratio[:, 0], ratio[:, 2] = np.minimum(ratio[:, 0], 0), np.maximum(ratio[:, 2], 0)
        prior = np.array([((n * p)[which == k].sum() + 1) / (n[which == k].sum() + 2)
                          for k in range(len(kinds))])
        logit = np.log(prior / (1 - prior))[which]
        for j in range(v.shape[1]):
            logit = logit + ratio[j, v[:, j] + 1]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    reliability = {name: dict(zip(values, (y / y.sum()).tolist())) for name, y in zip(LABELERS, yes)}
    features = [(j, x) for j in range(v.shape[1]) for x in (-1, 1)]
    x = np.column_stack([np.eye(len(kinds))[which], *[(v[:, j] == y).astype(float) for j, y in features]])
    w, scale = np.zeros(x.shape[1]), n / n.sum() * len(n)
    for _ in range(60):  # ridge logistic regression on the posteriors
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (scale * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]),
                               x.T @ (scale * (p - q)) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    for k, (_, vote) in enumerate(features, len(kinds)):  # a vote never counts against its own claim
        w[k] = max(w[k], 0.0) if vote > 0 else min(w[k], 0.0)
    return SpanModel(reliability, dict(zip(kinds, w[:len(kinds)].tolist())),
                     dict(zip(features, w[len(kinds):].tolist())))


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind order, kind, end) and candidates with votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, doc_id="long", text="string").select("doc_id", text.alias("t"))
    found = base_spans(F.col("t"))

    def tagged(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"),
            F.lit(kind).alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", F.concat(*[tagged(k) for k in BASE_KINDS]).alias("base"),
                       F.transform(located(F.col("t"), ANY), voted).alias("candidates"))


def fit_spans(candidates: DataFrame) -> SpanModel:
    """The counts of vote patterns over all documents: at most 3^labelers rows
    a kind reach the driver."""
    counted = (candidates.select(F.explode("candidates").alias("c"))
               .groupBy("c.kind", "c.votes").count().collect())
    return estimate(sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in counted))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """Per row: doc_id, base and spans (arrays of start, order, kind, end)."""
    rows = stored(find_candidates(docs), "pii-candidates")  # read twice: to fit and to decide
    model = model or fit_spans(rows)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = F.transform(F.filter("candidates", model.accepts), lambda c: F.struct(
        c["start"].alias("start"), order[c["kind"]].alias("order"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", F.concat("base", added).alias("spans"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS],
                        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))
