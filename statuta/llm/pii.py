"""Personal data by weak supervision, from DataFrame functions alone.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Further candidates come from looser
patterns (national phone numbers, social security numbers, bank accounts, names after a title). Labelers vote
on every candidate, for, against or not at all: a strict pattern, a gazetteer, the words around it, and what touches it.
Candidates are summed by kind and votes, a table of bounded size, on which expectation-maximisation estimates each
labeler's reliability and each pattern's posterior. With the posteriors as soft labels a naive Bayes classifier over kind,
votes and shape of the span is trained; candidates beyond the base that it finds at least as likely as not are added.

Spans are (start, end) in code points, end exclusive, leftmost and non-overlapping within a kind. Nulls and odd rows: a null
text is an empty one and has no span; repeated rows and null ids each get their row; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy


@dataclass(frozen=True)
class Kind:
    """pattern: Java regex equal to the given one, but without backtracking; needs: a plain sign that a text may hold one."""

    name: str
    pattern: str
    needs: str
    base: bool


# The kinds in their order, the first four with the patterns that their spans are defined by.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "9", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "9", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True),
    Kind("tel", r"(?<![0-9+)\x20-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "9", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "9", False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "9", False),
    Kind("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?", "title", False),
)
# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "example", "test", "invalid", "local")
COUNTRIES = ("AD", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM", "TR")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "358", "380", "420", "421", "886", "971", "972")
FOR_WORDS = r"(?i)(?<![a-z])(e-?mail|mail|contact|write|tel|phone|call|mobile|fax|card|visa|account|iban|ssn|social security|ip|host|address|kontakt|telefon|adresse|correo|tarjeta|carte|compte)[^a-z]*$"
AGAINST_WORDS = r"(?i)(?<![a-z])(version|v|release|license|section|isbn|issn|token|password|sha|hash|build|order|invoice|ticket|serial|part)[^a-z]*$"
LABELERS = ("pattern", "gazetteer", "context", "touching")
CONTEXT = 40


def _found(text: Column, kind: Kind) -> Column:
    """Struct of the matches and of what stands between them: length, and the text next to the matches."""
    pieces = F.transform(F.split(text, kind.pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.substring(p, 1, 1).alias("first"), F.substring(p, -CONTEXT, CONTEXT).alias("last")))
    hit = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"), pieces.alias("pieces"))
    may = {"9": text.rlike("[0-9]"), "title": text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z]")}.get(kind.needs, F.contains(text, F.lit(kind.needs)))
    return F.when(may, hit)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


#: Places of a text's matches are summed by blocks of so many, so that many matches don't cost the square.
_BLOCK = 64


def _blocks(lengths: Column) -> Column:
    """Sums of the lengths before each block."""
    count = F.ceil(F.size(lengths) / _BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(each, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second from the right counts double, its digits added."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return _sum(one) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The check that a match must pass to be a span of its kind."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 no vote."""
    v = F.when(yes, 1)
    return F.coalesce((v.when(no, -1) if no is not None else v).otherwise(0), F.lit(0))


def _votes(kind: str, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    strict = {
        "email": (hit.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$") & ~hit.contains("..")),
        "ip": _valid("ip", hit), "card": _valid("card", hit), "phone": _valid("phone", hit),
        "tel": digits.rlike("^[2-9][0-9]{2}[2-9]"), "ssn": ~digits.rlike("^(?:000|666|9)|^...00|0000$"),
        "iban": F.length(F.regexp_replace(hit, " ", "")).between(15, 34), "name": hit.rlike(r"\.\x20[A-Z][a-z]+\x20"),
    }[kind]
    gazetteer = {
        "email": (F.lower(F.substring_index(hit, ".", -1)).isin(*DOMAINS), None), "ip": (hit.rlike(r"^(?:10|127|172|192)\."), hit.rlike(r"^0")),
        "card": (digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^0")), "phone": (reduce(lambda a, b: a | b, [F.substring(digits, 1, n).isin(*[c for c in CALLING if len(c) == n]) for n in (1, 2, 3)]), F.lit(True)),
        "tel": (F.lit(False), digits.rlike("^[01]")), "ssn": (F.lit(False), None), "iban": (F.substring(hit, 1, 2).isin(*COUNTRIES), F.lit(True)), "name": (F.lit(False), None),
    }[kind]
    return {
        "pattern": _vote(strict, ~strict), "gazetteer": _vote(*gazetteer), "context": _vote(before.rlike(FOR_WORDS), before.rlike(AGAINST_WORDS)),
        "touching": _vote(~(before.rlike(r"[\p{L}\p{N}=\"'/_-]$") | after.rlike(r"^[\p{L}\p{N}=\"'/_-]")), F.lit(True)),
    }


def _spans(order: int, k: Kind) -> Column:
    """The kind's matches as structs; null where there are none."""
    hits, pieces, lengths, sums = (F.col(c) for c in (f"f_{k.name}.hits", f"f_{k.name}.pieces", f"l_{k.name}", f"b_{k.name}"))

    def span(hit: Column, i: Column) -> Column:
        before, after = pieces[i], pieces[i + 1]
        block = F.floor(i / _BLOCK).cast("int")
        start = sums[block] + _sum(F.slice(lengths, block * _BLOCK + 1, i % _BLOCK)) + before["n"]
        length = F.floor(F.least(F.length(hit), F.lit(40)) / 4).cast("string")
        shape = F.concat_ws("", F.lit(f"{k.name}:"), length, F.when(hit.contains(" "), "s"), F.when(hit.contains("-"), "d"))
        votes = _votes(k.name, hit, before["last"], after["first"])
        return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + F.length(hit)).alias("end"), F.lit(k.name).alias("kind"), (F.lit(k.base) & _valid(k.name, hit)).alias("base"), *[votes[n].alias(n) for n in LABELERS], shape.alias("shape"))

    return F.when(lengths.isNotNull(), F.transform(hits, span))


@tidy
def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``cands``: spans with kind, start, end, base, votes and shape, for every row."""
    text = F.coalesce("text", F.lit(""))
    # written, so that each pattern runs once over a text and later steps read a small table
    raw = materialize(docs.select(*keep, *[_found(text, k).alias(f"f_{k.name}") for k in KINDS]))
    with_sums = raw.select(*keep, *[f"f_{k.name}" for k in KINDS], *[
        F.when(F.size(f"f_{k.name}.hits") > 0, F.zip_with(F.transform(f"f_{k.name}.pieces", lambda p: p["n"]), F.transform(f"f_{k.name}.hits", F.length), lambda a, b: a + F.coalesce(b, F.lit(0)))).alias(f"l_{k.name}") for k in KINDS])
    with_sums = materialize(with_sums.select("*", *[F.when(F.col(f"l_{k.name}").isNotNull(), _blocks(F.col(f"l_{k.name}"))).alias(f"b_{k.name}") for k in KINDS]))
    each = [_spans(order, k) for order, k in enumerate(KINDS)]
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,base:boolean,pattern:int,gazetteer:int,context:int,touching:int,shape:string>>")
    return with_sums.select(*keep, F.concat(*[F.coalesce(e, empty) for e in each]).alias("cands"))


def estimate_reliability(patterns: DataFrame, rounds: int = 10) -> tuple[float, dict]:
    """EM over ``patterns`` (kind, a vote per labeler, n): share of true spans, and P(vote | true), P(vote | false).

    Both classes' vote shares are smoothed by one; each round is one small aggregate.
    """
    share, rate = 0.5, {(n, v): (0.6, 0.2) if v == 1 else (0.1, 0.5) if v == -1 else (0.3, 0.3) for n in LABELERS for v in (-1, 0, 1)}
    for _ in range(rounds):
        p = posterior(share, rate)
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * p).alias("true")]
        sums += [F.sum(F.when(F.col(n) == v, F.col("n") * w)).alias(f"{n}_{v}_{c}") for n, v in rate for c, w in (("t", p), ("f", 1 - p))]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        share = min(0.99, max(0.01, (row["true"] + 1) / (row["all"] + 2)))
        rate = {(n, v): ((row[f"{n}_{v}_t"] or 0) + 1, (row[f"{n}_{v}_f"] or 0) + 1) for n, v in rate}
        whole = {n: tuple(sum(rate[n, v][c] for v in (-1, 0, 1)) for c in (0, 1)) for n in LABELERS}
        rate = {(n, v): (t / whole[n][0], f / whole[n][1]) for (n, v), (t, f) in rate.items()}
    return share, rate


def posterior(share: float, rate: dict) -> Column:
    """Probability that a candidate with these votes is true, labelers being independent."""
    logit = F.lit(math.log(share / (1 - share)))
    for n in LABELERS:
        logit = logit + reduce(lambda c, v: c.when(F.col(n) == v, math.log(rate[n, v][0] / rate[n, v][1])), (-1, 0), F.when(F.col(n) == 1, math.log(rate[n, 1][0] / rate[n, 1][1]))).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def train_classifier(spans: DataFrame, share: float, rate: dict) -> tuple[float, dict[str, float]]:
    """Naive Bayes on soft labels: log-odds of the prior and of each feature ("name=value")."""
    p = posterior(share, rate)
    features = F.array(F.lit("all"), *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in ("kind", "shape", *LABELERS)])
    sums = spans.select(F.explode(features).alias("f"), p.alias("p")).groupBy("f").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("n"))
    rows = {r.f: (r.t + 1, r.n + 1) for r in sums.collect()}  # kinds, votes and shapes: under 600 rows
    t, n = rows.pop("all", (1, 1))
    return math.log(t / n), {f: math.log(a / t / (b / n)) for f, (a, b) in rows.items()}


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added, for every row."""
    rows = candidates(docs, keep)
    spans = rows.where(F.size("cands") > 0).select(F.explode("cands").alias("c")).select("c.*")
    patterns = materialize(spans.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")))
    share, rate = estimate_reliability(patterns)
    prior, weight = train_classifier(spans, share, rate)
    table = F.create_map(*[F.lit(x) for f, w in sorted(weight.items()) for x in (f, w)]) if weight else F.create_map(F.lit(""), F.lit(0.0))

    def likely(c: Column) -> Column:
        terms = [F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{n}="), c[n].cast("string"))), F.lit(0.0)) for n in ("kind", "shape", *LABELERS)]
        return reduce(lambda a, b: a + b, terms, F.lit(prior)) >= 0

    base = F.filter("cands", lambda c: c["base"])
    added = F.filter("cands", lambda c: ~c["base"] & ~c["kind"].isin(*[k.name for k in KINDS if k.base]) & likely(c))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda name: F.size(F.filter("base", lambda c: c["kind"] == name)).cast("long").alias(f"n_{name}")
    found = rows.select(*keep, slim(base).alias("base"), slim(added).alias("added"))
    return found.select(*keep, *[count(k.name) for k in KINDS if k.base], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
