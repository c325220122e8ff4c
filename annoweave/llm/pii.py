"""Personal data: fixed patterns, and further spans found by weak supervision.

Four kinds are fixed patterns with a check (email, ip, card, phone): every match that passes is a span.
Further candidates (checked matches that failed, phone-like numbers without a plus, and opaque strings)
are voted on by labelers: a shape regex, a gazetteer of known beginnings and endings, the words before
the candidate, and its make-up. Expectation-maximisation estimates how reliable each labeler is from
the agreement of their votes over the whole corpus; its posteriors train a logistic span classifier,
which decides about the further candidates. No labels are needed.

All work on rows is DataFrame expressions. The driver sees only the counts of vote patterns, of which
there are at most ``len(KINDS) * 3 ** len(LABELERS)``.

Positions are code points. Patterns are possessive and start only where a run starts, so that long runs
of digits or letters take linear time and no deep recursion; their matches are those of the plain forms.
Spans of a text are gathered in blocks, so that a text of very many matches does not copy them again for each.

Defined cases: a null text counts as empty and has no spans; repeated rows are judged one by one; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "number", "secret")
BASE = KINDS[:4]
LABELERS = ("regex", "gazetteer", "context", "make_up")
THRESHOLD = 0.5
_CONTEXT = 24
_EM_STEPS = 40
_FIT_STEPS = 400
_BLOCK = 64  # spans folded at a time

# The patterns of the four base kinds, then of the further candidates.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9_+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]{0,64}[0-9])(?=[0-9_/+-]{0,64}[A-Za-z])[A-Za-z0-9_/+-]{16,}+",
}
# A text without this cannot hold the kind.
_NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]",
           "number": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": "[0-9]"}
# What labelers look for: (votes for, votes against) as patterns of the candidate or of what is before it.
_SHAPES = {"email": (r"^[A-Za-z0-9._%+-]{1,64}@", r"\.\.|@-"),
           "number": (r"^\(?[2-9]", r"^0"),
           "secret": (r"^(?:[0-9a-f]{16,}|[A-Z0-9]{20}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_/+-]{20,})$", r"^[0-9-]+$|--")}
_KNOWN = {"email": (r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$", r"\.(?:png|jpg|gif|js|css)$"),
          "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-2][0-9])\.", r"^(?:0|127|255)\."),
          "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^0"),
          "phone": (r"^\+[1-9]", r"^\+0"),
          "number": (r"555|800", r"^000"),
          "secret": (r"^(?:AKIA|ASIA|ghp_|gho_|sk_|sk-|xox|eyJ)", r"/")}
_BEFORE = {"email": r"(?i)(?:mail|contact|kontakt|contacto|write)[^A-Za-z]*$",
           "ip": r"(?i)(?:\bip|host|server|address|login)[^A-Za-z]*$",
           "card": r"(?i)(?:card|visa|carte|karte|tarjeta|amex)[^A-Za-z]*$",
           "phone": r"(?i)(?:tel|phone|fon|call|fax|mobile)[^A-Za-z]*$",
           "number": r"(?i)(?:tel|phone|fon|call|fax|mobile)[^A-Za-z]*$",
           "secret": r"(?i)(?:password|passwd|pwd|token|secret|key|auth|bearer)[\x20\"'=:]*$"}
_BEFORE_NOT = r"(?i)(?:version|page|isbn|doi|chapter|section|https?|commit|sha|digest)[^A-Za-z]*$"


def _let(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _scan(items: Column, kind: str, carry: Column, step) -> Column:
    """The array of what ``step(carry, item)``, a pair (next carry, element of the type ``kind``), gives in turn.

    A fold copies its state at every step, so an array that grows in one would take quadratic time. Here the
    items are cut into blocks; a first fold gives the carry (an int) each block starts with, a second one the
    elements of a block.
    """
    def none(of: str) -> Column:
        return F.coalesce(F.lit(None).cast(of), F.array().cast(of))

    def cut(all_: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * _BLOCK + 1, F.lit(_BLOCK)))

    def starts(blocks: Column) -> Column:
        def over(state: Column, block: Column) -> Column:
            passed = F.aggregate(block, state["carry"], lambda c, x: step(c, x)[0])
            return F.struct(passed.alias("carry"), F.concat(state["all"], F.array(state["carry"])).alias("all"))

        first = F.struct(carry.alias("carry"), none("array<int>").alias("all"))
        return F.aggregate(blocks, first, over, lambda state: state["all"])

    def within(block: Column) -> Column:
        def append(state: Column, item: Column) -> Column:
            following, element = step(state["carry"], item)
            return F.struct(following.alias("carry"), F.concat(state["out"], F.array(element)).alias("out"))

        first = F.struct(block["start"].alias("carry"), none(f"array<{kind}>").alias("out"))
        return F.aggregate(block["items"], first, append, lambda state: state["out"])

    return _let(items, lambda all_: _let(cut(all_), lambda blocks: F.flatten(F.transform(
        F.arrays_zip(blocks.alias("items"), starts(blocks).alias("start")), within))))


def _matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places and the text just before them.

    The pieces between the matches give the places, so no offset is asked of the regex engine.
    """
    pattern = PATTERNS[kind]
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                        F.split(text, pattern, -1).alias("gap"))
    match = "struct<start:int,end:int,hit:string,before:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"),
                             F.right(x["gap"], F.lit(_CONTEXT)).alias("before"))

    # The piece after the last match is beside no hit.
    found = F.filter(_scan(both, match, F.lit(0), step), lambda m: m["hit"].isNotNull())
    empty = F.array().cast(f"array<{match}>")
    return F.when(text.rlike(_NEEDED[kind]), found).otherwise(empty)


def _passes(kind: str, hit: Column) -> Column:
    """The check of a base kind."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(plain) > 3, False).otherwise(
                F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(hit, r"\."), small)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    size = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1))
        doubled = F.translate(digit, "0123456789", "0246813579")
        return total + F.when((size - i) % 2 == 1, doubled).otherwise(digit).cast("int")

    luhn = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), weigh) % 10 == 0
    return F.when(size.between(14, 19), luhn).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidates(text: Column, kind: str) -> Column:
    """Structs of start, end, kind (its place in KINDS), sure (a base span) and a vote per labeler."""
    place = F.lit(KINDS.index(kind))

    def judge(m: Column) -> Column:
        hit, before = m["hit"], m["before"]
        sure = _passes(kind, hit) if kind in BASE else F.lit(False)
        if kind in _SHAPES:
            shape = _vote(hit.rlike(_SHAPES[kind][0]), hit.rlike(_SHAPES[kind][1]))
        else:
            shape = _vote(sure, ~sure)
        known = _vote(hit.rlike(_KNOWN[kind][0]), hit.rlike(_KNOWN[kind][1]))
        context = _vote(before.rlike(_BEFORE[kind]), before.rlike(_BEFORE_NOT))
        share = F.length(F.regexp_replace(hit, "[^0-9]", "")) / F.length(hit)
        if kind == "secret":
            made = _vote(share.between(0.05, 0.8), share < 0.02)
        else:
            made = _vote(before.rlike(r"(?:^|[\s\"'(<:=])$"), before.rlike(r"[A-Za-z0-9]$"))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), place.alias("kind"),
                        sure.alias("sure"), shape.alias("regex"), known.alias("gazetteer"),
                        context.alias("context"), made.alias("make_up"))

    return F.transform(_matches(text, kind), judge)


def reliabilities(counts: list[tuple[int, tuple, int]]) -> tuple[dict, list]:
    """Expectation-maximisation over vote patterns ``(kind, votes, n)``.

    Returns the posterior of each (kind, votes) and, by labeler, the chance of each vote for what is
    not and what is personal data. A labeler's reliability is one for all kinds; kinds differ in how
    common personal data is among their candidates. Starts from the votes' majority.
    """
    def first(votes: tuple) -> float:
        return 1.0 / (1.0 + math.exp(-2.0 * sum(votes)))

    posterior = {(kind, votes): first(votes) for kind, votes, _ in counts}
    rates: list = []
    for _ in range(_EM_STEPS):
        prior, rates = {}, []
        for kind in {k for k, _, _ in counts}:
            own = [(posterior[k, v], n) for k, v, n in counts if k == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1.0) / (sum(n for _, n in own) + 2.0)
        for i in range(len(LABELERS)):
            rate = [{-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}]
            for k, v, n in counts:
                rate[1][v[i]] += posterior[k, v] * n
                rate[0][v[i]] += (1.0 - posterior[k, v]) * n
            rates.append([{vote: x / sum(side.values()) for vote, x in side.items()} for side in rate])
        for kind, votes, _ in counts:
            odds = math.log(prior[kind] / (1.0 - prior[kind]))
            odds += sum(math.log(r[1][v] / r[0][v]) for r, v in zip(rates, votes))
            posterior[kind, votes] = 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, odds))))
    return posterior, rates


def _features(kind: int, votes: tuple) -> list[float]:
    return ([1.0] + [float(v == 1) for v in votes] + [float(v == -1) for v in votes]
            + [float(kind == k) for k in range(len(KINDS))])


def fit(counts: list[tuple[int, tuple, int]]) -> list[float]:
    """Weights of the logistic span classifier, trained on the posteriors of ``reliabilities``."""
    size = len(_features(0, (0,) * len(LABELERS)))
    weights = [0.0] * size
    if not counts:
        return weights
    posterior, _ = reliabilities(counts)
    # Each pattern weighs as the logarithm of its count, so that rare kinds are learned as well.
    rows = [(_features(k, v), posterior[k, v], math.log2(1.0 + n)) for k, v, n in counts]
    whole = sum(w for _, _, w in rows)
    for _ in range(_FIT_STEPS):
        slope = [0.02 * w for w in weights]
        for x, target, weight in rows:
            score = sum(a * b for a, b in zip(weights, x))
            error = weight / whole * (1.0 / (1.0 + math.exp(-score)) - target)
            for i, value in enumerate(x):
                slope[i] += error * value
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def _score(weights: list[float], c: Column) -> Column:
    n = len(LABELERS)
    total = F.lit(weights[0])
    for i, name in enumerate(LABELERS):
        total = total + F.when(c[name] == 1, weights[1 + i]).when(c[name] == -1, weights[1 + n + i]).otherwise(0.0)
    kind = F.lit(0.0)
    for k in range(len(KINDS)):
        kind = F.when(c["kind"] == k, weights[1 + 2 * n + k]).otherwise(kind)
    return 1.0 / (1.0 + F.exp(-(total + kind)))


def _written(spans: Column) -> Column:
    """``kind:start:end`` of every span, by start and then kind, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"], c["kind"], c["end"])))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda c: F.concat_ws(
        ":", name[c["kind"]], c["start"].cast("string"), c["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of spans with start, end (exclusive) and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[_candidates(text, kind) for kind in KINDS])
    rows = stored(docs.select("doc_id", every.alias("found")), "pii-candidates")
    votes = rows.select(F.explode("found").alias("c")).groupBy(
        "c.kind", *[f"c.{name}" for name in LABELERS]).count()
    counts = sorted((r["kind"], tuple(r[name] for name in LABELERS), r["count"]) for r in votes.collect())
    weights = fit(counts)
    base = F.filter("found", lambda c: c["sure"])
    taken = F.array_sort(F.filter("found", lambda c: c["sure"] | (_score(weights, c) > THRESHOLD)))
    rows = rows.select("doc_id", base.alias("base"), taken.alias("taken"))

    # By start, a span overlaps base spans before it up to the furthest end of these, and the next one
    # after it if that starts before its own end.
    def ahead(reach: Column, c: Column) -> tuple[Column, Column]:
        return F.when(c["sure"], F.greatest(reach, c["end"])).otherwise(reach), c["start"] < reach

    def behind(following: Column, c: Column) -> tuple[Column, Column]:
        return F.when(c["sure"], c["start"]).otherwise(following), c["end"] > following

    before = _scan(F.col("taken"), "boolean", F.lit(0), ahead)
    after = F.reverse(_scan(F.reverse("taken"), "boolean", F.lit(2 ** 31 - 1), behind))
    marked = F.arrays_zip(F.col("taken").alias("c"), before.alias("before"), after.alias("after"))
    apart = F.filter(marked, lambda m: ~m["c"]["sure"] & ~m["before"] & ~m["after"])
    return rows.select("doc_id", "base", F.transform(apart, lambda m: m["c"]).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    def of(place: int) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == place)).cast("long")

    counts = [of(place).alias(f"n_{kind}") for place, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets."""
    found = find(docs).select(F.col("doc_id").alias("_doc"), F.concat("base", "added").alias("_spans"))
    joined = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("_doc")))
    name = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform("_spans", lambda c: F.struct(c["start"], c["end"], c["kind"])))

    def step(at: Column, c: Column) -> tuple[Column, Column]:
        kept = F.substring(F.col("text"), at + 1, F.greatest(c["start"] - at, F.lit(0)))
        mark = F.when(c["start"] >= at, F.concat(F.lit("<"), name[c["kind"]], F.lit(">"))).otherwise("")
        return F.greatest(at, c["end"]), F.concat(kept, mark)

    last = F.coalesce(F.array_max(F.transform("_spans", lambda c: c["end"])), F.lit(0))
    rest = F.substring(F.col("text"), last + 1, F.length("text"))
    pieces = F.array_join(_scan(order, "string", F.lit(0), step), "")
    return joined.select("doc_id", F.concat(pieces, rest).alias("text"))
