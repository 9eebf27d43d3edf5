r"""Personal data by labelers that vote, and a span classifier that learns from their votes.

Base spans are what four fixed patterns with their checks find. A wider pattern for each
kind gives candidates: matches that the base drops or never sees, such as card numbers that
stand side by side, numbers whose check digit is wrong, and addresses written out. Six
labelers vote on each candidate or abstain (its form, its check, a gazetteer, the words
before it, its neighbours, its digits). How candidates voted is counted once; the counts
are at most 3^6 rows a kind. Expectation-maximisation over them estimates how often each
labeler is right, starting from, and held by, stated priors. The candidates' probabilities then
train a naive Bayes classifier over traits of the span and its surroundings, and what it
accepts is added to the base where no base span is touched.

Everything is a column expression or an aggregate: texts are read once and never shuffled,
and all that reaches the driver are sums by kind, labeler and trait.

Patterns start only where a run of their characters starts or the last match ended, and
runs are taken whole, so a very long run without a match costs one pass over it.

Defined results: a null text is empty and has no span; a null id is kept; rows that repeat
an id or a text are results of their own; spans are code points, end exclusive, by kind and
start; in a tie of overlapping candidates the earlier kind wins; an empty table gives no
rows and no candidates leave the priors as they are; further columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.store import stored

KINDS = ["email", "ip", "card", "phone"]
SPANS = "array<struct<kind:int,start:int,end:int>>"

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]++"
# What the four kinds are, written so that a run is entered at its start only.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}(?:\.{_HOST})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[(\[](?i:at)[)\]]\x20?", r"\x20?[(\[](?i:dot)[)\]]\x20?"
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:@{_HOST}(?:\.{_HOST})++"
    rf"|{_AT}{_HOST}(?:(?:\.|{_DOT}|\x20(?i:dot)\x20){_HOST})++|\x20(?i:at)\x20{_HOST}(?:\x20(?i:dot)\x20{_HOST})++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9.+(\p{L}-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
}
# What a text must have for a kind to be looked for in it.
NEEDS = {"email": r"@|(?i:[\x20(\[]dot[\x20)\]])", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br mx ar ch at be se no dk pl pt ru".split()
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|35|6011|64[4-9]|65|62)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|42[01]|97[1-9]|85[2356])[^0-9]"
WORDS_BEFORE = {
    "email": "e-?mail|mail|contact|write to|kontakt|correo|courriel|adresse",
    "ip": "ip|address|host|server|client|adresse|direcci[oó]n|serveur",
    "card": "card|credit|visa|mastercard|amex|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp",
}
OTHER_WORDS = r"token|api.?key|secret|sha\d*|md5|hash|checksum|version|licen[sc]e|section|isbn|order|serial|uuid|commit"

LABELERS = ["form", "check", "gazetteer", "words", "neighbours", "digits"]
#: Prior rate of a yes among votes on real spans, and on others; and how many votes it is worth.
PRIOR = {
    "form": (0.9, 0.35), "check": (0.7, 0.3), "gazetteer": (0.9, 0.4),
    "words": (0.85, 0.2), "neighbours": (0.95, 0.35), "digits": (0.8, 0.3),
}
PRIOR_VOTES = 50.0
PRIOR_SHARE, PRIOR_SPANS = 0.5, 2.0
ROUNDS, STILL = 30, 1e-4
TRAITS = ["n_digits", "joints", "left", "right", "words", "form", "check", "gazetteer", "neighbours"]
ACCEPT = 0.5
#: Values of a running sum that are summed in one block.
BLOCK = 256
CONTEXT = 40


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column, combine) -> Column:
    """What ``combine`` makes of all values before each one, a block at a time: a value costs
    at most ``BLOCK`` steps, and a block as many as there are blocks."""
    part = lambda array, b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK))
    fold = lambda array, first: F.aggregate(array, first, combine)

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, F.lit(BLOCK)).cast("int"))

        def within(whole: Column) -> Column:
            def of_block(b: Column) -> Column:
                before = fold(F.slice(whole, F.lit(1), b), start)
                return _let(
                    F.struct(part(v, b).alias("v"), before.alias("before")),
                    lambda x: F.transform(x["v"], lambda _, i: fold(F.slice(x["v"], F.lit(1), i), x["before"])),
                )

            return F.flatten(F.transform(blocks, of_block))

        return _let(F.transform(blocks, lambda b: fold(part(v, b), start)), within)

    return F.when(F.size(values) > 0, _let(values, of)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str) -> Column:
    """``start, text, before, after`` of each match; one pass for the matches, one for what is between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(x: Column) -> Column:
        widths = F.zip_with(x["m"], F.slice(x["gaps"], F.lit(1), F.size(x["m"])), lambda m, gap: F.length(m) + F.length(gap))
        ends = _running(widths, F.lit(0), lambda a, b: a + b)
        sides = F.zip_with(
            F.slice(x["gaps"], F.lit(1), F.size(x["m"])), F.slice(x["gaps"], F.lit(2), F.size(x["m"])),
            lambda gap, after: F.struct(gap.alias("gap"), F.left(after, F.lit(1)).alias("after")),
        )
        return F.zip_with(
            F.zip_with(x["m"], sides, lambda m, side: F.struct(m.alias("m"), side.alias("side"))), ends,
            lambda p, at: F.struct(
                (at + F.length(p["side"]["gap"])).alias("start"), p["m"].alias("text"),
                F.right(p["side"]["gap"], F.lit(CONTEXT)).alias("before"), p["side"]["after"].alias("after"),
            ),
        )

    return _let(F.struct(found.alias("m"), between.alias("gaps")), spans)


def untouched(spans: Column, blockers: Column) -> Column:
    """The spans that share no character with a blocker, both sorted once and passed over."""

    def of(x: Column) -> Column:
        limit = 2**31 - 1
        ends = _running(F.transform(x, lambda s: F.when(s["blocks"], s["end"]).otherwise(-1)), F.lit(-1), lambda a, b: F.greatest(a, b))
        starts = _running(
            F.transform(F.reverse(x), lambda s: F.when(s["blocks"], s["start"]).otherwise(limit)), F.lit(limit), lambda a, b: F.least(a, b)
        )
        near = F.zip_with(ends, F.reverse(starts), lambda end, begin: F.struct(end.alias("end"), begin.alias("start")))
        both = F.zip_with(x, near, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
        free = F.filter(
            both, lambda b: ~b["s"]["blocks"] & (b["n"]["end"] <= b["s"]["start"]) & (b["n"]["start"] >= b["s"]["end"])
        )
        return F.transform(free, lambda b: F.struct(b["s"]["kind"].alias("kind"), b["s"]["start"].alias("start"), b["s"]["end"].alias("end")))

    marked = lambda array, blocks: F.transform(
        array, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(blocks).alias("blocks"))
    )
    together = F.array_sort(F.concat(marked(spans, False), marked(blockers, True)))
    return F.when((F.size(spans) == 0) | (F.size(blockers) == 0), spans).otherwise(_let(together, of))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.ascii(d) - 47)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _small_parts(text: Column) -> Column:
    return text.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")


def holds(kind: str, text: Column) -> Column:
    """The check that a match of the base pattern must pass."""
    digits = digits_of(text)
    if kind == "ip":
        return _small_parts(text)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _yes_no(yes: Column, no: Column | None = None) -> Column:
    """1, 0, or null for an abstention."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0)


def votes(kind: str, span: Column) -> dict[str, Column]:
    text, before, after = span["text"], span["before"], span["after"]
    digits = digits_of(text)
    if kind == "email":
        last = F.regexp_extract(F.lower(text), r"([a-z0-9-]+)$", 1)
        form = _yes_no(last.rlike("^[a-z]{2,24}$"))
        check = _yes_no(~text.rlike(r"^[.]|\.\.|[.][@(\[\x20]"))
        gazetteer = _yes_no(last.isin(DOMAINS), F.lit(False))
        varied = F.lit(None).cast("int")
    elif kind == "ip":
        form = _yes_no(text.rlike(r"^[0-9]+(?:\.[0-9]+){3}$|\[\.\]|\(\.\)"))
        check = _yes_no(_small_parts(text))
        first = F.substring_index(F.regexp_replace(text, r"[^0-9]+", "."), ".", 1).cast("int")
        gazetteer = _yes_no(first.between(1, 223), first.isin(0) | (first > 239))
        varied = _yes_no(text.rlike("[0-9]{2}"))
    elif kind == "card":
        form = _yes_no((F.length(digits) == 16) | ((F.length(digits) == 15) & digits.rlike("^3[47]")))
        check = _yes_no(luhn(digits))
        gazetteer = _yes_no(digits.rlike(ISSUERS), F.lit(False))
        varied = _yes_no(F.size(F.array_distinct(F.split(digits, ""))) > 3)
    else:
        form = _yes_no(text.rlike(r"^\+|\("), F.lit(False))
        check = _yes_no(F.length(digits).between(8, 15))
        gazetteer = _yes_no(text.rlike(COUNTRIES), F.lit(False))
        varied = _yes_no(F.size(F.array_distinct(F.split(digits, ""))) > 2)
    word = rf"(?i)(?<![\p{{L}}])(?:{WORDS_BEFORE[kind]})[^\p{{L}}]*$"
    words = F.when(before.rlike(rf"(?i)(?:{OTHER_WORDS})[^\p{{L}}]*$"), 0).when(before.rlike(word), 1)
    joined = before.rlike(r"[\p{L}\p{N}_=/\\]$") | after.rlike(r"^[\p{L}\p{N}_/\\]")
    return {
        "form": form, "check": check, "gazetteer": gazetteer, "words": words,
        "neighbours": _yes_no(~joined), "digits": varied,
    }


def _side(character: Column) -> Column:
    return (
        F.when(character.rlike(r"[\p{L}]"), "letter")
        .when(character.rlike(r"\p{N}"), "digit")
        .when(character.rlike(r"[=\"'#/\\_&%$]"), "sign")
        .when(character.rlike(r"\p{P}"), "mark")
        .otherwise("space")
    )


def _traits(kind: str, span: Column, voted: dict[str, Column]) -> dict[str, Column]:
    text = span["text"]
    joint = lambda pattern, name: F.when(text.rlike(pattern), name).otherwise("")
    said = lambda name: F.coalesce(voted[name].cast("string"), F.lit("-"))
    return {
        "n_digits": F.least(F.length(digits_of(text)), F.lit(20)).cast("string"),
        "joints": F.concat(joint(" ", "s"), joint("-", "d"), joint(r"\.", "p"), joint(r"[(\[]", "b"), joint("@", "a"), joint(r"\+", "c")),
        "left": _side(F.right(span["before"], F.lit(1))),
        "right": _side(span["after"]),
        **{name: said(name) for name in ("words", "form", "check", "gazetteer", "neighbours")},
    }


def base_spans(text: Column) -> Column:
    """``kind, start, end`` of the base, by kind and start."""

    def of(kind: str) -> Column:
        found = F.filter(located(text, BASE[kind]), lambda s: holds(kind, s["text"]))
        spans = F.transform(
            found, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"),
                                      (s["start"] + F.length(s["text"])).alias("end"))
        )
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPANS))

    return F.concat(*[of(kind) for kind in KINDS])


def candidates(text: Column) -> Column:
    """``kind, start, end, votes, traits`` of all wide matches."""
    shape = "array<struct<kind:int,start:int,end:int,votes:string,traits:array<string>>>"

    def of(kind: str) -> Column:
        def judged(s: Column) -> Column:
            voted = votes(kind, s)
            traits = _traits(kind, s, voted)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"),
                (s["start"] + F.length(s["text"])).alias("end"),
                F.concat(*[F.coalesce(voted[n].cast("string"), F.lit("-")) for n in LABELERS]).alias("votes"),
                F.array(*[traits[n] for n in TRAITS]).alias("traits"),
            )

        found = F.transform(located(text, WIDE[kind]), judged)
        return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(shape))

    return F.concat(*[of(kind) for kind in KINDS])


def _log_odds(share: list[float], rates: dict[str, list[tuple[float, float]]]) -> Column:
    """Log odds that candidates who voted so are real; votes are independent given that."""
    table = []
    for kind in range(len(KINDS)):
        for name in LABELERS:
            a, b = rates[name][kind]
            table += [0.0, math.log((1 - a) / (1 - b)), math.log(a / b)]
    prior = F.element_at(F.array(*[F.lit(math.log(s / (1 - s))) for s in share]), F.col("kind") + 1)
    weight = F.array(*[F.lit(w) for w in table])
    vote = lambda k: F.instr(F.lit("-01"), F.substring("votes", k + 1, 1))
    place = lambda k: F.col("kind") * 3 * len(LABELERS) + 3 * k
    return reduce(add, [F.element_at(weight, place(k) + vote(k)) for k in range(len(LABELERS))], prior)


def _real(share, rates) -> Column:
    return 1 / (1 + F.exp(-_log_odds(share, rates)))


def estimate(patterns: DataFrame) -> tuple[list[float], dict[str, list[tuple[float, float]]]]:
    """Share of real spans by kind, and each labeler's rates, from ``kind, votes, n``.

    Each round is one aggregate over the counted patterns; what it returns is two sums for
    each kind, labeler and vote.
    """
    share = [PRIOR_SHARE for _ in KINDS]
    rates = {name: [PRIOR[name] for _ in KINDS] for name in LABELERS}
    said = F.array(*[F.concat(F.lit(f"{k}"), F.substring("votes", k + 1, 1)) for k in range(len(LABELERS))])
    for _ in range(ROUNDS):
        judged = patterns.select("kind", "n", (F.col("n") * _real(share, rates)).alias("real"), F.explode(said).alias("said"))
        sums = {
            (row["kind"], row["said"]): (row["real"], row["n"] - row["real"])
            for row in judged.groupBy("kind", "said").agg(F.sum("real").alias("real"), F.sum("n").alias("n")).collect()
        }
        moved = 0.0
        for kind in {k for k, _ in sums}:
            of = lambda labeler, votes, kind=kind: [
                sum(sums.get((kind, f"{labeler}{v}"), (0.0, 0.0))[side] for v in votes) for side in (0, 1)
            ]
            real, other = of(0, "-01")
            new = (real + PRIOR_SHARE * PRIOR_SPANS) / (real + other + PRIOR_SPANS)
            moved, share[kind] = max(moved, abs(new - share[kind])), new
            for k, name in enumerate(LABELERS):
                pair = tuple(
                    (yes + prior * PRIOR_VOTES) / (cast + PRIOR_VOTES)
                    for yes, cast, prior in zip(of(k, "1"), of(k, "01"), PRIOR[name])
                )
                moved = max(moved, *(abs(a - b) for a, b in zip(pair, rates[name][kind])))
                rates[name][kind] = pair
        if moved < STILL:
            break
    return share, rates


def train(patterns: DataFrame, share, rates) -> Column:
    """The classifier as a map from ``kind:trait:value`` to a weight; ``kind`` alone has the bias.

    ``patterns``: ``kind, votes, traits, n``. Each candidate counts as a real span for its
    probability and as another for the rest, plus one of either for each value of a trait.
    """
    judged = patterns.withColumn("real", _real(share, rates))
    each = judged.select("kind", "real", "n", F.posexplode("traits").alias("trait", "value"))
    counts = (
        each.groupBy("kind", "trait", "value")
        .agg(F.sum(F.col("n") * F.col("real")).alias("real"), F.sum(F.col("n") * (1 - F.col("real"))).alias("other"))
        .collect()
    )
    weights: dict[str, float] = {}
    for kind in {r["kind"] for r in counts}:
        for trait in range(len(TRAITS)):
            own = [r for r in counts if r["kind"] == kind and r["trait"] == trait]
            real, other = (sum(r[side] for r in own) + len(own) + 1 for side in ("real", "other"))
            for r in own:
                weights[f"{kind}:{trait}:{r['value']}"] = math.log((r["real"] + 1) / real) - math.log((r["other"] + 1) / other)
            if trait == 0:
                weights[f"{kind}"] = math.log(real / other)
    entries = [x for key, weight in sorted(weights.items()) for x in (F.lit(key), F.lit(weight))]
    return F.create_map(*entries) if entries else F.lit(None).cast("map<string,double>")


def _accepted(span: Column, weights: Column) -> Column:
    kind = span["kind"].cast("string")
    known = F.coalesce(F.try_element_at(weights, kind), F.lit(0.0))
    terms = F.transform(
        span["traits"],
        lambda value, i: F.coalesce(F.try_element_at(weights, F.concat_ws(":", kind, i.cast("string"), value)), F.lit(0.0)),
    )
    return F.aggregate(terms, known, lambda a, b: a + b) >= math.log(ACCEPT / (1 - ACCEPT))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``base`` and ``added``: arrays of ``kind`` (its place in ``KINDS``), ``start``, ``end``."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = stored(
        rows.select("id", base_spans(whole).alias("base"), candidates(whole).alias("candidates")), "personal-data"
    )
    patterns = stored(
        found.select(F.explode("candidates").alias("c"))
        .groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.traits").alias("traits"))
        .agg(F.count("*").alias("n")),
        "vote-patterns",
    )
    # At most 3^6 rows a kind: one task for each round.
    votes_only = stored(patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).coalesce(1), "votes")
    weights = train(patterns, *estimate(votes_only))

    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    accepted = F.transform(F.filter("candidates", lambda s: _accepted(s, weights)), place)
    more = found.select("id", "base", F.array_except(accepted, "base").alias("more"))
    free = more.withColumn("more", untouched(F.col("more"), F.col("base")))
    before = lambda kind: F.filter("more", lambda s: s["kind"] < kind)
    own = lambda kind: F.filter("more", lambda s: s["kind"] == kind)
    added = F.concat(*[untouched(own(kind), before(kind)) for kind in range(len(KINDS))])
    return free.select(F.col("id").alias(id_col), "base", added.alias("added"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
