"""Personal data in texts: overlapping candidate spans, boosted trees, calibrated thresholds.

Base spans are what fixed patterns and checks (octets, Luhn, numbers of digits) accept. Generators
of high recall propose further spans, which may overlap: numbers and addresses inside chains that
the base patterns swallow whole, groupings, spelled-out addresses, national numbers. Trees learn from
the form of a candidate and the text around it how likely a check is to accept it, on candidates of
the whole corpus counted by profile: a candidate counts as verified if it lies in a base span of its
kind, and is left out of learning if it is part of a longer match that was rejected. Thresholds are set per kind on held-out texts. A proposal above its threshold that overlaps no
base span becomes a span; of overlapping ones the longest stays, then the likeliest.

Everything is DataFrame expressions. Texts are read twice and never moved; the only shuffle is that
of profile counts. Places are prefix sums over the array of a text's matches, in a number of steps
that grows with its logarithm. No pattern goes back over a run it has read, so time stays in
proportion to a text's length.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm import boosting
from scrubline.llm.shared import held

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9  # of the proposals above a threshold, on held-out texts
LEAST = 10  # held-out proposals that a threshold rests on
FOLDS = 4  # one of them is held out
CONTEXT = 24  # characters before a candidate that are looked at

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# The base patterns with possessive loops. Starts inside a run of the same class cannot match where
# the run's start did not, unless the run begins at the end of the match before.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)"
PROPOSED = (
    # an address with its marks spelled out
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[({{]\x20?(?:at|AT|@)\x20?[\])}}]\x20?{_LABEL}++(?:{_DOT}{_LABEL}++)++"),
    # four octets inside a longer chain
    ("ip", rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])"),
    # an unbroken number or one in equal groups inside a longer chain
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    # numbers with a country's code that end before the chain does
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"),
    # national numbers
    ("phone", r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
HAS_ANY = r"@|[0-9]|[\[({]\x20?(?:at|AT)"  # every pattern's matches hold one of these

# Words before a candidate, by what they speak of.
ABOUT = (
    "mail", "tel|phone|fax|mobil|call", "card|visa|master|credit|account",
    "host|server|addr", "token|key|hash|order|serial|invoice",
)
FEATURES = [
    "kind", "digits", "luhn", "octets", "marks", "paren", "plus", "labels", "ending", "lead",
    "before", "after", "about",
]
MOST_MARKS, MOST_LABELS, MOST_ENDING = 5, 5, 4
DIGIT_STEPS = (0, 6, 7, 9, 10, 11, 12, 15, 16, 19)  # last number of digits of each class


@dataclass
class Model:
    """Fitted trees and the threshold of each kind; a kind without one adds nothing."""

    trees: boosting.Boosted | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


# --- spans of a text ----------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(values: Column, join) -> Column:
    """Running results of ``join`` over an array, by doubling: each step reaches twice as far back."""

    def step(sofar, k):
        return let(
            F.pow(F.lit(2.0), k).cast("int"),
            lambda back: F.transform(
                sofar, lambda x, i: F.when(i >= back, join(x, F.get(sofar, i - back))).otherwise(x)
            ),
        )

    def doubled(known):
        steps = F.when(
            F.size(known) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(known))).cast("int") - 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, known, step)

    return let(values, doubled)


def matches(text: Column, pattern: Column, also: Column) -> Column:
    """Leftmost non-overlapping matches: ``also``, ``start`` and ``stop`` in characters, ``value``, the
    characters before and the one after.

    The pieces between the matches and the matches themselves add up to the places.
    """

    def placed(pieces, values, stops):
        return F.transform(
            values,
            lambda v, i: F.struct(
                also.alias("also"),
                (F.get(stops, i) - F.length(v)).cast("bigint").alias("start"),
                F.get(stops, i).cast("bigint").alias("stop"),
                v.alias("value"),
                F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("before"),
                F.substring(F.get(pieces, i + 1), 1, 1).alias("after"),
            ),
        )

    def lengths(pieces, values):
        return F.transform(values, lambda v, i: F.length(v) + F.length(F.get(pieces, i)))

    return let(
        F.split(text, pattern, -1),
        lambda pieces: let(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda values: let(
                scan(lengths(pieces, values), lambda x, y: x + y),
                lambda stops: placed(pieces, values, stops),
            ),
        ),
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether up to 19 digits have the check sum of card numbers."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(each, lambda d, i: d.cast("int") * (i % 2 + 1))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.when(F.length(digits).between(2, 19), total % 10 == 0).otherwise(False)


def octets_fit(value: Column) -> Column:
    """Whether the dotted numbers are at most 255; zeros before a number do not count."""
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def accepted(kind: Column, value: Column) -> Column:
    """The check of a base match, by the number of its kind."""
    email, ip, card, _ = range(len(KINDS))
    n = F.length(digits_of(value))
    return (
        F.when(kind == email, True)
        .when(kind == ip, octets_fit(value))
        .when(kind == card, n.between(16, 19) & passes_luhn(digits_of(value)))
        .otherwise(n.between(8, 15))
    )


GOOD, BAD, OPEN = range(3)  # a base match that passes its check, one that fails, a candidate


def _searched(text: Column) -> Column:
    """All matches of all patterns with ``kind`` and ``state``, by pattern, then place."""
    table = [(k, True, BASE[k]) for k in KINDS] + [(k, False, p) for k, p in PROPOSED]
    patterns = F.array(
        *[
            F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(sure).alias("sure"), F.lit(p).alias("pattern"))
            for k, sure, p in table
        ]
    )

    def rated(m):
        kind, value = m["also"]["kind"], m["value"]
        state = F.when(~m["also"]["sure"], OPEN).when(accepted(kind, value), GOOD).otherwise(BAD)
        kept = [m[n].alias(n) for n in ("start", "stop", "value", "before", "after")]
        return F.struct(kind.alias("kind"), state.alias("state"), *kept)

    def found(looked):
        each = F.transform(patterns, lambda p: matches(looked, p["pattern"], p))
        return F.transform(F.flatten(each), rated)

    return let(F.when(text.rlike(HAS_ANY), text).otherwise(""), found)


def _marked(found: Column) -> Column:
    """Every match as a candidate, each span once, with three marks: ``inside`` a base span of its
    kind; ``chained``, part of a longer match of its kind that was rejected; ``clear`` of all base spans.

    Matches and candidates are sorted together; the farthest stop of the matches before and the
    nearest start of those after decide, so that no candidate meets every match. Matches of one kind
    do not overlap, so the farthest is also the last.
    """
    none, far = F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")
    shown = ("value", "before", "after")

    def entry(x, state, *names):
        texts = [(x[n] if n in names else F.lit(None).cast("string")).alias(n) for n in shown]
        return F.struct(x["start"].alias("start"), state.alias("state"), x["stop"].alias("stop"), x["kind"].alias("kind"), *texts)

    def reach(both, counts, place):
        places = F.transform(both, lambda x: F.when(counts(x), x[place]).otherwise(none))
        return scan(places, lambda x, y: F.greatest(x, y))

    def next_start(both):
        starts = F.transform(both, lambda x: F.when(x["state"] == GOOD, x["start"]).otherwise(far))
        return F.reverse(scan(F.reverse(starts), lambda x, y: F.least(x, y)))

    def by_kind(both, state, place):
        numbers = F.array(*map(F.lit, range(len(KINDS))))
        return F.transform(
            numbers, lambda k: reach(both, lambda x: (x["state"] == state) & (x["kind"] == k), place)
        )

    def decided(both, known):
        def mark(x, i):
            at = lambda name: F.get(F.get(known[name], x["kind"]), i)
            itself = (at("bad_start") == x["start"]) & (at("bad_stop") == x["stop"])
            last = F.get(both, i - 1)
            # two patterns may find one span; equal ones lie next to each other
            again = F.coalesce(
                (last["state"] == OPEN) & (last["start"] == x["start"]) & (last["stop"] == x["stop"]) & (last["kind"] == x["kind"]),
                F.lit(False),
            )
            return F.struct(
                ((x["state"] == OPEN) & ~again).alias("counts"),
                *[x[n].alias(n) for n in ("kind", "start", "stop", *shown)],
                (at("good_stop") >= x["stop"]).alias("inside"),
                ((at("bad_stop") >= x["stop"]) & ~itself).alias("chained"),
                ((F.get(known["any"], i) <= x["start"]) & (F.get(known["next"], i) >= x["stop"])).alias("clear"),
            )

        return F.filter(F.transform(both, mark), lambda x: x["counts"])

    both = F.array_sort(
        F.concat(
            F.transform(F.filter(found, lambda x: x["state"] != OPEN), lambda x: entry(x, x["state"])),
            F.transform(found, lambda x: entry(x, F.lit(OPEN), *shown)),
        )
    )
    return let(
        both,
        lambda both: let(
            F.struct(
                reach(both, lambda x: x["state"] == GOOD, "stop").alias("any"),
                by_kind(both, GOOD, "stop").alias("good_stop"),
                by_kind(both, BAD, "stop").alias("bad_stop"),
                by_kind(both, BAD, "start").alias("bad_start"),
                next_start(both).alias("next"),
            ),
            lambda known: decided(both, known),
        ),
    )


def _features(c: Column) -> dict[str, Column]:
    """The features of a candidate, small whole numbers."""
    value, digits = c["value"], digits_of(c["value"])
    n = F.length(digits)
    steps = reduce(lambda s, k: s + (n > k).cast("int"), DIGIT_STEPS, F.lit(0))
    # dots may be spelled out in an address
    plain = F.regexp_replace(value, r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?", ".")
    ending = F.regexp_extract(plain, r"\.([A-Za-z]+)$", 1)
    domain = F.regexp_extract(plain, r"(?:@|at|AT)[\])}]?\x20?([A-Za-z0-9.-]+)$", 1)
    last, lead = F.substring(c["before"], -1, 1), F.substring(digits, 1, 1)

    def sort_of(x: Column) -> Column:
        return (
            F.when(F.length(x) == 0, 0).when(x.rlike(r"^\s"), 1).when(x.rlike(r"^\p{L}"), 2)
            .when(x.rlike("^[0-9]"), 3).when(x.rlike("^[=:\"'(<\\[]"), 4).otherwise(5)
        )

    about = F.lit(0)
    for number, words in reversed(list(enumerate(ABOUT, start=1))):
        about = F.when(F.lower(c["before"]).rlike(words), number).otherwise(about)
    is_email = c["kind"] == KINDS.index("email")
    number = lambda x: F.when(is_email, 0).otherwise(x)
    return {
        "kind": c["kind"],
        "digits": number(steps),
        "luhn": number(passes_luhn(digits).cast("int")),
        "octets": F.when(c["kind"] == KINDS.index("ip"), octets_fit(value).cast("int")).otherwise(2),
        "marks": number(F.least(F.length(F.regexp_replace(value, r"[0-9+()]", "")), F.lit(MOST_MARKS))),
        "paren": number(value.contains("(").cast("int")),
        "plus": number(value.startswith("+").cast("int")),
        "labels": F.when(is_email, F.least(F.size(F.split(domain, r"\.")), F.lit(MOST_LABELS))).otherwise(0),
        "ending": F.when(is_email, F.least(F.length(ending), F.lit(MOST_ENDING))).otherwise(0),
        "lead": number(F.coalesce(lead.try_cast("int"), F.lit(10))),
        "before": sort_of(last),
        "after": sort_of(c["after"]),
        "about": about,
    }


# --- learning and applying ----------------------------------------------------------------------


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``base`` and ``proposed`` with what the trees look at; null is empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("text"))

    def spans(found):
        base = F.transform(
            F.filter(found, lambda x: x["state"] == GOOD),
            lambda x: F.struct(*[x[n].alias(n) for n in ("kind", "start", "stop")]),
        )
        return F.struct(base.alias("base"), _marked(found).alias("proposed"))

    found = let(_searched(F.col("text")), spans)
    rows = rows.select("doc_id", "text", found.alias("found"))
    return rows.select("doc_id", "text", "found.base", "found.proposed")


def profiles(docs: DataFrame, text: str = "text") -> DataFrame:
    """Candidates of all texts counted by features and fold; ``verified`` lie in base spans.

    Parts of a longer rejected match are left out: no check says what they are.
    Counts are summed inside each task, so the shuffle holds combinations of features, not texts.
    """
    numbered = docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text"))
    found = candidates(numbered)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    open_or_sure = F.filter("proposed", lambda c: ~c["chained"])
    each = found.select(fold, F.explode(open_or_sure).alias("c"))
    columns = [x.cast("int").alias(f) for f, x in _features(F.col("c")).items()]
    rows = each.select("fold", *columns, F.col("c.inside").cast("int").alias("verified"))
    return rows.groupBy("fold", *FEATURES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("verified").alias("verified")
    )


def train(docs: DataFrame, text: str = "text", precision: float = PRECISION, least: int = LEAST) -> Model:
    """Trees and thresholds from all candidates of ``docs``; the fold of a text is a hash of it."""
    counted = held(profiles(docs, text), "profiles")
    trees = boosting.fit(counted.where(F.col("fold") != 0), FEATURES)
    if trees is None:
        return Model()
    by_kind = boosting.thresholds(counted.where(F.col("fold") == 0), trees, "kind", precision, least)
    return Model(trees, {KINDS[k]: t for k, t in by_kind.items()})


def find_private(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text``, ``base`` and ``added``.

    ``base`` and ``added`` are arrays of ``(kind, start, stop)`` in characters, the stop exclusive,
    by kind in the order of ``KINDS`` (its number), then place; ``added`` has ``probability`` too. Added spans
    overlap neither base spans nor each other; base spans of different kinds may overlap. A null text
    is empty and has no spans. Null ids, repeated ids and repeated rows are rows like any other; other columns, whatever their names, are
    not read. An empty table gives an empty result, and a model without trees adds nothing. Whole texts are read, however long.
    """
    found = candidates(docs, key, text)
    nothing = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,probability:double>>")
    if model.trees is None or not model.thresholds:
        return found.select("doc_id", "text", "base", nothing.alias("added"))
    scored = F.transform(
        F.filter("proposed", lambda c: c["clear"]),
        lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"),
            F.struct(*[x.cast("int").alias(f) for f, x in _features(c).items()]).alias("f"),
        ),
    )
    rows = found.select("doc_id", "text", "base", scored.alias("scored"))
    rated = F.transform(
        "scored",
        lambda c: F.struct(
            c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"),
            model.trees.probability(lambda name: c["f"][name]).alias("probability"),
        ),
    )
    rows = rows.select("doc_id", "text", "base", rated.alias("rated"))
    least = F.lit(2.0)
    chosen = F.filter("rated", lambda c: c["probability"] >= _threshold(model, c["kind"], least))
    rows = rows.select("doc_id", "text", "base", F.array_sort(chosen).alias("chosen"))

    def better(kept, c):
        """``c`` against the last one kept: next to it, in its place, or not at all."""
        last = F.get(kept, F.size(kept) - 1)
        apart = (F.size(kept) == 0) | (last["stop"] <= c["start"])
        length, other = c["stop"] - c["start"], last["stop"] - last["start"]
        wins = (length > other) | ((length == other) & (c["probability"] > last["probability"]))
        return (
            F.when(apart, F.concat(kept, F.array(c)))
            .when(wins, F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(c)))
            .otherwise(kept)
        )

    start = F.array().cast("array<struct<start:bigint,stop:bigint,kind:int,probability:double>>")
    kept = F.aggregate("chosen", start, better)
    added = F.transform(
        kept,
        lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["probability"].alias("probability")
        ),
    )
    return rows.select("doc_id", "text", "base", F.array_sort(added).alias("added"))


def _threshold(model: Model, kind: Column, otherwise: Column) -> Column:
    out = otherwise
    for name, value in model.thresholds.items():
        out = F.when(kind == KINDS.index(name), F.lit(value)).otherwise(out)
    return out


def count_of(kind: str) -> Column:
    """How many base spans of ``find_private`` are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of spans in their order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",",
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
        ),
    )


def all_spans() -> Column:
    """Base and added spans of ``find_private`` by kind, then place."""
    plain = F.transform(
        "added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    )
    return F.array_sort(F.concat(F.col("base"), plain))


def redact(found: DataFrame) -> DataFrame:
    """``doc_id`` and ``redacted``: each run of covered characters gives way to its first kind in brackets.

    Takes the rows of ``find_private``. Each run costs a walk through its text.
    """
    spans = F.array_sort(
        F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    rows = found.select("doc_id", "text", spans.alias("spans"))
    reach = scan(F.transform("spans", lambda s: s["stop"]), lambda x, y: F.greatest(x, y))
    rows = rows.select("doc_id", "text", "spans", reach.alias("reach"))
    opens = F.filter(
        F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(F.col("reach"), i - 1), F.lit(-1)).alias("before"))),
        lambda s: s["start"] > s["before"],
    )
    rows = rows.select("doc_id", "text", "reach", opens.alias("opens"))
    names = F.array(*map(F.lit, KINDS))
    pieces = F.transform(
        "opens",
        lambda s: F.concat(
            F.col("text").substr(F.greatest(s["before"], F.lit(0)).cast("int") + 1, (s["start"] - F.greatest(s["before"], F.lit(0))).cast("int")),
            F.lit("["), F.get(names, s["kind"]), F.lit("]"),
        ),
    )
    end = F.coalesce(F.get(F.col("reach"), F.size("reach") - 1), F.lit(0))
    rest = F.col("text").substr(end.cast("int") + 1, F.length("text") + F.lit(1))
    return rows.select("doc_id", F.concat(F.array_join(pieces, ""), rest).alias("redacted"))
