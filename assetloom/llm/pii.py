"""Personal data by weak supervision. DataFrame functions only.

Regular expressions find candidate spans. Four labelers vote on each (+1, -1 or abstain): the strict
form, a gazetteer, the context and the neighbouring characters. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind; the resulting
probabilities train the final span classifier, a naive Bayes model over features of the span. Spans
of the strict forms always stay; the classifier decides about the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: The strict forms. Possessive repeats and the look-behind change no match: they only keep the
#: engine from trying again inside a run that has failed, so that long runs take linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
MAY_HOLD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Looser forms, all found in one pass: spelled-out addresses, IPv6 (whole, or with one gap), national phone numbers.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63})++| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})++)",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
_ANY_LOOSE = "|".join(LOOSE.values())
#: Fixed values of the gazetteer: common top-level domains and, as a pattern, the country calling codes in use.
TOP_DOMAINS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "ai", "co", "me", "tv", "app", "dev", "xyz", "online", "eu", "example", "test",
    "ae", "ar", "at", "au", "be", "bg", "br", "by", "ca", "ch", "cl", "cn", "cz", "de", "dk", "ee", "eg", "es", "fi", "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "ir", "is", "it",
    "jp", "ke", "kr", "kz", "lt", "lu", "lv", "ma", "mx", "my", "ng", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "sa", "se", "sg", "si", "sk", "th", "tn", "tr", "tw",
    "ua", "uk", "us", "uy", "ve", "vn", "za",
]
CALLING_CODES = "1|7|2(?:[07]|[1-689][0-9])|3(?:[0-4]|6|9|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9])"
#: Global, local and link addresses of IPv6.
V6_BLOCKS = r"(?i)^(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"\b(?:ip|host|server|address|addr|node|login)\b",
    "card": r"\b(?:card|visa|mastercard|credit|debit|pay|payment|tarjeta|carte|karte)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|tel[eé]fono)\b",
}
AGAINST = r"\b(?:version|ver|release|isbn|order|invoice|serial|section|chapter|build)\W*$"
VOTES = ("strict", "gazetteer", "context", "neighbours")
ROUNDS = 10


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _gazetteer(kind: str, x: Column) -> Column:
    """+1 for what the lists know, -1 for what can't be; unlisted domains and IPv6 blocks get no vote."""
    never = F.lit(False)
    if kind == "email":
        known = F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)
    elif kind == "ip":
        v6 = x.contains(":")
        taken = F.coalesce(F.regexp_extract(x, "^0*([0-9]{1,3})", 1).try_cast("int"), F.lit(1)).isin([0, *range(224, 1000)])
        known, never = F.when(v6, x.rlike(V6_BLOCKS)).otherwise(~taken), ~v6 & taken
    elif kind == "card":
        known = _digits(x).rlike(ISSUERS)
        never = ~known
    else:
        known = x.rlike(rf"^\+(?:{CALLING_CODES})") | x.rlike(r"^\(?[2-9]")
        never = ~known
    return _vote(known, never)


def _side(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\s"), "blank").otherwise("mark")


def _candidate(kind: str, x: Column, before: Column, after: Column, gap: Column, form: Column) -> Column:
    """The span's parts that later steps need: lengths, form, votes and features; not the text around."""
    context, left, right = F.lower(before), _side(F.right(before, F.lit(1))), _side(F.left(after, F.lit(1)))
    inside = left.isin("digit", "letter") | right.isin("digit", "letter")
    votes = F.array(
        F.when(form == "strict", 1).when(form == "failed", -1).otherwise(0),
        _gazetteer(kind, x),
        _vote(context.rlike(CONTEXT[kind]), context.rlike(AGAINST)),
        _vote(~inside, inside),
    )
    traits = F.array(
        F.concat(F.lit("form="), form), F.concat(F.lit("left="), left), F.concat(F.lit("right="), right),
        F.concat(F.lit("length="), F.least(F.floor(F.length(x) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("digits="), F.least(F.length(_digits(x)), F.lit(20)).cast("string")),
        F.concat(F.lit("gazetteer="), votes[1].cast("string")), F.concat(F.lit("context="), votes[2].cast("string")),
    )
    return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("place"), gap.alias("gap"), F.length(x).cast("bigint").alias("size"), form.alias("form"), votes.alias("votes"), traits.alias("traits"))


def _cuts(df: DataFrame, name: str, pattern: str, may_hold: str) -> DataFrame:
    """Adds the matches of a pattern and the pieces between them; both empty where no match can be."""
    here, empty = F.col("text").rlike(may_hold), F.array().cast("array<string>")
    return df.withColumns({f"{name}_found": F.when(here, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(empty), f"{name}_pieces": F.when(here, F.split("text", pattern, -1)).otherwise(empty)})


def candidates(docs: DataFrame) -> DataFrame:
    """(pii_row, doc_id, runs), one row for each row of ``docs``. pii_row numbers the rows.

    runs: an array for each search of the text, its candidates in the order of the text, each with
    the gap from the end of the one before and its length.
    """
    df = docs.select(F.monotonically_increasing_id().alias("pii_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _cuts(df, kind, STRICT[kind], MAY_HOLD[kind])
    df = _cuts(df, "loose", _ANY_LOOSE, _ANY_LOOSE)

    def around(name, make):
        pieces = F.col(f"{name}_pieces")
        return F.transform(F.col(f"{name}_found"), lambda x, i: make(x, F.right(F.get(pieces, i), F.lit(40)), F.left(F.get(pieces, i + 1), F.lit(1)), F.length(F.get(pieces, i)).cast("bigint")))

    def loose(x, before, after, gap):
        as_kind = lambda kind: _candidate(kind, x, before, after, gap, F.lit("loose"))
        return F.when(x.rlike(r"[\[(]at[\])]| at "), as_kind("email")).when(x.contains(":"), as_kind("ip")).otherwise(as_kind("phone"))

    strict = [around(kind, lambda x, before, after, gap, kind=kind: _candidate(kind, x, before, after, gap, F.when(_valid(kind, x), "strict").otherwise("failed"))) for kind in KINDS]
    return df.select("pii_row", "doc_id", F.array(*strict, around("loose", loose)).alias("runs"))


def placed(found: DataFrame) -> DataFrame:
    """(pii_row, kind, place, start, end, form, votes, traits, free), one row for each candidate.

    A running sum over each search gives the places in the text. free: whether no strict span
    overlaps the candidate, by the furthest end of those that start before it and the first start of
    the others. Windows do both, so a text with very many candidates takes little more than linear time.
    """
    runs = found.select("pii_row", F.posexplode("runs").alias("run", "candidates"))
    each = runs.select("pii_row", "run", F.posexplode("candidates").alias("i", "c")).select("pii_row", "run", "i", "c.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("pii_row", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # Both frames grow from their first row on: a frame that shrinks to its last row takes quadratic time.
    strict, of_text = F.col("form") == "strict", Window.partitionBy("pii_row")
    before = F.max(F.when(strict, F.col("end"))).over(of_text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(strict, F.col("start"))).over(of_text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    free = ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    return each.select("pii_row", "kind", "place", "start", "end", "form", "votes", "traits", free.alias("free"))


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[float]:
    """The probability that a span with each vote pattern is real; counts: (votes, number of spans).

    Labelers vote independently of each other, given whether the span is real. The start is the
    votes' sum; counts are smoothed by one.
    """
    def logistic(x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    q = [logistic(sum(votes)) for votes, _ in counts]
    for _ in range(rounds):
        real, not_real = (1 + sum(n * p for (_, n), p in zip(counts, side, strict=True)) for side in (q, [1 - p for p in q]))
        odds: dict[tuple[int, int], list[float]] = {}
        for (votes, n), p in zip(counts, q, strict=True):
            for key in enumerate(votes):
                both = odds.setdefault(key, [1.0, 1.0])
                both[0] += n * p
                both[1] += n * (1 - p)
        score = lambda key: math.log(odds[key][0] / (real + 2)) - math.log(odds[key][1] / (not_real + 2))  # noqa: E731, B023
        q = [logistic(math.log(real / not_real) + sum(map(score, enumerate(votes)))) for votes, _ in counts]
    return q


def reliabilities(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, q): the probability of each vote pattern that occurs, by expectation-maximisation for each kind.

    There are 81 patterns a kind at most; their counts are all that reaches the driver.
    """
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    out = []
    for kind in KINDS:
        own = sorted((tuple(r.votes), r.n) for r in counts if r.kind == kind)
        out += [(kind, list(votes), q) for (votes, _), q in zip(own, expectation_maximisation(own, rounds), strict=True)]
    return spans.sparkSession.createDataFrame(out, "kind string, votes array<int>, q double")


def classifier(spans: DataFrame, patterns: DataFrame) -> dict[str, float]:
    """Log odds by ``kind|trait``, and by ``kind`` alone: naive Bayes with the probabilities as soft labels.

    There is one row for each kind and value of a trait, some hundreds; that bounds what is collected.
    """
    # At most 324 vote patterns exist, which bounds the broadcast.
    soft = spans.join(F.broadcast(patterns.select("kind", "votes", "q")), ["kind", "votes"])
    each = soft.select("kind", "q", F.explode(F.concat(F.array(F.lit("")), F.col("traits"))).alias("trait"))
    rows = each.groupBy("kind", "trait").agg(F.sum("q").alias("p1"), F.sum(1 - F.col("q")).alias("p0")).collect()
    total = {r.kind: r for r in rows if r.trait == ""}
    odds = {k: math.log((r.p1 + 1) / (r.p0 + 1)) for k, r in total.items()}
    values = {}
    for r in rows:
        if r.trait:
            values[f"{r.kind}|{r.trait}"] = math.log((r.p1 + 1) / (total[r.kind].p1 + 2)) - math.log((r.p0 + 1) / (total[r.kind].p0 + 2))
    return odds | values


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, place, end, kind) by start, then kind; one row for each row of ``docs``.

    Places count code points from 0, ends excluded; null texts count as empty and have no spans.
    Repeated and null ids keep their rows; other columns are ignored; no rows give no rows. A span of
    the classifier never overlaps a strict one. One that fails its form's check (part above 255,
    check digit, number of digits), or that context or neighbours speak against (an order number, a part
    of a word), is evidence for the training but never a result. Each text is
    searched once: its candidates go to the shared folder and serve the votes, the training and the
    result. After that only candidates are shuffled, by the row that they come from.
    """
    found = cut(candidates(docs))
    spans = cut(placed(found.where(F.exists("runs", lambda run: F.size(run) > 0))))
    judged = spans.where((F.col("form") == "strict") | F.col("free"))
    odds = classifier(judged, reliabilities(judged))
    table = F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in (k, v)]) if odds else F.create_map().cast("map<string,double>")
    known = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    logit = F.aggregate("traits", known(F.col("kind")), lambda a, t: a + known(F.concat("kind", F.lit("|"), t)))
    doubted = (F.col("votes")[VOTES.index("context")] < 0) | (F.col("votes")[VOTES.index("neighbours")] < 0)
    extra = (F.col("form") == "loose") & F.col("free") & ~doubted & (logit > 0)
    span = F.struct("start", "place", "end", "kind")
    strict = F.col("form") == "strict"
    kept = spans.where(strict | extra).groupBy("pii_row").agg(F.array_sort(F.collect_list(F.when(strict, span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return found.select("pii_row", "doc_id").join(kept, "pii_row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
