"""PII by bootstrapped contextual extraction, in native expressions.

Base spans (email, ip, card, phone) are the seeds. Candidates that look like identifiers, blanks between
groups of digits included, and the two words before them form a graph of instances and lexical patterns. A pattern's score for a kind is the
confidence-weighted share of its occurrences that are instances of the kind (a seed counts 1); an
instance's confidence combines the scores of the patterns it occurs with. The two are computed in turn
until a round finds nothing new; instances that good patterns vouch for are the unseen identifiers, and
give added spans wherever they stand.

Positions in code points come from cutting a text at its matches: the lengths of what lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The four patterns, written so that a scan is linear and never recurses: runs do not give back
# characters, and a match can only begin where a run begins or where the match before has ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
# A candidate is a word with a digit or @, a number written in neighbouring groups of digits, or what begins like a
# phone number. Groups belong together over one or two blanks; each ends at white space, before it at most one mark.
SPACE = r"\x20\x09-\x0D"
GROUP = rf"\(?+[0-9][0-9()-]*+(?![^{SPACE}.,;:!?]|[.,;:!?][^{SPACE}])"
TOKEN = rf"(?<![^{SPACE}])(?:\(?+\+[0-9][\x20().0-9-]*+|\+?+{GROUP}(?:\x20{{1,2}}+{GROUP})++|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)"
CONTEXT = r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)[^\x20\x09-\x0D]++[\x20\x09-\x0D]++$"
# An identifier has so many characters and digits; a pattern is used from so many distinct instances and such a score.
CHARACTERS, DIGITS, SUPPORT, CONFIDENCE = 6, 3, 3, 0.8
KEY = 64  # longer cores are told apart by their SHA-256
OCCURRENCE = "array<struct<start:bigint,end:bigint,match:string,before:string>>"


def occurrences(text: Column, pattern: str) -> Column:
    """Array of start, end (code points, end exclusive), match and the text since the match before."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast(OCCURRENCE)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["before"])
        end = start + F.char_length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    both = F.arrays_zip(found.alias("match"), F.slice(pieces, F.lit(1), F.size(found)).alias("before"))
    return F.aggregate(both, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found")), add)["found"]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), weigh), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind == "card":
        return F.when(F.char_length(_digits(match)).between(12, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


def _span(x: Column, kind: int) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _spans(every: Column, kind: int) -> Column:
    return F.transform(F.filter(every, lambda x: _valid(KINDS[kind], x["match"])), lambda x: _span(x, kind))


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind, end); kind is the place in KINDS."""
    parts = []
    for i, kind in enumerate(KINDS):
        there = F.instr(text, NEEDS[kind]) > 0 if kind in NEEDS else text.rlike("[0-9]")
        every = F.when(there, occurrences(text, PATTERNS[kind])).otherwise(F.array().cast(OCCURRENCE))
        parts.append(_spans(every, i))
    return F.array_sort(F.concat(*parts))


def _tokens(text: Column) -> Column:
    """Candidates with the two words before them: start, end, core, context ('' without two words there)."""
    every = F.when(text.rlike("[0-9@]"), occurrences(text, TOKEN)).otherwise(F.array().cast(OCCURRENCE))

    def trim(x: Column) -> Column:
        core = F.regexp_replace(x["match"], r"^[^\p{L}0-9+(]++", "")
        start = x["end"] - F.char_length(core)
        core = F.regexp_replace(core, r"[^\p{L}0-9]+$", "")
        context = F.lower(F.trim(F.regexp_replace(F.regexp_extract(x["before"], CONTEXT, 0), r"[\x20\x09-\x0D]+", " ")))
        return F.struct(start.alias("start"), (start + F.char_length(core)).alias("end"), core.alias("core"), context.alias("context"))

    # A word before may itself be a candidate (lists); it then ended the stretch and there is no context.
    return F.filter(F.transform(every, trim), lambda x: F.char_length(x["core"]) >= CHARACTERS)


def _label(spans: Column, token: Column) -> Column:
    """Kind of the first base span that overlaps a token; null where none does."""
    hit = F.filter(spans, lambda s: (s["start"] < token["end"]) & (token["start"] < s["end"]))
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)["kind"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document without its text: doc_id, base, tokens (with known: the kind of a base span there)."""
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("_text"))
    rows = rows.select("doc_id", base_spans(F.col("_text")).alias("base"), _tokens(F.col("_text")).alias("tokens"))

    def node(t: Column) -> Column:
        key = F.when(F.char_length(t["core"]) > KEY, F.sha2(t["core"].cast("binary"), 256)).otherwise(t["core"])
        known = _label(F.col("base"), t)
        likely = (F.char_length(_digits(t["core"])) >= DIGITS) | F.contains(t["core"], F.lit("@")) | known.isNotNull()
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), key.alias("core"), t["context"].alias("context"), known.alias("known"), likely.alias("likely"))

    nodes = F.filter(F.transform("tokens", node), lambda t: t["likely"])
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", nodes.alias("tokens"))


def bootstrap(pairs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """core, kind, confidence of the instances that patterns discover.

    ``pairs``: context, core, known (kind of a seed or null), n. Each round joins patterns and instances
    as tables and writes the instances that are new; a frequent context or instance is one row per
    partner. An instance keeps the kind and confidence of the round that found it, so every round adds
    instances or is the last, and chains of any length are followed.
    """
    totals = pairs.groupBy("context").agg(F.sum("n").alias("all"))
    seeds = pairs.where("known IS NOT NULL").select("core", F.col("known").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
    links = pairs.groupBy("context", "core").agg(F.sum("n").alias("n"))
    believed, discovered = seeds, None
    while True:
        heads = links.join(believed, "core").groupBy("context", "kind").agg(
            F.sum(F.col("n") * F.col("confidence")).alias("hits"), F.count(F.lit(1)).alias("instances")
        )
        patterns = heads.join(totals, "context").withColumn("score", F.least(F.col("hits") / F.col("all"), F.lit(1.0)))
        patterns = patterns.where((F.col("instances") >= support) & (F.col("score") >= confidence))
        miss = F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))
        found = links.join(patterns.select("context", "kind", "score"), "context").groupBy("core", "kind").agg((1 - F.exp(F.sum(miss))).alias("confidence"))
        found = found.where(F.col("confidence") >= confidence).join(believed.select("core"), "core", "left_anti")
        best = found.groupBy("core").agg(F.min_by("kind", F.struct(-F.col("confidence"), F.col("kind"))).alias("kind"), F.max("confidence").alias("confidence"))
        new = materialize(best, "instances")
        if new.isEmpty():
            return new if discovered is None else discovered
        discovered = new if discovered is None else materialize(discovered.unionByName(new), "instances")
        believed = seeds.unionByName(discovered)


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added for every row of ``docs`` (doc_id, text).

    Counts and base_sha256 cover the base spans; spans also has the n of ``added`` spans that patterns
    discovered, under the kind of the seeds that induced the pattern. Null and empty texts have no span.
    Of repeated rows each is scanned; their identifiers count as often as they are given. An identifier
    is discovered in every place, also in lists and in the first words of a text, where no two words vouch for it.
    """
    rows = materialize(scan(docs), "pii-scan")
    tokens = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    pairs = tokens.where("context != ''").groupBy("context", "core", "known").agg(F.count(F.lit(1)).alias("n"))
    discovered = bootstrap(materialize(pairs, "pii-pairs"), support, confidence)
    added = tokens.where("known IS NULL").join(discovered.select("core", "kind"), "core")
    added = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))
    out = rows.drop("tokens").join(added, "row", "left")
    more = F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).alias("added"),
    )
