"""Personal data: exact kinds by pattern, and unseen identifiers by bootstrapped context.

The four base kinds (email, ip, card, phone) are found by regular expressions with the
checks that belong to them. Their matches are the seeds. Four sorts of lexical pattern meet
an instance: the words before it with its shape (letters, digits and marks in runs), the two
words before it whatever its shape, the two words after it whatever its shape, and, for
instances that no base kind knows, the exact shape alone. A pattern is trusted when most of
the different instances it meets are already known. Trusted patterns vote for the unknown
instances that they meet; accepted ones become known, and the graph of patterns and
instances is scored again, until nothing is added or ``ROUNDS`` are over. So an instance of
a shape without any seed is reached by its words, and then carries its shape to other words.
Accepted instances become spans of the kind that their patterns have.

The words before, the words after and the shape count as independent votes; patterns of the
words before that differ in shape only do not add up, and words after do not suffice alone.

Positions come from the text between two matches: the expression gives it as a group of its
own, and a running sum over the matches of one document gives code points. Every expression
starts where the last match ended, so a text is read once per kind.

Defined cases: a null text is an empty text and has no spans; rows that repeat an id and
its text get equal results; null ids are treated as an id of their own; an empty table
gives an empty result; extra columns are not read. A discovered span that touches a base
span is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.session import stage_table

# The base kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# A run of characters that may precede a match is entered at its first character only (or
# where the last match ended); possessive repeats change no match and bound the work.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words with a digit or an at sign, with single blanks between them: what patterns look at.
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
# A quick test that a text can have a match at all.
_HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]", "run": "[0-9@]"}

TAIL = 80  # characters before and after an entity that its context words are taken from
MIN_SEEDS = 3  # different known instances behind a trusted pattern
TRUST = 0.8  # share of known instances among those that a pattern meets
ACCEPT = 0.9  # joint vote for an unknown instance
ROUNDS = 3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(_digits(match)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(
        F.filter(numbers, lambda d: d.isNotNull()),
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a kind passes the checks of that kind."""
    size = F.length(_digits(match))
    part = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", size.between(13, 19) & _luhn(match))
        .when(kind == "phone", size.between(9, 15))
        .otherwise(False)
    )


def _match_entry(kind: str):
    def entry(gap: Column, hit: Column) -> Column:
        before = F.substring(gap, -TAIL, TAIL)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.length(gap).alias("gap"),
            before.alias("before"),
            hit.alias("match"),
            F.lit(None).cast("string").alias("after"),
        )

    return entry


def _of_base_kind(kind: str):
    return lambda s: s["kind"] == kind


def matches(rows: DataFrame) -> DataFrame:
    """(k, th, kind, start, end, before, match, after) of (k, th, t): all matches, checked or not.

    ``before`` is the end of the text since the last match of the kind; ``after`` is the
    beginning of the text that follows a candidate run.
    """
    found = []
    for kind, pattern in {**_PATTERNS, "run": _CANDIDATE}.items():
        whole = F.lit(rf"(?s)\G(.*?)({pattern})")
        gaps = F.regexp_extract_all("t", whole, F.lit(1))
        hits = F.regexp_extract_all("t", whole, F.lit(2))
        pairs = F.zip_with(gaps, hits, _match_entry(kind))
        if kind == "run":
            ahead = F.lit(rf"(?s)\G(.*?)({pattern})(?=(.{{0,{TAIL}}}))")
            afters = F.regexp_extract_all("t", ahead, F.lit(3))
            pairs = F.zip_with(pairs, afters, lambda p, a: p.withField("after", a))
        possible = F.col("t").rlike(_HINTS[kind])
        of_kind = F.when(possible, F.transform(pairs, lambda p, i: F.struct(i.alias("nth"), p.alias("p"))))
        found.append(F.coalesce(of_kind, F.array()))
    flat = rows.filter(F.col("t").rlike("[0-9@]")).select("k", "th", F.explode(F.concat(*found)).alias("m"))
    flat = flat.select("k", "th", "m.nth", "m.p.*").distinct()  # rows may repeat
    order = Window.partitionBy("k", "th", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("match")).over(order).cast("bigint")
    return flat.withColumn("end", end).select(
        "k", "th", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "before", "match", "after"
    )


def _core(run: Column) -> Column:
    """A run without the marks around it."""
    return F.regexp_extract(run, r"(?s)^[^\p{L}\p{N}+(]*+(.*[\p{L}\p{N}])", 1)


def _known_kind(core: Column) -> Column:
    """The base kind that a run holds, if any."""
    kinds = []
    for kind, pattern in _PATTERNS.items():
        first = F.regexp_extract(core, pattern.replace(r"\G|", ""), 0)
        kinds.append(F.when((first != "") & valid(F.lit(kind), first), F.lit(kind)))
    return F.coalesce(*kinds)


def contexts(found: DataFrame) -> DataFrame:
    """Candidate runs with (instance, known, pattern): one row per pattern that meets them."""
    runs = found.filter("kind = 'run'").withColumn("core", _core(F.col("match")))
    size = F.length(_digits(F.col("core")))
    runs = runs.filter((F.length("core") >= 6) & ((size >= 4) | F.col("core").contains("@")))
    skipped = F.length(F.regexp_extract("match", r"^[^\p{L}\p{N}+(]*+", 0))
    runs = runs.withColumn("start", F.col("start") + skipped)
    runs = runs.withColumn("end", F.col("start") + F.length("core"))
    words = F.lower(F.regexp_replace("before", "[0-9]+", "0"))
    later = F.lower(F.regexp_replace("after", "[0-9]+", "0"))
    exact = F.regexp_replace(F.regexp_replace("core", r"\p{L}", "a"), "[0-9]", "9")
    shape = F.regexp_replace(F.regexp_replace("core", r"\p{L}+", "a"), "[0-9]+", "9")
    runs = runs.select(
        "k",
        "th",
        "start",
        "end",
        F.col("core").alias("instance"),
        _known_kind(F.col("core")).alias("known"),
        F.regexp_extract(words, r"(\S+)\s*$", 1).alias("one"),
        F.regexp_extract(words, r"(\S+\s+\S+)\s*$", 1).alias("two"),
        F.substring(shape, 1, 64).alias("shape"),
        # The edge of a text or of a neighbouring run stands for a word that is not there.
        F.regexp_extract(F.concat(F.lit("^ "), words), r"(\S+\s+\S+)\s*$", 1).alias("before"),
        F.regexp_extract(F.concat(later, F.lit(" $")), r"^\s*(\S+\s+\S+)", 1).alias("after"),
        F.when(F.length("core") <= 64, exact).alias("exact"),
    )
    pairs = [F.when(F.col(c) != "", F.concat_ws("\t", F.lit("w"), c, "shape")) for c in ("one", "two")]
    pairs += [F.when(F.col(c) != "", F.concat_ws("\t", F.lit(c[0]), c)) for c in ("before", "after")]
    pairs.append(F.when(F.col("known").isNull() & F.col("exact").isNotNull(), F.concat_ws("\t", F.lit("s"), "exact")))
    found = runs.withColumn("patterns", F.array_compact(F.array(*pairs)))
    return found.drop("one", "two", "shape", "before", "after", "exact")


def _vote() -> Column:
    """The joint vote of trusted patterns (pattern, trust) for one instance and kind."""
    doubt = F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))
    sort = F.substring("pattern", 1, 1)
    shaped = F.coalesce(F.sum(F.when(sort == "w", doubt)), F.lit(0.0))
    before, after, shape = [F.coalesce(F.min(F.when(sort == c, doubt)), F.lit(0.0)) for c in "bas"]
    own = F.least(shaped, before) + shape
    return F.when(own < 0, 1 - F.exp(own + after)).otherwise(0.0)


def bootstrap(runs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind) of the unknown instances that trusted patterns accept."""
    links = runs.select("instance", "known", F.explode("patterns").alias("pattern")).distinct()
    links = stage_table(links, "patterns")
    known = links.filter("known IS NOT NULL").select("instance", F.col("known").alias("kind")).distinct()
    met = links.groupBy("pattern").agg(F.count("*").alias("n"))
    accepted = None
    for _ in range(rounds):
        hits = links.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind")
        hits = hits.agg(F.count("*").alias("f")).filter(F.col("f") >= MIN_SEEDS)
        trusted = hits.join(met, "pattern").withColumn("trust", F.col("f") / F.col("n"))
        trusted = trusted.filter(F.col("trust") >= TRUST).select("pattern", "kind", "trust")
        votes = links.filter("known IS NULL").join(trusted, "pattern").join(known, "instance", "left_anti")
        vote = votes.groupBy("instance", "kind").agg(_vote().alias("vote")).filter(F.col("vote") >= ACCEPT)
        best = vote.groupBy("instance").agg(F.max(F.struct("vote", "kind")).alias("v"))
        new = stage_table(best.select("instance", "v.kind"), "accepted")
        if new.isEmpty():
            break
        accepted = new if accepted is None else accepted.union(new)
        known = known.union(new)
    if accepted is None:
        return links.filter("false").select("instance", F.col("known").alias("kind"))
    return accepted


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, th, kind, start, end, match, base): spans of whole texts, in code points."""
    return _spans(_keyed(docs, id_col, text_col))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k"),
        F.xxhash64(text).alias("th"),
        text.alias("t"),
    )


def _spans(rows: DataFrame) -> DataFrame:
    found = stage_table(matches(rows.select("k", "th", "t")), "matches")
    base = found.filter(F.col("kind") != "run").filter(valid(F.col("kind"), F.col("match")))
    base = base.select("k", "th", "kind", "start", "end", "match", F.lit(True).alias("base"))
    runs = stage_table(contexts(found), "runs")
    more = runs.filter("known IS NULL").join(bootstrap(runs), "instance")
    more = more.select("k", "th", "kind", "start", "end", F.col("instance").alias("match"), F.lit(False).alias("base"))
    return base.union(more)


def _listed(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and list of all spans, one row per row of ``docs``."""
    rows = _keyed(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind", "base")
    # All spans of one document: bounded by its own text.
    each = _spans(rows).groupBy("k", "th").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = rows.select("id", "k", "th").join(each, ["k", "th"], "left")
    spans = F.coalesce("spans", F.array())
    base = F.filter(spans, lambda s: s["base"])
    counts = [
        F.size(F.filter(base, _of_base_kind(kind))).cast("bigint").alias(f"n_{kind}")
        for kind in KINDS
    ]
    return out.select(
        F.col("id").alias(id_col),
        *counts,
        F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )
