"""Personal data and the terms that give it away, with DataFrame functions alone.

Entities (email and IP addresses, card and phone numbers) are found by pattern. A term tells of a subject, which is one
entity or any entity of a kind, as far as it occurs in documents with the subject and nowhere else: over documents,
with N of them,

    PMI(term; subject) = log2(N n(term, subject) / (n(term) n(subject))),   IC(subject) = log2(N / n(subject)),

and a term that always comes with the subject discloses all of its information (PMI = IC). Terms that disclose at
least ``DISCLOSE`` of a subject's information are generalised to a label, those above ``REMOVE`` removed, wherever
they stand, if the corpus is evidence for it:

- Copies of a text are one piece of evidence, not many. Documents with the same least hash of their terms, which near
  copies mostly share, are a family; common documents of term and subject, and documents of the subject, count by
  family. Of a subject known from one family only nothing can be told but by its kind.
- The probability of so many common documents by chance is at most exp(-n D(k/n || m/N)) for k of n documents of the
  term among the subject's m, and for both the other way round (tail bound of the hypergeometric distribution).
- Millions of pairs are tested, so this bound is held against the Benjamini-Hochberg limit: of all pairs taken to
  disclose, the expected share of chance ones is ``FALSE_SHARE`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.llm.tables import saved, small

DISCLOSE, REMOVE = 0.8, 0.95
FALSE_SHARE = 0.05
#: Bounds of probability are compared in steps of a tenth of their logarithm, down to exp(-_DEEPEST / 10).
_DEEPEST = 7000

# Repeated groups are possessive, as others recurse once for each repeat. Each starts where the plain pattern's leftmost match would, but looks at a run of characters once: at its beginning,
# or (\G) right after the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    # a whole chain of digits, at most one space or hyphen between any two, if it has 16 to 19 digits
    "card": r"(?<![0-9]|[0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a search of the pattern to be worth while.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
_CHUNK = 512


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[ -]", ""))
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _is_ip(value: Column) -> Column:
    def small_part(part: Column) -> Column:
        digits = F.concat(F.lit("0"), F.ltrim(part, F.lit("0")))
        return (F.length(digits) <= 4) & (F.right(digits, F.lit(4)).cast("int") <= 255)

    return F.forall(F.split(value, "[.]"), small_part)


def _is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


_VALID = {"email": lambda v: F.lit(True), "ip": _is_ip, "card": _luhn, "phone": _is_phone}


def _before(values: Column, merge) -> Column:
    """For each element of a non-empty array of whole numbers from 0 what ``merge`` makes of those before it.

    Arrays grow by copying, so results are built in chunks, first within each and then over their totals.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def running(numbers: Column, of) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(
                merge(acc["total"], of(x)).cast("bigint").alias("total"),
                F.concat(acc["before"], F.array(acc["total"])).alias("before"),
            )

        return F.aggregate(numbers, start, step)

    chunks = F.sequence(F.lit(0), ((F.size(values) - 1) / _CHUNK).cast("int"))
    inner = F.transform(chunks, lambda c: running(F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)), lambda x: x))
    outer = running(inner, lambda x: x["total"])["before"]
    return F.flatten(F.zip_with(inner, outer, lambda x, base: F.transform(x["before"], lambda v: merge(v, base).cast("bigint"))))


def _found(text: str, pattern: str, where: Column) -> tuple[Column, Column]:
    """Matches of a pattern and the stretches before, between and after them; no match unless ``where``."""
    none = F.array().cast("array<string>")
    matches = F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(where, F.split(text, pattern, -1)).otherwise(none)
    return matches, gaps


def _spans(matches: str, gaps: str) -> Column:
    """``start, end, value`` of each match; places are code points, the end exclusive."""
    ahead = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    g, m = F.col(gaps), F.col(matches)
    # zipped, so that the sums are built once and not anew for every match
    parts = F.arrays_zip(
        m.alias("value"),
        F.slice(_before(ahead, lambda x, y: x + y), 1, F.size(m)).alias("before"),
        F.slice(g, 1, F.size(m)).alias("left"),
    )

    def span(z: Column) -> Column:
        start = z["before"] + F.length(z["left"])
        return F.struct(start.alias("start"), (start + F.length(z["value"])).alias("end"), z["value"].alias("value"))

    each = F.transform(parts, span)
    return F.when(F.size(m) > 0, each).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    )


def entities(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and, for each kind of entity, an array of ``start, end, value``.

    Matches are leftmost and do not overlap; those that fail their kind's test are dropped without another try.
    A null text is an empty one.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        hint = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(_HINTS[kind])
        matches, gaps = _found("text", pattern, hint)
        out = out.withColumns({"_m": matches, "_g": gaps})
        out = out.withColumn("_s", _spans("_m", "_g"))
        valid = _VALID[kind]
        out = out.withColumn(kind, F.filter("_s", lambda s: valid(s["value"]))).drop("_m", "_g", "_s")  # noqa: B023
    return out


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _evidence(n: Column, common: Column, n_term: Column, n_subject: Column) -> Column:
    """Minus the logarithm of a bound of the probability of so many common documents or more by chance."""

    def bound(drawn: Column, marked: Column) -> Column:
        x, p = common / drawn, marked / n
        rest = F.when(x < 1, (1 - x) * F.ln((1 - x) / (1 - p))).otherwise(F.lit(0.0))
        return F.when(x > p, drawn * (x * F.ln(x / p) + rest)).otherwise(F.lit(0.0))

    return F.greatest(bound(n_term, n_subject), bound(n_subject, n_term))


def _own_id(doc_id: str = "doc_id") -> Column:
    """Of any type, also where it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))


def pair_counts(docs: DataFrame, disclose: float = DISCLOSE) -> tuple[DataFrame, float]:
    """Pairs that disclose enough, before they are held against chance, and the number of all pairs.

    ``term, subject, disclosed, evidence``. All terms of a document meet all of its subjects of more than one family.
    As n(term, subject) <= n(subject), a term in more than N^(1 - disclose) n(subject)^disclose documents cannot
    disclose enough; of single entities such pairs are left out before they are made.
    """
    own = docs.select(_own_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    words = own.select("id", F.explode(_terms(F.col("text"))).alias("term"))
    ids = own.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = saved(ids.filter("rows > 1"), "repeated")
    further = repeated.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))).first()[0]
    n = F.lit(float(own.count() - further))
    if further:  # rows of one id are one document
        again = words.join(small(repeated.select("id")), "id", "left_semi").distinct()
        words = words.join(small(repeated.select("id")), "id", "left_anti").unionByName(again)
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))

    found = entities(docs).select(_own_id().alias("id"), "text", *PATTERNS)
    each = [F.transform(k, lambda s: F.concat(F.lit(k + ":"), F.lower(s["value"]))) for k in PATTERNS]  # noqa: B023
    kinds = F.filter(F.array(*[F.when(F.size(k) > 0, F.lit(k)) for k in PATTERNS]), lambda k: k.isNotNull())
    some = found.filter(" or ".join(f"size({k}) > 0" for k in PATTERNS)).select(
        "id", kinds.alias("kinds"), F.array_distinct(F.concat(*each)).alias("each"), _terms(F.col("text")).alias("terms")
    )
    family = F.coalesce(F.array_min(F.transform("terms", lambda t: F.xxhash64(t))), F.lit(0))
    some = saved(some.withColumn("family", family), "subjects")
    met = some.select("id", "family", F.explode(F.concat("kinds", "each")).alias("subject"))
    met = met.groupBy("id", "subject").agg(F.min("family").alias("family"))
    subjects = met.groupBy("subject").agg(F.count(F.lit(1)).alias("n_subject"), F.countDistinct("family").alias("f_subject"))
    subjects = saved(subjects.filter("f_subject > 1"), "tested")
    met = saved(met.join(small(subjects), "subject"), "met")
    near = some.select("id", F.explode("terms").alias("term"))
    if further:
        near = near.distinct()
    sizes = met.groupBy("id").agg(F.count(F.lit(1)).alias("subjects"))
    tested = some.select("id", F.size("terms").alias("terms")).join(sizes, "id")
    tested = tested.agg(F.coalesce(F.sum(F.col("terms").cast("double") * F.col("subjects")), F.lit(0.0))).first()[0]

    few = 1.000001 * F.pow(n, F.lit(1 - disclose))
    of_kind = met.filter(~F.contains("subject", F.lit(":")))
    single = met.filter(F.contains("subject", F.lit(":")))
    tops = single.groupBy("id").agg(F.max("n_subject").alias("top"))
    rare = near.join(tops, "id").join(n_term, "term").filter(F.col("n_term") <= few * F.pow("top", F.lit(disclose)))
    pairs = rare.select("id", "term").join(single, "id").unionByName(near.join(of_kind, "id"), allowMissingColumns=True)
    counted = pairs.groupBy("term", "subject").agg(
        F.count(F.lit(1)).alias("n_both"),
        F.countDistinct("family").alias("f_both"),
        F.first("n_subject").alias("n_subject"),
        F.first("f_subject").alias("f_subject"),
    )
    counted = counted.join(n_term, "term").filter(F.col("n_term") <= few * F.pow("n_subject", F.lit(disclose)))
    pmi = F.log2(n * F.col("n_both") / (F.col("n_term") * F.col("n_subject")))
    # a subject in every document holds no information
    share = F.when(F.col("n_subject") < n, pmi / F.log2(n / F.col("n_subject"))).otherwise(F.lit(0.0))
    evidence = _evidence(n, F.col("f_both"), F.col("n_term") - F.col("n_both") + F.col("f_both"), F.col("f_subject"))
    told = counted.select("term", "subject", share.alias("disclosed"), evidence.alias("evidence"))
    return saved(told.filter(F.col("disclosed") >= disclose), "pairs"), tested


def disclosing_terms(docs: DataFrame, disclose: float = DISCLOSE, false_share: float = FALSE_SHARE) -> DataFrame:
    """``term, disclosed``: the terms and the largest share of a subject's information that each gives away."""
    pairs, tested = pair_counts(docs, disclose)
    step = F.least(F.floor(10 * F.col("evidence")), F.lit(_DEEPEST)).alias("step")
    counts = pairs.groupBy(step).agg(F.count(F.lit(1)).alias("n"))  # _DEEPEST rows at most
    at_least = Window.partitionBy(F.lit(0)).orderBy(F.desc("step"))
    held = counts.withColumn("reached", F.sum("n").over(at_least))
    limit = held.filter(F.exp(-F.col("step") / 10) * tested <= false_share * F.col("reached")).agg(F.min("step")).first()[0]
    told = pairs.filter(F.lit(False) if limit is None else step >= limit)
    return saved(told.groupBy("term").agg(F.max("disclosed").alias("disclosed")), "disclosing")


def sanitised(
    docs: DataFrame, disclose: float = DISCLOSE, remove: float = REMOVE, false_share: float = FALSE_SHARE
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, email, ip, card, phone, term`` (arrays of ``start, end``) and the clean ``text``.

    In ``text`` entities are replaced by their kind in brackets, terms by ``[term]`` or, if they disclose ``remove``
    or more, by nothing; spans that overlap are replaced together, by the label of the first. Terms that overlap an
    entity are not listed. Null texts count as empty; rows of one ``doc_id`` are counted as one document. Of ``docs``
    no other column is read. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    found = entities(docs)
    told = disclosing_terms(docs, disclose, false_share)
    none = F.array().cast("array<string>")
    if told.isEmpty():
        out = found.withColumns({"told": none, "gone": none})
    else:
        words = docs.select(_own_id().alias("own"), F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
        held = words.join(small(told), "term").groupBy("own").agg(
            F.collect_set("term").alias("told"),
            F.collect_set(F.when(F.col("disclosed") >= remove, F.col("term"))).alias("gone"),
        )
        held = small(saved(held, "holders"))
        out = found.join(held, _own_id() == F.col("own"), "left").drop("own")
        out = out.withColumns({"told": F.coalesce("told", none), "gone": F.coalesce("gone", none)})
    matches, gaps = _found("text", TERM, F.size("told") > 0)
    out = out.withColumns({"_m": matches, "_g": gaps}).withColumn("_s", _spans("_m", "_g"))
    base = F.concat(*PATTERNS)
    told_spans = F.filter("_s", lambda s: F.array_contains("told", F.lower(s["value"])))
    free = F.filter("_t", lambda s: ~F.exists("_b", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumns({"_t": told_spans, "_b": base}).withColumn("term", free)

    def places(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"]))

    def labelled(kind: str, label) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"], label(s).alias("label")))

    labels = [labelled(k, lambda s: F.lit(f"[{k}]")) for k in PATTERNS]  # noqa: B023
    of_term = lambda s: F.when(F.array_contains("gone", F.lower(s["value"])), "").otherwise("[term]")
    out = out.withColumn("_all", F.array_sort(F.concat(*labels, labelled("term", of_term))))
    # spans that reach into each other are one; what is between two such runs stays
    zipped = F.arrays_zip(F.col("_all").alias("s"), _before(F.transform("_all", lambda s: s["end"]), F.greatest).alias("before"))
    out = out.withColumn("_runs", F.filter(zipped, lambda z: z["s"]["start"] >= z["before"]))
    kept = F.transform(
        "_runs", lambda z: F.concat(F.substring("text", (z["before"] + 1).cast("int"), (z["s"]["start"] - z["before"]).cast("int")), z["s"]["label"])
    )
    last = F.array_max(F.transform("_all", lambda s: s["end"]))
    rest = F.substring("text", (last + 1).cast("int"), F.length("text"))
    clean = F.when(F.size("_all") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("text"))
    return out.select("doc_id", *[places(k).alias(k) for k in (*PATTERNS, "term")], clean.alias("text"))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of entities, a hash of their places, and all places as text."""

    def listed(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*[listed(k) for k in PATTERNS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term")), ",").alias("spans"),
    )
