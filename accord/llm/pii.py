"""Personal data: fixed patterns, and terms that disclose the entities found, in built-in expressions only.

Corpus co-occurrence estimates how much a term in an entity's document tells about the entity. With N
documents, n_e holding entity e, n_t holding term t and n_et holding both,

    disclosure(t, e) = log2(N n_et / (n_e n_t)) / log2(N / n_e) * n_et / (n_et + 1/2)

is the share of the entity's information content that the term gives away, shrunk where few documents
show it: near 1 if the term occurs with that entity alone, about 0 if it occurs everywhere; one document
alone comes to 2/3 at most. Terms at or over a threshold are removed, those at or over a lower one are
generalised, wherever they stand in a document that holds the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.llm.common import documents, let, scratch, written

#: Fixed values of the contract: kinds in order, and their patterns. The groups are possessive and a
#: match starts at a run's begin or where the last match ended: the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9]|[ -][0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text without any match of the kind fails.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "generalised": "<TERM>", "removed": ""}
TERM = r"[\p{L}\p{N}]++(?:['-][\p{L}\p{N}]++)*+"
#: Disclosure from which terms are generalised, and removed; the documents that weigh against an estimate.
GENERALISE, REMOVE, DOUBT = 0.6, 0.8, 0.5
#: Matches that are placed in one go; longer lists are put together from such runs.
RUN = 64


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points; end is exclusive."""
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value"))), lambda x: x["value"].isNotNull())

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["value"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(x["value"]), F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    def runs(pairs: Column) -> Column:
        """Runs of matches are placed one after another and joined at the end, so that no list is copied for each match."""
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("out"))

        def run(s: Column, first: Column) -> Column:
            begin = F.struct(s["at"].alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
            return let(F.aggregate(F.slice(pairs, first, F.lit(RUN)), begin, step), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))

        starts = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(starts, none, run)["out"])

    return let(pairs, runs)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of all kinds, ordered by kind as listed, then start."""
    found = []
    for kind in KINDS:
        typed = F.transform(matches(text, PATTERNS[kind], _keeps(kind)), _named(kind))
        found.append(F.when(text.rlike(HINTS[kind]), typed).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")))
    return F.concat(*found)


def _keeps(kind: str) -> Callable[[Column], Column]:
    return lambda value: _valid(kind, value)


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, spans (base), text (where there are spans): a row for each input row.

    Null texts count as empty. Repeated rows of one id and text have equal hashes and results.
    """
    rows = documents(docs).withColumn("row_hash", F.xxhash64("doc_id", "text")).withColumn("spans", base_spans(F.col("text")))
    return rows.select("doc_id", "row_hash", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def _entity(span: Column) -> Column:
    """What counts as one entity: addresses without case, numbers without punctuation."""
    plain = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9.]", ""))
    return F.concat_ws(":", span["kind"], plain)


def _terms(text: Column) -> Column:
    """Distinct terms of a text, in lower case: runs of letters and digits of three or more code points."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), lambda t: F.length(t) > 2)


def term_counts(docs: DataFrame) -> DataFrame:
    """term_hash, n_t: documents that hold each term, over all whole texts. Counted within each task first."""
    return documents(docs).select(F.explode(_terms(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("term_hash")).agg(F.count("*").alias("n_t"))


def disclosing(holders: DataFrame, counts: DataFrame, total: int, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """row_hash, term, kind: the terms of each row that disclose one of its entities, with the graver kind of several.

    holders: row_hash, spans, text, once each; counts: term_hash, n_t over all documents, `total` of them. An entity in every
    document has no information content, so nothing discloses it. Counts of entities and terms are brought to the
    rows, and only terms rare enough to pass the threshold with an entity are paired with it: n_et <= n_e, so
    n_t <= n_e ** g * N ** (1 - g).
    """
    n = F.lit(float(max(1, total)))
    own = holders.select("row_hash", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    known = own.join(own.groupBy("entity").agg(F.count("*").alias("n_e")), "entity").where(F.col("n_e") < n)
    entities = known.groupBy("row_hash").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities"))
    terms = holders.select("row_hash", F.explode(_terms(F.col("text"))).alias("term")).withColumn("term_hash", F.xxhash64("term"))
    held = terms.join(counts, "term_hash").groupBy("row_hash").agg(F.collect_list(F.struct("term", "n_t")).alias("terms"))
    limit = F.pow(F.col("e.n_e"), F.lit(generalise)) * F.pow(n, F.lit(1 - generalise)) * (1 + 1e-9)
    rows = entities.join(held, "row_hash").select("row_hash", "terms", F.explode("entities").alias("e"))
    pairs = written(rows.select("row_hash", "e.entity", "e.n_e", F.explode(F.filter("terms", lambda t: t["n_t"] <= limit)).alias("t")).select("row_hash", "entity", "n_e", "t.term", "t.n_t"))
    met = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    share = F.log2(n * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et"))) / F.log2(n / F.col("n_e")) * F.col("n_et") / (F.col("n_et") + DOUBT)
    told = met.withColumn("disclosure", share).where(F.col("disclosure") >= generalise).select("entity", "term", F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised").alias("kind"))
    return pairs.join(told, ["entity", "term"]).groupBy("row_hash", "term").agg(F.max("kind").alias("kind"))


def _term_spans(text: Column, told: Column, taken: Column) -> Column:
    """array<struct<kind, start, end>> of the told terms (map<term, kind>) in a text, but for those that overlap a base span."""
    hits = F.filter(F.transform(matches(text, TERM), lambda m: F.struct(F.try_element_at(told, F.lower(m["value"])).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))), lambda m: m["kind"].isNotNull())
    return F.array_sort(F.filter(hits, lambda m: ~F.exists(taken, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))


def sanitise_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, spans (base), terms (array<struct<kind, start, end>>, ordered): a row for each input row."""
    found = written(detect(docs))
    holders = found.where(F.size("spans") > 0).select("row_hash", "spans", "text").dropDuplicates(["row_hash"])
    told = disclosing(holders, term_counts(docs), found.count())
    told = told.groupBy(F.col("row_hash").alias("hit_hash")).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    bare = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    met = found.join(told, F.col("row_hash") == F.col("hit_hash"), "left")
    return met.select("doc_id", "row_hash", bare.alias("spans"), F.when(F.col("told").isNotNull(), _term_spans(F.col("text"), F.col("told"), F.col("spans"))).otherwise(none).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_terms of every input row.

    Null and empty texts have no spans: counts of 0 and the hash of the empty string. Repeated rows
    have equal results. Other columns are not read; empty input gives no rows.
    """
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = sanitise_spans(docs)
    return rows.select("doc_id", *map(of, KINDS), F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's placeholder; overlapping spans give the first one's."""
    name = F.create_map(*(F.lit(x) for pair in PLACEHOLDER.items() for x in pair))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        part = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.element_at(name, x["kind"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["parts"], F.array(part))).otherwise(s["parts"]).alias("parts"))

    return let(F.aggregate(ordered, none, step), lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; columns and rows as given.

    Null texts stay null. n_chars, where there is one, is counted anew for changed texts.
    """
    with scratch(docs.sparkSession) as kept:
        spans = kept(sanitise_spans(docs).select(F.col("row_hash").alias("__hash"), F.concat("spans", "terms").alias("__spans")).where(F.size("__spans") > 0).dropDuplicates(["__hash"]))
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    met = keyed.join(spans, F.col("__row") == F.col("__hash"), "left")
    changed = F.col("__spans").isNotNull()
    met = met.withColumn("text", F.when(changed, redact(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return met.select(*docs.columns)
