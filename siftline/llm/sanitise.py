"""Personal data: pattern spans, and terms that the corpus shows to reveal them.

Base spans are the leftmost non-overlapping matches of four patterns, checked by digits, parts and checksum.  The words
within ``CONTEXT`` characters of a span are its context.  A protected entity is a kind, or one value of a kind in normal form.
Over the whole corpus, with N word occurrences, n(t) of a term, n(e) in contexts of entity e and n(t, e) of the term there,
PMI = ln(n(t, e) N / (n(t) n(e))) says how much the term tells about the entity, and its disclosure is PMI / ln(N / n(e)),
which is 1 for a term that occurs nowhere else.  Terms that stand near an entity in at least ``SUPPORT`` places, of one value
or of many, and disclose ``GENERALISE`` or more of it are spans of their own wherever they stand, also far from any base span
and in texts without one: sanitised texts replace them by the kind, or remove them from ``REMOVE`` on.  Places in repeated
rows count each.

Only DataFrame functions run here.  Patterns are matched in place, without a shuffle; positions come from the lengths of
what lies between matches, summed per document.  The patterns are possessive and anchored at the start of a run, so that
long runs of digits or letters cost linear time and no stack.  Words meet the disclosing terms one by one; only the places
of those that pass are gathered, and positions are summed between them.

Defined results: a null or empty text has no spans; repeated rows get equal results; terms never overlap a base span, as
words glued to address characters are no terms and one that opens an address is left to it; an empty table gives an empty result; further columns are ignored.
"""
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import let
from .common import broadcast_up_to, row_identity, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Same matches as the plain patterns, in linear time: a run is entered at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Text that must be there for a pattern to be tried.
GATES = {"email": r"[A-Za-z0-9-]\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
TERM = r"(?<![\p{L}\p{N}._%+@-])\p{L}++(?![\p{N}_%+@-]|\.[\p{L}\p{N}])"
CONTEXT = 48
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.999
#: Disclosing terms, and places of them, are broadcast up to this many rows each.
BROADCAST_TERMS, BROADCAST_PLACES = 500_000, 500_000


def _lengths(text, pattern):
    return F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))


def _matches(text, pattern):
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    digit = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    doubled = F.transform(F.sequence(F.lit(0), F.char_length(digits) - 1), lambda i: F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid():
    value, kind = F.col("value"), F.col("kind")
    digits = _digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= F.lit("255"))))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.char_length(digits).between(8, 15)).otherwise(F.lit(True))
    )


def _placed(found: DataFrame, keys: list) -> DataFrame:
    """(keys, start, end, value) from arrays of matches ``m`` and of the lengths ``g`` between them."""
    each = found.select(*keys, F.posexplode(F.arrays_zip("m", "g")).alias("at", "x")).select(*keys, "at", F.col("x.m").alias("value"), F.col("x.g").alias("gap"))
    each = each.filter(F.col("value").isNotNull()).withColumn("long", F.char_length("value"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("long")).over(upto)
    return each.select(*keys, (end - F.col("long")).alias("start"), end.alias("end"), "value")


def _candidates(documents: DataFrame) -> DataFrame:
    """Stored rows with a row number; matches per kind and the text only where something may match."""
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), row_identity(documents).alias("row_id"))
    may = {k: F.col("text").rlike(GATES[k]) for k in GATES}
    may["email"] = F.contains("text", F.lit("@")) & may["email"]
    may["phone"] = F.contains("text", F.lit("+")) & may["phone"]
    rows = rows.select("doc_id", "row_id", "text", *[may[k].alias(f"may_{k}") for k in GATES])
    tried = rows.select("doc_id", "row_id", "text", *[F.when(F.col(f"may_{k}"), F.struct(_matches(F.col("text"), p).alias("m"), _lengths(F.col("text"), p).alias("g"))).alias(k) for k, p in PATTERNS.items()])
    some = functools.reduce(lambda a, b: a | b, [F.size(F.col(k)["m"]) > 0 for k in PATTERNS])
    return stored(tried.select("doc_id", "row_id", F.when(some, F.col("text")).alias("text"), *PATTERNS), "pattern-matches")


def base_spans(candidates: DataFrame) -> DataFrame:
    """Stored (row_id, kind, start, end, value) of all valid matches; characters count, ends are exclusive."""
    kinds = [candidates.filter(F.size(F.col(k)["m"]) > 0).select("row_id", F.lit(k).alias("kind"), f"{k}.m", f"{k}.g") for k in PATTERNS]
    placed = _placed(functools.reduce(DataFrame.unionAll, kinds), ["row_id", "kind"])
    return stored(placed.filter(_valid()), "base-spans")


def _context_terms(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Stored (row_id, kind, value, term, start, end): words whole within CONTEXT characters of a span."""
    near = spans.join(candidates.filter(F.col("text").isNotNull()).select("row_id", "text"), "row_id")
    # one character more on each side shows whether the outer word is cut, a second on the right what it is glued to
    left = F.greatest(F.lit(0), F.col("start") - CONTEXT - 1)
    sides = F.array(
        F.struct(left.alias("from"), F.col("text").substr(left.cast("int") + 1, (F.col("start") - left).cast("int")).alias("piece")),
        F.struct(F.col("end").alias("from"), F.col("text").substr(F.col("end").cast("int") + 1, F.lit(CONTEXT + 2)).alias("piece")))
    pieces = near.select("row_id", "kind", "value", F.col("start").alias("s"), F.col("end").alias("e"), F.char_length("text").alias("size"), F.posexplode(sides).alias("side", "x"))
    pieces = pieces.select("row_id", "kind", "value", "s", "side", F.col("x.from").alias("from"), "size",
                           _matches(F.col("x.piece"), TERM).alias("m"), _lengths(F.col("x.piece"), TERM).alias("g"), F.char_length("x.piece").alias("held"))
    keys = ["row_id", "kind", "s", "side"]
    placed = _placed(pieces.select(*keys, "m", "g"), keys).withColumnRenamed("value", "word")
    joined = placed.join(pieces.drop("m", "g"), keys)
    cut_left = (F.col("side") == 0) & (F.col("start") == 0) & (F.col("from") > 0)
    cut_right = (F.col("side") == 1) & (F.col("end") > CONTEXT) & (F.col("from") + CONTEXT + 1 < F.col("size"))
    glued = F.when(F.col("side") == 0, F.col("end") == F.col("held")).otherwise(F.col("start") == 0)
    return stored(joined.filter(~cut_left & ~cut_right & ~glued).select(
        "row_id", "kind", "value", F.lower("word").alias("term"), (F.col("from") + F.col("start")).alias("start"), (F.col("from") + F.col("end")).alias("end")), "contexts")


def disclosing_terms(documents: DataFrame, contexts: DataFrame, support=SUPPORT, threshold=GENERALISE) -> DataFrame:
    """Stored (term, kind, disclosure) of the terms at or over the threshold for the kind or for one value of it."""
    words = documents.select(F.explode(_matches(F.col("text"), TERM)).alias("word")).select(F.lower("word").alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n"))
    asked = contexts.select("term").distinct().withColumn("asked", F.lit(True))
    counts = stored(counts.join(asked, "term", "left").groupBy(F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.sum("n").alias("n")), "term-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # an entity is a kind, with a null value, or one value; a place near two spans of an entity counts once for it
    value = F.col("value")
    normal = F.when(F.col("kind") == "email", F.lower(value)).when(F.col("kind") == "ip", F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")).otherwise(_digits(value))
    entities = F.explode(F.array(F.lit(None).cast("string"), normal)).alias("entity")
    places = stored(contexts.select("row_id", "start", "term", "kind", entities).distinct(), "entity-places")
    in_entity = places.groupBy("kind", "entity").agg(F.count("*").alias("n_entity"))
    both = places.groupBy("term", "kind", "entity").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    of_kind = both.filter("entity is null").join(F.broadcast(in_entity.filter("entity is null").drop("entity")), "kind")  # a row per kind
    of_value = both.join(in_entity, ["kind", "entity"])
    columns = ["term", "kind", "n_both", "n_entity"]
    scored = of_kind.select(columns).unionAll(of_value.select(columns)).join(counts.filter("term is not null"), "term")
    pmi = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n") * F.col("n_entity")))
    scored = scored.withColumn("disclosure", F.round(pmi / F.log(F.lit(float(total)) / F.col("n_entity")), 6)).filter(F.col("disclosure") >= threshold)
    return stored(scored.groupBy("term", "kind").agg(F.max("disclosure").alias("disclosure")), "disclosing-terms")


def _term_spans(documents: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored (row_id, start, end, of_kind, disclosure) of the disclosing terms wherever they stand in any text."""
    best = stored(terms.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("d")), "term-kinds")
    texts = documents.filter(F.col("text").isNotNull()).select(row_identity(documents).alias("row_id"), "text")
    words = texts.select("row_id", F.posexplode(_matches(F.col("text"), TERM)).alias("nth", "word"))
    hits = words.select("row_id", "nth", F.lower("word").alias("term")).join(broadcast_up_to(best, BROADCAST_TERMS), "term")
    hits = stored(hits.select("row_id", "nth"), "term-places")
    per_row = hits.groupBy("row_id").agg(F.array_sort(F.collect_list("nth")).alias("hits"))
    per_row = F.broadcast(per_row) if hits.count() <= BROADCAST_PLACES else per_row
    found = texts.join(per_row, "row_id").select("row_id", "hits", _matches(F.col("text"), TERM).alias("words"), _lengths(F.col("text"), TERM).alias("gaps"))

    def between(reach):  # characters from the end of the hit before to each hit: the slices are disjoint
        def one(hit, i):
            before = F.coalesce(F.get("hits", i - 1), F.lit(-1))
            skipped = F.slice(reach, before + 2, hit - before - 1)
            return F.aggregate(skipped, F.lit(0), lambda a, b: a + b) + F.get("gaps", hit)
        return F.transform("hits", one)

    reach = F.zip_with("words", "gaps", lambda word, gap: F.char_length(word) + gap)
    found = found.select("row_id", F.transform("hits", lambda hit: F.get("words", hit)).alias("m"), let(reach, between).alias("g"))
    placed = _placed(found, ["row_id"]).select("row_id", "start", "end", F.lower("value").alias("term"), "value")
    # a word and an address overlap only where the address begins with the word's last letters
    plain_end = F.char_length(F.regexp_extract("value", "[A-Za-z]*$", 0))
    opens = spans.filter(F.col("kind") == "email").select("row_id", F.col("start").alias("opened"))
    placed = placed.withColumn("opened", F.col("end") - plain_end).join(opens, ["row_id", "opened"], "left_anti")
    placed = placed.join(broadcast_up_to(best, BROADCAST_TERMS), "term")
    return stored(placed.select("row_id", "start", "end", F.col("d.kind").alias("of_kind"), F.col("d.disclosure").alias("disclosure")), "term-spans")


def find_spans(documents: DataFrame, support=SUPPORT, threshold=GENERALISE):
    """(candidates, spans): stored rows and (row_id, kind, start, end, of_kind, disclosure) of all spans."""
    candidates = _candidates(documents)
    spans = base_spans(candidates)
    contexts = _context_terms(candidates, spans)
    terms = disclosing_terms(documents, contexts, support, threshold)
    revealed = _term_spans(documents, spans, terms).select("row_id", F.lit("term").alias("kind"), "start", "end", "of_kind", "disclosure")
    base = spans.select("row_id", "kind", "start", "end", F.col("kind").alias("of_kind"), F.lit(1.0).alias("disclosure"))
    return candidates, base.unionAll(revealed)


def _named(span):
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), span["place"] + 1), span["start"].cast("string"), span["end"].cast("string"))


def report(documents: DataFrame, support=SUPPORT, threshold=GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term per document."""
    candidates, spans = find_spans(documents, support, threshold)
    place = functools.reduce(lambda c, k: c.when(F.col("kind") == KINDS[k], F.lit(k)), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], F.lit(0)))
    per_row = spans.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end"))).alias("s"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS])
    joined = candidates.select("row_id", "doc_id").join(per_row, "row_id", "left")
    every = F.coalesce("s", F.array().cast("array<struct<place:int,start:bigint,end:bigint>>"))
    base = F.filter(every, lambda x: x["place"] < len(KINDS) - 1)
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, _named), ","), 256).alias("base_sha256"), F.array_join(F.transform(every, _named), ",").alias("spans"))


def sanitise(documents: DataFrame, support=SUPPORT, threshold=GENERALISE, remove=REMOVE) -> DataFrame:
    """doc_id, sanitised: spans replaced by their kind in brackets, most disclosing terms removed."""
    candidates, spans = find_spans(documents, support, threshold)
    put = F.when((F.col("kind") == "term") & (F.col("disclosure") >= remove), F.lit("")).otherwise(F.concat(F.lit("["), F.upper("of_kind"), F.lit("]")))
    in_order = Window.partitionBy("row_id").orderBy("start", F.desc("end"), "kind")
    before = F.coalesce(F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = spans.withColumn("put", put).withColumn("before", before).filter(F.col("start") >= F.col("before"))
    per_row = apart.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "put", "before"))).alias("s"))
    texts = documents.select("doc_id", "text", row_identity(documents).alias("row_id")).join(per_row, "row_id", "left")
    parts = F.transform("s", lambda x: F.concat(F.substring(F.col("text"), (x["before"] + 1).cast("int"), (x["start"] - x["before"]).cast("int")), x["put"]))
    tail = F.substring(F.col("text"), (F.element_at("s", -1)["end"] + 1).cast("int"), F.char_length("text"))
    return texts.select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail)).alias("sanitised"))
