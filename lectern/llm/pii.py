"""Personal data and the terms that give it away, in DataFrame expressions only.

Patterns find the protected entities: addresses, numbers and cards. Terms beside an entity may reveal it as
well. How strongly is estimated from the whole corpus: with N documents, n(e) that hold entity e, n(t) that
hold term t and n(t, e) that hold t beside e, the information that t gives on e is
log(N n(t,e) / (n(t) n(e))), and of it the share of all information on e, log(N / n(e)), is disclosed. Protected
is each entity by its value and by its class, which many rare values share: the domain of an address, the network
of an ip, the issuer of a card, the area of a phone number. Terms beside one entity in at least min_texts different texts whose disclosure reaches generalise_from are spans
too: to be generalised, or removed from remove_from on.

Texts are never shuffled: one pass keeps the patterns' matches and the words around them, one counts the
candidates' documents, one finds the places of the terms. The last two look words up in a bit map of fixed
size before the exact join, so that most words go no further.

Defined results: null counts as the empty text; a match that fails its check is dropped without a retry;
repeated rows are returned each, and all four numbers count rows, but repeats are one text for min_texts; terms
beside an entity are whole words, up to the next match of its kind, without those in email addresses; a null doc_id
is an id like any other; texts are read whole, in the memory of one task; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable, free_name

#: Fixed patterns of the kinds, in the order of results.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without a second look into a run of characters that has failed: what begins a match
#: stands at the begin of its run or where the last match ended, and is not given back.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": KINDS["phone"],
}
#: What a text must hold for a match to be possible.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
MAP_BITS = 1 << 17
RUN = 64


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _starts(gaps: str, sizes: str, places: Column | None = None) -> Column:
    """Starts of the matches at places (from 0, all if None), from the lengths of what stands before each match and of the matches.

    Lengths are added up by runs of RUN first, so that a start is the sum of few numbers.
    """
    n, steps = F.size(sizes), F.zip_with(F.slice(gaps, 1, F.size(sizes)), F.col(sizes), lambda g, s: g + s)
    wanted = F.sequence(F.lit(0), n - 1) if places is None else places

    def of(packed: Column) -> Column:  # packed: the steps and their sums by runs, made once
        return F.transform(
            wanted,
            lambda i: _total(F.slice(packed["sums"], 1, F.floor(i / RUN).cast("int"))) + _total(F.slice(packed["steps"], F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + F.get(gaps, i),
        )

    by_runs = lambda t: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda r: _total(F.slice(t, r * RUN + 1, RUN)))
    packed = F.transform(F.array(steps), lambda t: F.struct(t.alias("steps"), by_runs(t).alias("sums")))
    return F.when(n > 0, F.flatten(F.transform(packed, of))).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return _total(F.transform(each, lambda d: F.when(d > 9, d - 9).otherwise(d))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _gaps(kind: str, parts: Column, context: int) -> Column:
    """Length of each part of a text between two matches of a kind, its first and its last context terms."""

    def ends(terms: Column) -> Column:
        first = F.greatest(F.lit(1), F.size(terms) - context + 1)
        return F.struct(F.slice(terms, 1, context).alias("head"), F.slice(terms, first, context).alias("tail"))

    def gap(part: Column) -> Column:
        # of all kinds, only addresses hold letters; in an array of one, so that terms are looked for once
        plain = part if kind == "email" else F.regexp_replace(part, LINEAR["email"], " ")
        held = F.get(F.transform(F.array(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))), ends), F.lit(0))
        return F.struct(F.length(part).alias("n"), held.alias("terms"))

    return F.transform(parts, gap)


def base_spans(docs: DataFrame, context: int = 6) -> DataFrame:
    """doc_id, key and, for each kind, an array of start, end, value; near: value and the terms beside it."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    raw = []
    for kind, pattern in LINEAR.items():
        parts = F.split("text", pattern, -1)
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = _gaps(kind, parts, context)
        raw.append(F.when(F.col("text").rlike(NEEDS[kind]), F.struct(gaps.alias("gaps"), found.alias("found"))).alias(kind))
    return durable(_spans(durable(named.select("doc_id", "key", F.xxhash64("text").alias("text_key"), *raw))))


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _near(kind: str) -> Column:
    """Each valid match of a kind with the terms on either side."""

    def beside(value: Column, i: Column) -> Column:
        before, after = F.get(f"{kind}.gaps", i)["terms"]["tail"], F.get(f"{kind}.gaps", i + 1)["terms"]["head"]
        terms = F.array_distinct(F.transform(F.concat(before, after), F.lower))
        return F.struct(F.concat(F.lit(f"{kind}:"), F.lower(value)).alias("value"), F.when(_valid(kind, value), terms).alias("terms"))

    return F.filter(F.transform(f"{kind}.found", beside), lambda n: n["terms"].isNotNull())


def _spans(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    nothing = F.array().cast("array<struct<value:string,terms:array<string>>>")
    out, nears = raw, []
    for kind in KINDS:
        out = out.withColumns({"gaps_": F.transform(f"{kind}.gaps", lambda g: g["n"]), "sizes_": F.transform(f"{kind}.found", F.length)})
        starts = F.coalesce(_starts("gaps_", "sizes_"), F.array().cast("array<int>"))
        spans = F.zip_with(starts, F.coalesce(f"{kind}.found", F.array().cast("array<string>")), lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))

        nears.append(F.coalesce(_near(kind), nothing))
        out = out.withColumn(f"{kind}_spans", F.coalesce(_checked(kind, spans), empty)).drop("gaps_", "sizes_")
    out = out.withColumn("near", F.concat(*nears)).drop(*KINDS)
    return out.select("doc_id", "key", "text_key", *[F.col(f"{k}_spans").alias(k) for k in KINDS], "near")


def _protected(value: Column) -> Column:
    """An entity's value and its class: domain, first two numbers of an ip, first six digits of a card, first five of a phone number."""
    kind, digits = F.substring_index(value, ":", 1), F.regexp_replace(value, "[^0-9]", "")
    of_class = (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(F.substring(value, 4, 1 << 30), ".", 2))
        .otherwise(F.substring(digits, 1, F.when(kind == "card", 6).otherwise(5)))
    )
    return F.array(value, F.concat(kind, F.lit(" class:"), of_class))


def disclosing_terms(docs: DataFrame, base: DataFrame, min_texts: int = 3, generalise_from: float = 0.75, remove_from: float = 0.9) -> DataFrame:
    """term, disclosure, action of each term that tells too much of some entity."""
    of_near = lambda n: F.flatten(F.transform(_protected(n["value"]), lambda e: F.transform(n["terms"], lambda t: F.struct(e.alias("entity"), t.alias("term")))))
    told = F.flatten(F.transform("near", of_near))
    beside = base.select("text_key", F.explode(F.array_distinct(told)).alias("p")).select("text_key", "p.*")
    pairs = beside.groupBy("entity", "term").agg(F.count("*").alias("n_pair"), F.count_distinct("text_key").alias("texts"))
    pairs = durable(pairs.filter(F.col("texts") >= min_texts).drop("texts"))
    schema = "term string, disclosure double, action string"
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    entities = base.select("key", F.explode(F.array_distinct(F.flatten(F.transform("near", lambda n: _protected(n["value"]))))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    seen = _document_counts(docs, pairs.select("term").distinct())
    n_docs = F.lit(float(base.count()))
    told = pairs.join(entities, "entity").join(seen, "term")
    given = F.log(n_docs * F.col("n_pair") / (F.col("n_term") * F.col("n_entity"))) / F.log(n_docs / F.col("n_entity"))
    strongest = told.filter(F.col("n_entity") < n_docs).groupBy("term").agg(F.max(given).alias("disclosure"))
    action = F.when(F.col("disclosure") >= remove_from, "remove").otherwise("generalise")
    return durable(strongest.filter(F.col("disclosure") >= generalise_from).withColumn("action", action))


def _bit_map(terms: DataFrame) -> Column:
    """Is a word's bit set among MAP_BITS, of which each term sets one: a fixed size, however many terms."""
    rows = terms.select(F.pmod(F.xxhash64("term"), F.lit(MAP_BITS)).alias("bit")).distinct().collect()
    bits = bytearray(MAP_BITS)
    for (bit,) in rows:
        bits[bit] = 1
    return lambda word: F.substring(F.lit(bytes(bits)), F.pmod(F.xxhash64(word), F.lit(MAP_BITS)).cast("int") + 1, 1) == F.lit(b"\x01")


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: in how many documents each of terms, and any other word with a bit of theirs, stands."""
    maybe = _bit_map(terms)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    found = docs.select(F.explode(words).alias("term")).filter(maybe(F.col("term")))
    return found.groupBy("term").agg(F.count("*").alias("n_term"))


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, key, terms: the places of disclosing terms in each document that holds any."""
    if terms.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, key long, terms array<struct<start:int,end:int,value:string,action:string>>")
    maybe = _bit_map(terms)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hit = named.filter(F.exists(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), maybe))
    words = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), F.when(maybe(F.lower(w)), F.lower(w)).alias("term")))
    placed = hit.withColumn("words", words).withColumns(
        {
            "gaps": F.transform(F.split("text", TERM, -1), F.length),
            "sizes": F.transform("words", lambda w: w["n"]),
            "places": F.filter(F.transform("words", lambda w, i: F.when(w["term"].isNotNull(), i)), lambda i: i.isNotNull()),
        }
    )
    placed = placed.select("doc_id", "key", "words", "gaps", "sizes", "places").withColumn("starts", _starts("gaps", "sizes", F.col("places")))
    spans = F.zip_with("starts", "places", lambda s, i: F.struct(s.alias("start"), (s + F.get("words", i)["n"]).alias("end"), F.get("words", i)["term"].alias("term")))
    each = placed.select("doc_id", "key", F.explode(spans).alias("s")).select("doc_id", "key", "s.*")
    known = each.join(terms.select("term", "action"), "term").distinct()
    return known.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("term").alias("value"), "action"))).alias("terms"))


def find_personal_data(docs: DataFrame, **thresholds: float) -> DataFrame:
    """doc_id, key, an array of spans for each kind, and terms, the spans that the method adds, of each row."""
    base = base_spans(docs)
    terms = term_spans(docs, disclosing_terms(docs, base, **thresholds))
    named = terms.withColumnRenamed("doc_id", "id_")
    return base.join(named, (base["key"] == named["key"]) & base["doc_id"].eqNullSafe(named["id_"]), "left").select(base["doc_id"], base["key"], *KINDS, F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,value:string,action:string>>")).alias("terms"))


def _marks(kind: str, mark: Callable[[Column], Column]) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("mark")))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with text sanitised: entities and weaker terms become their kind in brackets, stronger terms go."""
    marks = F.concat(
        *[_marks(k, lambda s, mark=f"[{k}]": F.lit(mark)) for k in KINDS],
        _marks("terms", lambda s: F.when(s["action"] == "remove", "").otherwise("[term]")),
    )
    held = found.filter(F.size(marks) > 0).select("doc_id", "key", F.array_sort(marks).alias("marks")).dropDuplicates(["doc_id", "key"])
    # docs may have columns of any name: what is joined gets free ones
    id_, key, found_ = (free_name(docs, n) for n in ("marked_id", "marked_key", "marks"))
    held = held.withColumnsRenamed({"doc_id": id_, "key": key, "marks": found_})
    same = (F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))) == F.col(key)) & docs["doc_id"].eqNullSafe(F.col(id_))
    joined = docs.join(held, same, "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        rest = F.substr(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), m["start"] - a["at"]))
        return F.struct(F.greatest(a["at"], m["end"]).alias("at"), F.when(m["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(rest, m["mark"]))).alias("out"))

    clean = F.aggregate(found_, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("text"), a["at"] + 1)))
    return joined.withColumn("text", F.when(F.col(found_).isNull(), F.col("text")).otherwise(clean)).drop(id_, key, found_)
