"""Personal data and what reveals it, with DataFrame functions only.

*Entities* are e-mail addresses, IP addresses, card numbers and phone numbers, found by fixed patterns in whole
texts, and secrets: the values of places that co-occurrence shows to be protected.  A *place* is a word with an
assignment sign (= or :) behind it, its values are what follows.  Values at a place are secrets if

* they are tied to it: by the corpus's counts the value's longest word reveals the place in the mean, by the measure
  used for terms below (words of prose occur elsewhere, those after a place of secrets do not), and
* they identify: their mean information -log p(word) is at least ``identity`` of log(number of documents), the most
  that a word can have.  Means are over different values, of which ``support`` are needed, so copies count once.

An entity belongs to classes: its kind, its group (an address's domain, a number's first digits, a secret's place) and
its own text; a single string is in few texts, but what reveals its kind or group can be estimated.

*Terms* are words, and phrases of two words in a row.  Corpus co-occurrence tells how strongly a term reveals a class:
with p(e) the share of documents that hold the class and p(e|t) the share of those with the term that have the class
within ``REACH`` of it, the pointwise mutual information log p(e|t)/p(e) is compared with the class's own information
-log p(e).  A term that gives away at least ``disclosure`` of it, seen near the class in at least ``support`` different
surroundings (so that copies count once), is sanitised wherever it stands, in documents without the entity too, for
there it discloses.  A phrase counts where neither of its words is such a term by itself.  Surroundings end where
something else stands that the entity's own pattern finds, valid or not.

Only terms within ``REACH`` code points of an entity are candidates, since all words of a text with all its entities
would be a number of pairs that grows with the square of the text.  Counts are over all documents.  Patterns are
possessive and start only where a run of their characters starts, so the time for a text is proportional to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.store import keep

#: Fixed patterns.  They find what the plain forms find: a match can't begin inside a run unless one ended there.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a place and its value: word, sign, value
    "secret": r"(?<![\p{L}\p{N}])([\p{L}\p{N}]{1,64}+)[\x20\"']{0,4}+([=:])[\x20\"']{0,4}+([\p{L}\p{N}]++(?:[-_+/][\p{L}\p{N}]++)*+)",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": ""}
SECRET = len(BASE)
TERM = r"[\p{L}\p{N}]++"
#: Code points on each side of an entity in which its terms lie, and when a term is sanitised.
REACH, DISCLOSURE, SUPPORT = 48, 0.9, 3
#: Share of the most information that a secret's word has in the mean.
IDENTITY = 0.8
#: Slots of the filter that spares other words a shuffle; at most 8 MB are broadcast at any size.
SLOTS = 1 << 20


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    part = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    luhn = F.when((n >= 13) & (n <= 19), F.expr("luhn_check(regexp_replace(hit, '[^0-9]', ''))")).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, small).when(kind == 2, luhn).when(kind == 3, (n >= 9) & (n <= 15)).otherwise(True)


def _place(hit: Column) -> Column:
    """The place of a match of a secret's pattern: its word and sign."""
    return F.concat(F.lower(F.regexp_extract(hit, PATTERNS["secret"], 1)), F.regexp_extract(hit, PATTERNS["secret"], 2))


def _value(hit: Column) -> Column:
    return F.regexp_extract(hit, PATTERNS["secret"], 3)


def _key(hit: Column) -> Column:
    """The longest word of a secret's value, the first of equals, in lower case."""
    words = F.transform(F.regexp_extract_all(F.lower(_value(hit)), F.lit(f"({TERM})"), F.lit(1)), lambda w, i: F.struct(F.length(w), -i, w.alias("w")))
    return F.array_max(words)["w"]


def _hits(text: Column, kind: str, near: Callable[[Column], Column] | None = None) -> Column:
    """Per match: code points since the last one, the match, and what stands left and right of it.  Surroundings are
    left empty for matches that ``near`` is false for, while a match's place in the text is known from all of them."""
    pattern = F.lit(f"({PATTERNS[kind]})")
    gaps, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(1))

    def one(x: Column) -> Column:
        left, right = x["0"], x["1"]
        seen = near(x["2"]) if near else F.lit(True)
        around = lambda side: F.when(seen, side).otherwise("") if near else side
        return F.struct(F.length(left).alias("gap"), x["2"].alias("hit"), around(F.substring(left, -REACH, REACH)).alias("left"), around(F.substring(right, 1, REACH)).alias("right"), (F.length(left) > REACH).alias("cut_left"), (F.length(right) > REACH).alias("cut_right"))

    # zipped, so that a text is split once, not once for every match
    sides = F.filter(F.arrays_zip(gaps.alias("0"), F.slice(gaps, 2, 1 << 30).alias("1"), found.alias("2")), lambda x: x["2"].isNotNull())
    none = F.array().cast("array<struct<gap:int,hit:string,left:string,right:string,cut_left:boolean,cut_right:boolean>>")
    may = {"email": F.lit(True), "secret": text.rlike("[=:]")}.get(kind, text.rlike("[0-9]"))
    if NEEDS[kind]:
        may = F.contains(text, F.lit(NEEDS[kind])) & may
    return F.when(may, F.transform(sides, one)).otherwise(none)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _slot(*c: str | Column) -> Column:
    return F.pmod(F.xxhash64(*c), F.lit(SLOTS)).cast("int")


def _bits(places: DataFrame) -> DataFrame:
    """One row: ``bits``, SLOTS bits in whole numbers of 64, of which those of the ``places`` are set."""
    some = places.select(_slot("place").alias("slot")).distinct().groupBy(F.floor(F.col("slot") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("b"))
    every = places.sparkSession.range(SLOTS // 64).join(some, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("bits"))


def secret_places(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, identity: float = IDENTITY) -> DataFrame:
    """(place, n_values, tied, identifying) of the places whose values are secrets, by the corpus's counts.

    Values are counted by place and word first, so a place that much of the corpus has is combined before it is
    shuffled, and only words at places that have ``support`` of them are looked for in all texts."""
    total = max(1, docs.count())
    if total < 2:
        docs = docs.limit(0)
    text = _text(docs)
    pairs = F.transform(F.regexp_extract_all(text, F.lit(f"({PATTERNS['secret']})"), F.lit(1)), lambda h: F.struct(_place(h).alias("place"), _key(h).alias("term")))
    # a place without a word stands for the texts that have it
    whole = F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x, F.struct(x["place"].alias("place"), F.lit(None).cast("string").alias("term"))))))
    seen = keep(docs.where(text.rlike("[=:]")).select(F.explode(whole).alias("x")).groupBy("x.place", "x.term").agg(F.count("*").alias("n")), "values")
    logs = F.log(F.lit(float(max(2, total))))
    held = seen.groupBy("place").agg(F.count("term").alias("n_values"), F.max(F.when(F.col("term").isNull(), F.col("n"))).alias("texts"), F.avg(F.when(F.col("term").isNotNull(), 1 - F.log("n") / logs)).alias("most"))
    # a word is in no fewer texts than it is in at the place
    held = held.where((F.col("n_values") >= support) & (F.col("most") >= identity) & (F.col("texts") < total)).drop("most")
    values = keep(seen.where("term is not null").join(held, "place"), "place_values")
    counts = _holding(docs, values.select("term").distinct()).groupBy("term").agg(F.count("*").alias("with_term"))
    own = F.log(F.lit(float(total)) / F.col("texts"))
    tied, identifying = 1 + F.log(F.col("n") / F.col("with_term")) / own, 1 - F.log("with_term") / logs
    made = values.join(counts, "term").groupBy("place").agg(F.max("n_values").alias("n_values"), F.avg(tied).alias("tied"), F.avg(identifying).alias("identifying"))
    return made.where((F.col("tied") >= disclosure) & (F.col("identifying") >= identity))


def found_in(docs: DataFrame, row: str | None = None, places: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, mark, email, ip, ...): the raw matches of every row of ``docs``; a null text has none, and mark
    tells texts apart.  Without ``places`` no secrets are looked for.  Rows are numbered unless the column ``row`` has
    their numbers; write the result before it is used twice."""
    number = docs[row] if row else F.monotonically_increasing_id()
    light = docs.select(number.alias("row"), docs["doc_id"].alias("doc_id"), _text(docs).alias("text"))
    base = [_hits(F.col("text"), k).alias(k) for k in BASE]
    if places is None:
        return light.select("row", "doc_id", F.xxhash64("text").alias("mark"), *base, _hits(F.lit(""), "secret").alias("secret"))

    def may(hit: Column) -> Column:
        slot = _slot(_place(hit))
        return F.get(F.col("bits"), F.floor(slot / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64)) != 0

    # one row of 128 KB
    return light.crossJoin(F.broadcast(_bits(places))).select("row", "doc_id", F.xxhash64("text").alias("mark"), *base, _hits(F.col("text"), "secret", may).alias("secret"))


def entities(found: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(row, kind, start, end, hit, place, left, right, ...): the valid matches, with code-point offsets; those of
    secrets are of the ``places`` given."""
    some = found.where(" + ".join(f"size({k})" for k in KINDS) + " > 0")
    rows = some.select("row", F.posexplode(F.array(*KINDS)).alias("kind", "hits")).select("row", "kind", F.posexplode("hits").alias("i", "h")).select("row", "kind", "i", "h.*")
    far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.length("hit")).over(far)
    at = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).where(_valid(F.col("kind"), F.col("hit")))
    columns = ("row", "kind", "start", "end", "hit", "place", "left", "right", "cut_left", "cut_right")
    base = at.where(F.col("kind") < SECRET).withColumn("place", F.lit(None).cast("string")).select(*columns)
    if places is None:
        return base
    value = _value(F.col("hit"))
    # what stands left of a value begins before its place
    before = F.substring(F.concat("left", F.substring(F.col("hit"), F.lit(1), F.length("hit") - F.length("value"))), -REACH, REACH)
    longer = F.length("left") + F.length("hit") - F.length("value") > REACH
    own = at.where(F.col("kind") == SECRET).withColumn("place", _place(F.col("hit"))).join(places.select("place"), "place", "left_semi").withColumn("value", value)
    own = own.withColumn("cut_left", F.col("cut_left") | longer).withColumn("left", before).withColumn("start", F.col("end") - F.length("value")).withColumn("hit", F.col("value"))
    return base.unionByName(own.select(*columns))


def _words_at(window: Column, at: Column, cut_first: Column, cut_last: Column) -> Column:
    """Whole words of a window that begins at code point ``at``: array of (term, start, end)."""
    gaps, words = F.split(window, TERM, -1), F.regexp_extract_all(window, F.lit(f"({TERM})"), F.lit(1))
    n = F.size(words)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    ends = F.aggregate(F.zip_with(F.slice(gaps, 1, F.greatest(n, F.lit(0))), words, lambda g, w: F.length(g) + F.length(w)), zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["ends"], F.array(s["at"] + x)).alias("ends")), lambda s: s["ends"])
    made = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("term"), (at + F.get(ends, i) - F.length(w)).alias("start"), (at + F.get(ends, i)).alias("end"), i.alias("i")))
    whole = lambda x: ~(cut_first & (x["i"] == 0) & (F.length(F.get(gaps, F.lit(0))) == 0)) & ~(cut_last & (x["i"] == n - 1) & (F.length(F.get(gaps, n)) == 0))
    return F.filter(made, whole)


def _classes() -> Column:
    """Names of the classes of an entity (kind, hit): kind, group, and its own text."""
    kind, hit, digits = F.col("kind"), F.lower("hit"), F.regexp_replace("hit", "[^0-9]", "")
    group = F.when(kind == 0, F.regexp_extract("hit", "@(.*)", 1)).when(kind == 1, F.substring_index("hit", ".", 2)).when(kind == 2, F.substring(digits, 1, 6)).when(kind == 3, F.substring(digits, 1, 4)).when(kind == SECRET, F.col("place"))
    own = F.when((kind == 2) | (kind == 3), digits).otherwise(hit)
    name = lambda level, x: F.concat_ws(":", kind.cast("string"), F.lit(level), x)
    return F.array_compact(F.array(name("kind", F.lit("")), F.when(group.isNotNull(), name("group", F.lower(group))), name("own", own)))


def _with_phrases(words: Column) -> Column:
    """Words in a row, and the phrases of two that they make."""
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30), lambda v, w: F.concat(v, F.lit(" "), w)))


def surroundings(ents: DataFrame) -> DataFrame:
    """(row, entity, place, term): the words and phrases near each entity, for each class of it; place tells different
    texts apart."""
    terms = lambda side: _with_phrases(F.transform(side, lambda x: x["term"]))
    left = _words_at(F.col("left"), F.col("start") - F.length("left"), F.col("cut_left"), F.lit(False))
    right = _words_at(F.col("right"), F.col("end"), F.lit(False), F.col("cut_right"))
    each = ents.select("row", _classes().alias("entities"), F.xxhash64("left", "right").alias("place"), F.explode(F.concat(terms(left), terms(right))).alias("term"))
    return each.select("row", "place", F.explode("entities").alias("entity"), "term").select("row", "entity", "place", "term")


def _holding(docs: DataFrame, terms: DataFrame, phrases: bool = False) -> DataFrame:
    """(doc_id, mark, term): which of the ``terms`` each row of ``docs`` holds, each once."""
    text = _text(docs)
    each = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("mark"), F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)).alias("words"))
    every = _with_phrases(F.col("words")) if phrases else F.col("words")
    words = _with_once(each, words=F.col("words")).select("doc_id", "mark", F.explode(F.array_distinct(every)).alias("term"))
    slots = terms.select(_slot("term").alias("slot")).distinct()
    return words.withColumn("slot", _slot("term")).join(F.broadcast(slots), "slot", "left_semi").drop("slot")


def disclosing(docs: DataFrame, ents: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, total, with_entity, with_term, both) of the pairs in which the term gives the class away."""
    total = max(1, docs.count())
    share = F.col("with_entity") / F.lit(total)
    with_entity = ents.select("row", F.explode(_classes()).alias("entity")).groupBy("entity").agg(F.count_distinct("row").alias("with_entity"))
    near_term = near.groupBy("term").agg(F.count_distinct("row").alias("near_rows"))
    joint = near.groupBy("entity", "term", "place").agg(F.count_distinct("row").alias("rows")).groupBy("entity", "term").agg(F.count("*").alias("places")).where(F.col("places") >= support)
    both = near.join(joint, ["entity", "term"]).groupBy("entity", "term").agg(F.count_distinct("row").alias("both"))
    # a term is in no fewer rows than it is in near entities: most common words fail by that count already
    could = F.col("both") >= F.lit(0.999999) * F.col("near_rows") * F.pow(share, F.lit(1 - disclosure))
    joint = keep(both.join(near_term, "term").join(with_entity, "entity").where(could).drop("near_rows"), "joint")
    terms = joint.select("term").distinct()
    with_term = _holding(docs, terms, True).groupBy("term").agg(F.count("*").alias("with_term"))
    told = F.log(F.col("both") / F.col("with_term") / share)
    own = -F.log(share)
    return joint.join(with_term, "term").where((own > 0) & (told >= F.lit(disclosure) * own)).select("entity", "term", F.lit(total).alias("total"), "with_entity", "with_term", "both")


def _running(sizes: Column) -> Column:
    """Running sums of a short array of whole numbers."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("ends"))
    return F.aggregate(sizes, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["ends"], F.array(s["at"] + x)).alias("ends")), lambda s: s["ends"])


def _with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are evaluated once a row, however often they are used: a generator's output isn't
    put into the expressions behind it."""
    for name, column in columns.items():
        df = df.withColumn(name, F.explode(F.array(column)))
    return df


def _with_ends(df: DataFrame, run: int = 64) -> DataFrame:
    """``df`` with ``ends``, the running sums of its array ``sizes``, made in runs so that long arrays are seldom
    copied."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("sizes"), F.lit(1)) - 1) / run).cast("int")), lambda c: _running(F.slice("sizes", c * run + 1, run)))
    df = _with_once(df, runs=runs)
    df = _with_once(df, firsts=_running(F.concat(F.array(F.lit(0).cast("bigint")), F.transform("runs", lambda r: F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0).cast("bigint"))))))
    return _with_once(df, ends=F.flatten(F.zip_with("runs", F.slice("firsts", 1, F.size("runs")), lambda r, at: F.transform(r, lambda x: x + at)))).drop("runs", "firsts")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, mark, start, end): where ``terms`` (term) stand in the texts of ``docs``; rows equal in doc_id and
    text give their places once."""
    held = _holding(docs, terms, True).join(terms, "term", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_set("term").alias("terms"))
    held = keep(held, "holders")
    slots = held.select(_slot("d", "m").alias("slot")).distinct()
    texts = docs.select(docs["doc_id"].alias("doc_id"), _text(docs).alias("text")).withColumn("mark", F.xxhash64("text")).withColumn("slot", _slot("doc_id", "mark")).join(F.broadcast(slots), "slot", "left_semi")
    texts = texts.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).groupBy("doc_id", "mark").agg(F.any_value("text").alias("text"), F.any_value("terms").alias("terms"))
    parts = _with_once(texts, gaps=F.split("text", TERM, -1), words=F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))).drop("text")
    parts = _with_once(parts, sizes=F.zip_with(F.slice("gaps", 1, F.size("words")), "words", lambda g, w: (F.length(g) + F.length(w)).cast("bigint"))).drop("gaps")
    ended = _with_ends(parts)
    at = _with_once(ended, at=F.zip_with("words", "ends", lambda w, e: F.struct(F.lower(w).alias("term"), (e - F.length(w)).alias("start"), e.alias("end"))))
    pairs = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 2, 1 << 30), lambda v, w: F.struct(F.concat(v["term"], F.lit(" "), w["term"]).alias("term"), v["start"].alias("start"), w["end"].alias("end")))
    found = F.filter(F.concat("at", pairs), lambda x: F.array_contains("terms", x["term"]))
    return at.select("doc_id", "mark", F.explode(found).alias("x")).select("doc_id", "mark", "x.start", "x.end")


def least_terms(disclosed: DataFrame) -> DataFrame:
    """(term): what is sanitised; phrases with a word that is a term itself are left out."""
    terms = disclosed.select("term").distinct()
    parts = terms.where(F.contains("term", F.lit(" "))).select("term", F.explode(F.split("term", " ")).alias("word"))
    covered = parts.join(terms.select(F.col("term").alias("word")), "word", "left_semi").select("term").distinct()
    return terms.join(covered, "term", "left_anti")


def spans_of(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, ...) of ``docs``, and all spans (row, kind, start, end); the last kind is a term.  A
    secret or term that overlaps personal data is left out."""
    places = keep(secret_places(docs, disclosure, support), "places")
    found = keep(found_in(docs, row, places), "matches")
    ents = keep(entities(found, places), "entities")
    near = keep(surroundings(ents), "surroundings")
    disclosed = keep(disclosing(docs, ents, near, disclosure, support).select("term").distinct(), "disclosing")
    terms = keep(least_terms(disclosed), "terms")
    every = ents.select("row", F.col("kind").cast("int").alias("kind"), "start", "end")
    if not terms.isEmpty():
        at = occurrences(docs, terms).withColumnsRenamed({"doc_id": "d", "mark": "m"})
        rows = found.select("row", "doc_id", "mark").join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
        every = every.unionByName(rows.select("row", F.lit(len(KINDS)).alias("kind"), "start", "end"))
    # a kind gives way to those listed before it
    base = lambda of: F.when(F.col("kind") < len(BASE), F.col(of))
    entity = lambda of: F.when(F.col("kind") < len(KINDS), F.col(of))
    by = Window.partitionBy("row").orderBy("start")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    over = lambda x: (F.coalesce(F.max(x("end")).over(back), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(x("start")).over(ahead), F.col("end")) < F.col("end"))
    clear = every.withColumn("_base", over(base)).withColumn("_entity", over(entity))
    return found, clear.where((F.col("kind") < len(BASE)) | (F.col("kind") < len(KINDS)) & ~F.col("_base") | ~F.col("_entity")).drop("_base", "_entity")


def report(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    spans names all of them as kind:start:end: personal data by kind and start, then secrets, then terms; base_sha256
    is over personal data alone.  A null text is empty; repeated rows give a row each.  Other columns are not looked
    at; no rows give no rows.
    """
    found, spans = spans_of(docs, disclosure, support)
    each = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    rows = found.select("row", "doc_id").join(each, "row", "left")
    every = F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda i: F.filter("spans", lambda x: x["kind"] == i)
    return rows.withColumn("spans", every).select(
        "doc_id", *[F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(text(F.filter("spans", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text) of every row: entities generalised to their kind in brackets, terms removed.

    Overlapping spans are one, of the kind that is listed first; the text between spans is untouched.
    """
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    _, spans = spans_of(rows, disclosure, support, "row")
    order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
    each = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cut"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    piece = lambda x, i: F.concat(F.substring(F.col("text"), (F.when(i == 0, 0).otherwise(F.get(F.col("cut"), i - 1)["end"]) + 1).cast("int"), (x["start"] - F.when(i == 0, 0).otherwise(F.get(F.col("cut"), i - 1)["end"])).cast("int")), F.get(marks, x["kind"]))
    tail = F.substring(F.col("text"), (F.element_at("cut", -1)["end"] + 1).cast("int"), F.length("text"))
    return rows.join(each, "row", "left").select("doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("cut", piece), ""), tail)).alias("text"))
