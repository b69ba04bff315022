"""Personal data by patterns and by what terms disclose, in DataFrame functions alone.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Texts are then treated as in information-theoretic
sanitisation: a found value e is a protected entity, and a term t of its contexts (the line around it) discloses
PMI(t; e) = log(N n(t, e) / (n(t) n(e))) of its information IC(e) = log(N / n(e)), counts being of distinct texts of
the whole corpus. A term that discloses at least `disclosure` of IC(e) is a further span where it occurs in texts with
e, and is generalised with the patterns' spans. Every entity counts, also one of a single text. `support` asks for that
many distinct texts with both. Terms are of three characters or more, or of any length in scripts without spaces.

By these counts alone a word of one single text discloses every entity of its line, whatever the word is. With `z`, a
text is judged by the others: one text with both is left out of n(t, e) and n(t), and the share n(t, e) / n(t) of what
is left counts by its lower confidence bound (Wilson's, `z` standard deviations). A word of one text has no evidence
then and stays; EVIDENCE is what the query and the pipeline take.

Positions come from marks: every match is put between two marks, the text is split there, and lengths are summed.
A mark is a private-use character, which the text's own of that kind cannot be mistaken for (they are exchanged first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns. Possessive where nothing can follow that giving back would serve, and bound to the start
#: of a run, so that long runs cost one pass; \G is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a row must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
TERM = rf"[\p{{L}}\p{{N}}_'-]{{3,}}|(?<![\p{{L}}\p{{N}}_'-])[{CJK}]{{1,2}}(?![\p{{L}}\p{{N}}_'-])"
#: Bits of the map of terms that are counted over the corpus (4 MB).
MAP_BITS = 1 << 25
MARK, OTHER = "\ue000", "\ue001"
#: Four fifths of an entity's information, with a confidence of 95 % by other texts.
EVIDENCE = {"disclosure": 0.8, "z": 1.645}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # by length first: a part is at most 255, with any number of leading zeros
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda span: _valid(kind, span["value"])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _marked(text: Column, pattern: Column) -> Column:
    """The text in pieces: every second one is a match."""
    clean = F.translate(text, MARK, OTHER)
    return F.split(F.regexp_replace(clean, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)


def _spans(kind: str, pieces: Column) -> Column:
    """Spans (code points, end exclusive) of the matches among pieces; sums of lengths go along in one pass."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("match"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), F.when(acc["match"], F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, state, step, lambda acc: acc["found"])


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its valid spans in text (not null)."""
    out = {}
    for kind in KINDS:
        tried = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True)
        found = _spans(kind, _marked(text, F.lit(PATTERNS[kind])))
        if kind == "ip":
            tried = text.rlike(PATTERNS[kind])
        if kind == "card":
            tried = text.rlike(r"[0-9](?:[\x20-]?+[0-9]){12}")
        out[kind] = F.when(tried, F.filter(found, _holds(kind))).otherwise(F.array().cast(SPANS))
    return out


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def _share(n_both: Column, n_term: Column, z: float | None) -> Column:
    """The share of a term's texts that have the entity; with z the lower bound of it by all texts but one with both."""
    if z is None:
        return n_both / n_term
    k, n, zz = n_both - 1, n_term - 1, z * z
    bound = (k + zz / 2 - z * F.sqrt(k * (n - k) / F.greatest(n, F.lit(1)) + zz / 4)) / (n + zz)
    return F.when(k > 0, bound).otherwise(F.lit(0.0))


def find(docs: DataFrame, disclosure: float = 0.95, support: int = 1, z: float | None = None) -> DataFrame:
    """doc_id, text (null: empty), spans: one row for each row of docs; spans by kind as listed ("term" last), then start.

    docs: doc_id, text; more columns are ignored. Repeated rows get the same spans. Copies of a text count once in the
    corpus statistics. Terms inside the patterns' spans are not terms. A text without protected entities keeps all its terms.
    Without z, a word that occurs in one text of the corpus is a span if an entity is on its line; with z it is none.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    base = rows.select("doc_id", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items())).select("doc_id", "text", F.concat(*KINDS).alias("base"))
    hit = materialize(base.where(F.size("base") > 0).withColumn("tkey", F.sha2("text", 256)))
    once = hit.dropDuplicates(["tkey"])
    n_entity = once.select("tkey", F.explode(F.array_distinct(F.transform("base", lambda b: b["value"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    here = once.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_here"))
    # contexts: the line around a value, without the values in it; entities and terms of fewer texts than both must
    # have are left out before they meet, so that a long line is not the product of all its words and values
    lines = once.select("tkey", F.posexplode(F.split("text", "\n")).alias("at", "line"), "base")
    inside = F.array_distinct(F.transform(F.filter("base", lambda b: F.contains("line", b["value"])), lambda b: b["value"]))
    lines = lines.select("tkey", "at", "line", inside.alias("entities")).where(F.size("entities") > 0)
    taken_out = F.lower(F.regexp_replace("line", F.lit("|".join(f"(?:{PATTERNS[k]})" for k in KINDS)), F.lit(" ")))
    of_line = lines.select("tkey", "at", F.explode(_terms(taken_out)).alias("term"))
    held = lines.select("tkey", "at", F.explode("entities").alias("entity"))
    least = max(support, 1 if z is None else 2)
    if least > 1:
        of_line = of_line.join(here.where(F.col("n_here") >= least).select("term"), "term")
        held = held.join(n_entity.where(F.col("n_entity") >= least).select("entity"), "entity")
    together = held.join(of_line, ["tkey", "at"]).select("tkey", "entity", "term").distinct()
    both = materialize(together.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least))
    total = rows.agg(F.count_distinct(F.xxhash64("text")).alias("total"), F.lit(1).alias("one"))
    measured = both.join(n_entity, "entity").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
    content = F.log(F.col("total") / F.col("n_entity"))

    def discloses(n_term: str) -> Column:
        share = _share(F.col("n_both"), F.col(n_term), z)
        return (content > 0) & (share > 0) & (F.log(share * F.col("total") / F.col("n_entity")) >= disclosure * content)

    # a term's count in the texts with entities is a lower bound of its count in the corpus: pairs that fail by it fail
    # by the whole count too, so that only telling terms are counted over the corpus
    likely = materialize(measured.join(here, "term").where(discloses("n_here")).select("entity", "term", "n_both", "n_entity", "total"))
    wanted = likely.select("term").distinct()
    seen = rows.select(F.xxhash64("text").alias("tkey"), F.explode(_terms(F.col("text"))).alias("term"))
    seen = _in_bitmap(seen, wanted).join(wanted, "term")  # a semi join would be pushed below the bitmap's
    n_term = seen.distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    telling = likely.join(n_term, "term").where(discloses("n_term")).select("entity", "term")
    of_text = once.select("tkey", F.explode(F.array_distinct(F.transform("base", lambda b: b["value"]))).alias("entity")).join(telling, "entity")
    of_text = of_text.groupBy("tkey").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    flagged = hit.select("tkey", "text", "base").dropDuplicates(["tkey"]).join(of_text, "tkey")
    quoted = F.array_join(F.transform("terms", lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_'-])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}_'-])"))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = flagged.select("tkey", F.filter(_spans("term", _marked(F.col("text"), pattern)), clear).alias("added"))
    return _with_added(base, hit, added, kind)


def _in_bitmap(seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of seen (tkey, term) whose term may be in wanted, by a bitmap of MAP_BITS hashed terms that is broadcast whatever their number."""
    place = F.pmod(F.xxhash64("term"), F.lit(MAP_BITS)) + 1  # positions count from 1
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    placed = seen.withColumn("p", place).select("tkey", "term", F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").cast("int").alias("bit"))
    byte = "cast(conv(hex(substring(bits, cast(bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    return placed.join(F.broadcast(bits), "bucket").where(F.expr(f"shiftright({byte}, bit % 8) & 1 = 1")).select("tkey", "term")


def _with_added(base: DataFrame, hit: DataFrame, added: DataFrame, kind: str) -> DataFrame:
    none = F.array().cast(SPANS)
    with_hits = hit.join(added, "tkey", "left").select("doc_id", "text", F.concat("base", F.coalesce("added", none)).alias("spans"))
    return base.where(F.size("base") == 0).select("doc_id", "text", none.alias("spans")).union(with_hits)


def sanitised(text: Column, spans: Column) -> Column:
    """text with every span generalised to its kind, as <EMAIL>; spans that overlap are one, named by the first (then longest)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(fits, F.concat(acc["out"], between, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, state, step, rest))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text) of find()'s rows."""
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
