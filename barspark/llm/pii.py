"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four strict patterns (e-mail, IPv4, card, phone), each checked: octets, Luhn, digit
counts.  Every such span is a seed, whatever its length, digits or spaces, and so is a token that is a key by its
form, 32 hexadecimal digits of one case at least, letters and figures among them; candidates are the matches that fail
their check and the tokens with four digits or an @, less the punctuation around them, where they meet no seed.
The word before an instance is its lexical pattern, whatever the instance looks like, and where only signs stand
before it (``token = "...``), they and the word before them; patterns and distinct
instances form a bipartite graph.  A round admits the patterns with ``min_seeds`` seeds or instances accepted so
far, and scores each by the mean score of its instances, drawn towards zero where it has few.  Shapes are scored
apart: by the mean score of the patterns in which their instances stand, so a shape that stands everywhere, such
as a year's, has next to nothing.  An unknown instance is scored by the admitted patterns that it stands in; over
``accept``, and with a shape over ``least_shape``, it is accepted, and counts as a seed does in the next round.  So
values found after one word admit the next word, which finds values of shapes that no seed has.  After the
rounds, accepted instances in admitted patterns are new spans of kind ``context``, keys only where their pattern's score
is over ``accept`` as well: a key's form alone makes no span.  Distinct values count once,
so copies of a document add nothing to a pattern.

Positions are code points; ends are exclusive.  A span's place is the summed length of what ``split`` leaves
before it and of the matches before it.  The patterns are written without backtracking into long runs; they
match what the plain forms match.

Rules: a null or empty text has no spans; texts of any length are read whole; rows with one id keep their own
spans; identical rows get the same ones; a pattern or shape at its bound counts (no order decides anything); an
instance without a word before it has no pattern; an empty table gives an empty table; further columns are ignored
(or, in ``redact``, kept), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._spark import cut

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OPENING = r"""[(\[{<"']*"""
CLOSING = r"""[)\]}>"'.,;:!?]*"""
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 3
ACCEPT = 0.9
LEAST_SHAPE = 0.5
LEAST_DIGITS = 4
KEY = "^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
CHUNK = 256
#: Characters before a match in which the word before it is looked for first; a word that goes beyond is read from the whole text before.
LEFT = 50
#: A longer word stands for itself by a hash where patterns are grouped.
LONG_WORD = 64

SPAN = "struct<start:long,end:long,value:string,left:string>"


def _found(text: Column, pattern: str) -> Column:
    """Spans of all matches: start, end, value and the word before."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what stands before a match: the match before it and the gap between them
    before = F.zip_with(F.concat(F.array(F.lit("")), values), gaps, lambda v, g: F.struct(g.alias("gap"), v.alias("last"), F.right(F.concat(F.right(v, F.lit(LEFT)), F.right(g, F.lit(LEFT))), F.lit(LEFT)).alias("tail")))
    both = F.zip_with(before, values, lambda b, v: F.struct(b["gap"].alias("gap"), b["last"].alias("last"), b["tail"].alias("tail"), v.alias("value")))
    hits = F.slice(both, F.lit(1), F.size(values))
    # the running position is folded over chunks, so that a text with very many matches costs no square of them
    width = lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int")), lambda c: F.slice(hits, c * CHUNK + 1, CHUNK))
    sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + width(x)))
    begins = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + x))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        end_of = r"(\S*[\p{L}\p{N}]\S*\s++[^\p{L}\p{N}\s]++|\S++)\s++" + OPENING + "$"
        near = F.regexp_extract(x["tail"], r"(?<=\s)" + end_of, 1)
        # through an array, so that the first lookup is worked out once
        left = F.element_at(F.transform(F.array(near), lambda n: F.when(n != "", n).otherwise(F.regexp_extract(F.concat(x["last"], x["gap"]), r"(?<!\S)" + end_of, 1))), 1)
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value"), left.alias("left"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def fold(chunk, begin):
        zero = F.struct(begin.cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(chunk, zero, step, lambda acc: acc["spans"])

    return F.when(F.size(values) > 0, F.flatten(F.zip_with(chunks, begins, fold))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    weighed = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    total = F.aggregate(weighed, F.lit(0), lambda n, d: n + F.when(d > 9, d - 9).otherwise(d))
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.lit(False)) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(999)) <= 255))


CHECKS = {
    "email": (EMAIL, "@", lambda v: F.lit(True)),
    "ip": (IP, ".", _octets),
    "card": (CARD, None, _luhn),
    "phone": (PHONE, "+", lambda v: F.length(_digits(v)).between(8, 15)),
}


def _matches(text: Column, kind: str) -> Column:
    pattern, needs, _ = CHECKS[kind]
    none = F.array().cast(f"array<{SPAN}>")
    likely = text.contains(needs) if needs else F.lit(True)
    if kind != "email":
        likely = likely & text.rlike("[0-9]")
    return F.when(likely, _found(text, pattern)).otherwise(none)


def _checked(matches: Column, kind: str, passed: bool = True) -> Column:
    return F.filter(matches, lambda s: F.coalesce(CHECKS[kind][2](s["value"]), F.lit(False)) == passed)


def _trimmed(tokens: Column) -> Column:
    """Tokens without the punctuation around them, up to a quote inside."""

    def trim(s):
        value = F.regexp_replace(s["value"], "^" + OPENING, "")
        start = s["end"] - F.length(value)
        value = F.regexp_replace(F.regexp_replace(value, """["'].*$""", ""), CLOSING + "$", "")
        return F.struct(start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"), value.alias("value"), s["left"].alias("left"))

    return F.transform(tokens, trim)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _shape(value: Column) -> Column:
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{L}", "a")
    return F.regexp_replace(F.regexp_replace(shape, "(?<=a)a+", ""), "A(?=A)", "")


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, token): the base spans of each kind and what else could be identifiers."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    tokens = F.when(t.rlike("[0-9@]"), _found(t, TOKEN)).otherwise(F.array().cast(f"array<{SPAN}>"))
    found = rows.select("doc_id", F.xxhash64("t").alias("text_hash"), *(_matches(t, k).alias(k) for k in KINDS), tokens.alias("token"))
    failed = F.concat(*(_checked(F.col(k), k, False) for k in KINDS if k != "email"))
    return found.select("doc_id", "text_hash", *(_checked(F.col(k), k).alias(k) for k in KINDS), F.concat(_trimmed(F.col("token")), failed).alias("token"))


def _instances(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, value, pattern, shape, base, seed) of every base span, a seed, and of every candidate that meets none; a key is a seed without being a base span."""
    word = F.lower("s.left")
    pattern = F.when(F.length(word) > LONG_WORD, F.concat(F.lit("#"), F.sha2(word, 256))).otherwise(word)
    columns = ("doc_id", "text_hash", "s.start", "s.end", "s.value", pattern.alias("pattern"), _shape(F.col("s.value")).alias("shape"))
    seeds = found.select("doc_id", "text_hash", F.explode(F.concat(*KINDS)).alias("s")).select(*columns, F.lit(True).alias("base"), F.lit(True).alias("seed"))
    held = found.select("doc_id", "text_hash", F.concat(*KINDS).alias("base"), F.explode("token").alias("s"))
    meets = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (b["end"] > F.col("s.start")))
    likely = (F.length(_digits(F.col("s.value"))) >= LEAST_DIGITS) | F.col("s.value").contains("@")
    return seeds.unionByName(held.filter(likely & ~meets).select(*columns, F.lit(False).alias("base"), F.col("s.value").rlike(KEY).alias("seed"))).filter("pattern <> ''")


def discover(instances: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, min_seeds: int = MIN_SEEDS, least_shape: float = LEAST_SHAPE) -> DataFrame:
    """(pattern, value) of the instances besides base spans that the graph accepts."""
    edges = instances.groupBy("pattern", "value", "shape").agg(F.max("seed").alias("seed"), F.max("base").alias("base"))
    scored = cut(edges.withColumn("score", F.col("seed").cast("double")).withColumn("admitted", F.col("seed")))
    for _ in range(rounds):
        support = F.count_if(F.col("seed") | (F.col("score") >= accept))
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 0.1)).alias("confidence"), support.alias("support")).filter(F.col("support") >= min_seeds).drop("support")
        rated = cut(scored.select("pattern", "value", "shape", "seed", "base").join(patterns, "pattern", "left"))
        shapes = rated.groupBy("shape").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("s")).filter(F.col("s") >= least_shape).select("shape")
        inside = rated.filter("not seed and confidence is not null").join(shapes, "shape", "left_semi")
        values = inside.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("now"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("now", F.lit(0.0)))
        scored = cut(rated.join(values, "value", "left").select("pattern", "value", "shape", "seed", "base", score.alias("score"), (F.col("confidence") >= F.when(F.col("seed"), F.lit(accept)).otherwise(F.lit(0.0))).alias("admitted")))
    return scored.filter(~F.col("base") & F.col("admitted") & (F.col("score") >= accept)).select("pattern", "value")


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, context) of every row: arrays of spans."""
    found = cut(base_spans(docs, key, text))
    instances = cut(_instances(found))
    accepted = discover(instances)
    new = instances.filter("not base").join(accepted, ["pattern", "value"], "left_semi")
    # a number inside a longer find is no find of its own
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("end").over(before)).filter("reach is null or reach < end")
    new = new.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "value", F.lit("").alias("left")))).alias("context"))
    out = found.drop("token").join(new.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").drop("d", "h")
    return out.withColumn("context", F.coalesce("context", F.array().cast(f"array<{SPAN}>")))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; where spans overlap, the first one's kind stands for all."""
    names = docs.columns
    key, text = (f"c{names.index(x)}" for x in (key, text))
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name of docs can clash with those used here
    found = pii_spans(docs, key, text)
    kinds = (*KINDS, "context")
    # transform hands a second parameter the element's number, so the kind must come from the enclosing scope
    named = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    spans = F.concat(*map(named, kinds))
    held = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.array_sort(spans).alias("_spans")).filter(F.size("_spans") > 0).dropDuplicates(["_d", "_h"])
    rows = docs.withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(held, rows[key].eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left")
    t = F.col(text)

    def step(acc, s):
        gap = F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.array(F.concat(gap, F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    return joined.withColumn(text, F.when(F.col("_spans").isNotNull(), clean).otherwise(t)).select(*docs.columns).toDF(*names)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*(_named(F.col(k), k) for k in KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _named(F.col("context"), "context")), ",").alias("spans"))
