"""Personal data by patterns, widened by bootstrapped contexts. DataFrame functions only.

Base matches of four kinds are seeds. The left context of a seed (its last words) is a lexical pattern; identifier-like
strings elsewhere that stand in the same pattern are instances. Spark scores the pattern-instance graph in rounds: a
pattern is as good as its instances, shrunk towards nothing while its support is small, an instance as good as its
patterns. Instances of high-confidence patterns become spans of kind `ctx`; base spans stay.

Defined results
- null or empty text: no spans; null doc_id: kept as any other row.
- repeated rows: each is a row of its own in the result and counts once per row as evidence.
- ties need no order: spans are sorted by kind and start. Extra columns are ignored. An empty table gives none.
- positions are code points, end exclusive.
- very long texts: taken whole, in time linear in the text for up to some hundred thousand matches of a kind. A pattern is
  read from the last CONTEXT code points before an identifier: an identifier behind a longer gap has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

# fixed values: the four base patterns, in forms whose matching time is linear in the text. A possessive run cannot
# change a match here; \G or the look-behind only keeps the engine from trying inside a run that failed from its start.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "ctx"]
_RUN = r"[^\s\x22\x27<>()\[\]{},;|]"
#: What may be an identifier: a run without white space or quotes that holds a digit, a sign between letters or a capital
#: behind a letter, of any length; a run with a digit goes on with the groups of digits behind it. The look-behind keeps
#: starts at the head of a run, so the time is linear. A plain word, small letters behind its first with no more than signs
#: up to white space, can be none and is passed over at once.
_PLAIN = r"\p{L}\p{Ll}*+[^\s\p{L}0-9]*+(?:\s|$)"
CANDIDATE = rf"(?<!{_RUN})(?!{_PLAIN})(?:(?={_RUN}*?[0-9]){_RUN}++(?:\x20[0-9][0-9\x20.-]*[0-9])?|(?={_RUN}*?\p{{L}}(?:[^\s\p{{L}}]++\p{{L}}|\p{{Lu}})){_RUN}++)"
_BYTE = r"(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"

SPAN = "struct<kind:string,start:long,end:long>"
#: Matches whose positions are summed at once.
CHUNK = 256
#: Code points before an identifier that its pattern is read from; the pattern is what the last words of them are.
CONTEXT = 40


def _luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits, from the right; every second digit is doubled."""
    parts = F.reverse(F.split(digits, ""))
    return F.aggregate(parts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda a, d: F.struct((a["sum"] + F.when(a["i"] % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).alias("sum"), (a["i"] + 1).alias("i")), lambda a: a["sum"] % 10 == 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15)


def _checked(kind: str):
    return lambda x: _valid(kind, x["value"])


MATCHES = "array<struct<value:string,start:long,end:long,before:string>>"


def _tail(*parts: Column) -> Column:
    return F.right(F.concat(*parts), F.lit(CONTEXT))


def located(text: Column, pattern: str) -> Column:
    """MATCHES: the leftmost non-overlapping matches, by code points, and the CONTEXT code points before each: what lies
    between the matches has their positions.

    Positions are summed within runs of CHUNK matches, then over the runs, so that a long list of numbers is not
    copied once a match. transform over an array of one binds a value that is used more than once.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def step(a, x):
        start = a["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["value"]), F.lit(0))
        match = F.struct(x["value"].alias("value"), start.alias("start"), end.alias("end"), _tail(a["tail"], x["gap"]).alias("before"))
        return F.struct(end.alias("at"), _tail(a["tail"], x["gap"], F.coalesce(x["value"], F.lit(""))).alias("tail"), F.when(x["value"].isNull(), a["found"]).otherwise(F.concat(a["found"], F.array(match))).alias("found"))

    def run(b, i):
        # a match has a code point at least, so CONTEXT matches before the run have its left context
        ahead = F.slice(b, F.greatest(i * CHUNK - CONTEXT, F.lit(0)) + 1, F.least(i * CHUNK, F.lit(CONTEXT)))
        tail = F.aggregate(ahead, F.lit(""), lambda t, x: _tail(t, x["gap"], x["value"]))
        zero = F.struct(F.lit(0).cast("long").alias("at"), tail.alias("tail"), F.array().cast(MATCHES).alias("found"))
        return F.aggregate(F.slice(b, i * CHUNK + 1, F.lit(CHUNK)), zero, step)

    def runs(b):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / CHUNK).cast("int")), lambda i: run(b, i))

    def joined(r):
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
        starts = F.aggregate(r, first, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        return F.flatten(F.zip_with(r, starts, lambda x, at: F.transform(x["found"], lambda m: F.struct(m["value"].alias("value"), (m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["before"].alias("before")))))

    return F.transform(F.transform(F.array(both), runs), joined)[0]


def base_spans(df: DataFrame) -> DataFrame:
    """doc_id, a column of MATCHES for each kind.

    One pass over the texts, without a shuffle.
    """
    out = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    none = F.array().cast(MATCHES)
    for kind, pattern in PATTERNS.items():
        may = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        may = may if kind == "email" else may & F.col("digit")
        out = out.withColumn(kind, F.when(may, F.filter(located(F.col("text"), pattern), _checked(kind))).otherwise(none))
    return out


def candidates(df: DataFrame) -> DataFrame:
    """base_spans without the text, plus seeds, the base spans, and cand, identifier-like strings:
    array<struct<value,start,end,left>>."""
    left = lambda x: F.lower(F.regexp_extract(x["before"], r"(\S+\s+\S*\s*\S{0,2})$", 1))
    placed = lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), left(x).alias("left"))
    out = df.withColumn("seeds", F.transform(F.flatten(F.array(*[F.col(k) for k in PATTERNS])), placed))
    return out.withColumn("cand", F.transform(located(F.col("text"), CANDIDATE), placed)).drop("text", "digit")


def free(occ: DataFrame, spans: DataFrame) -> DataFrame:
    """occ without the rows that touch one of spans in their text; both have row_id, start and end.

    They meet in blocks of 64 code points, which hold a bounded number of either, so that a long text full of both is no
    group of pairs.
    """
    blocks = lambda df: df.select("row_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("block"))
    met = blocks(occ).join(blocks(spans).withColumnsRenamed({"start": "s", "end": "e"}), ["row_id", "block"]).where("s < end AND start < e")
    return occ.join(met.select("row_id", "start"), ["row_id", "start"], "left_anti")


def discover(base: DataFrame, rounds: int = 3, shrink: float = 2.0, least: float = 0.7, support: int = 3) -> DataFrame:
    """row_id, array of SPANs that patterns of the base spans' contexts add.

    base: row_id, seeds and cand. shrink: unseen failures that a pattern is charged with; least: the score from
    which patterns and instances are believed; support: distinct seeds that a pattern needs.
    """
    of = lambda name, length=3: base.select("row_id", F.explode(name).alias("c")).select("row_id", "c.value", "c.start", "c.end", F.col("c.left").alias("pattern"), F.lit(name == "seeds").alias("seed")).where(F.length("pattern") >= length)
    # patterns under the support are never believed, so what else stands in them has no part
    spans = of("seeds", 0).select("row_id", "start", "end")
    seeds = cut(of("seeds").groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    supported = seeds.groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support).select("pattern")
    occ = cut(free(of("cand").join(supported, "pattern", "left_semi"), spans))
    # the graph: an edge for each pattern and instance, with what makes the instance a seed
    edges = seeds.unionByName(occ.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    graph = cut(edges.groupBy("pattern", "value").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")))
    scores = graph.select("value", F.col("seed").cast("double").alias("score")).groupBy("value").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        patterns = graph.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count("*") + shrink)).alias("trust"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        patterns = patterns.where(F.col("seeds") >= support)
        scores = cut(graph.join(patterns, "pattern", "left").groupBy("value").agg(F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("trust"), F.lit(0.0))).alias("score")))
    believed = patterns.where(F.col("trust") >= least)
    found = occ.join(believed.select("pattern"), "pattern").join(scores.where(F.col("score") >= least), "value")
    return found.groupBy("row_id").agg(F.collect_set(F.struct(F.lit("ctx").alias("kind"), "start", "end")).alias("added"))


def _spans(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find_pii(df: DataFrame, **parameters) -> DataFrame:
    """doc_id, base and added: sorted arrays of SPANs; one row for each of df's. parameters: of discover."""
    base = cut(candidates(base_spans(df)).withColumn("row_id", F.monotonically_increasing_id()))
    added = discover(base, **parameters)
    kinds = [_spans(kind) for kind in PATTERNS]
    none = F.array().cast(f"array<{SPAN}>")
    return base.join(added, "row_id", "left").select("doc_id", F.concat(*kinds).alias("base"), F.array_sort(F.coalesce("added", none)).alias("added"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
