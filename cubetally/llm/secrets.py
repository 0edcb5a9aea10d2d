"""Secret scans: strong patterns, and weak credential parts linked by an interval join.

Strong (base) spans stand alone: ``assign`` (a secret-like name with a value of 12 or more characters),
``access`` (an access key identifier) and ``hex`` (a run of 16 or more hex digits).  Weak parts mean little
alone: a short assigned value or a bare mixed token (``weak``), a login or client name (``login``), an
endpoint address (``endpoint``).  A weak part is reported only when a complementary part lies within SCOPE
code points of it: secrets complement logins, access identifiers and endpoints, and the other way round.

The linking is an equi-join on (document, scope cell) with a range condition.  A cell of SCOPE code points
holds a bounded number of spans, so the join's size is linear in the spans, whatever a document's length.

DataFrame functions only.  Positions come from splitting a text at its matches: gap and match lengths are
summed in chunks of CHUNK, so a text with m matches costs about m * CHUNK steps.

Cases: null or empty text has no span and the sha256 of the empty string; null doc_id is a value like any
other; rows that repeat an id keep one output row each (an id with several texts is told apart by text
hash); an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm.shared import written

SCOPE = 240
CHUNK = 32

# fixed values: the base patterns
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so this drops just the shorter ones
# weak parts
LOGIN = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE]|_?[iI][dD])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT](?:_?[iI][dD])?|[kK][eE][yY]_?[iI][dD])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"[A-Za-z][A-Za-z0-9+-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"
BARE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{24,}"

BASE = ("assign", "access", "hex")
WEAK = ("weak", "login", "endpoint")
ORDER = {k: i for i, k in enumerate(BASE + WEAK)}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def positions(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with their gaps, as struct(gaps, found); evaluated where there is a match only."""
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


def located(parts: Column) -> Column:
    """array<struct<start, end, value>> of the matches in ``parts``; one pass over chunked prefix sums."""
    gaps, found = parts["gaps"], parts["found"]
    steps = F.transform(found, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(found) / CHUNK).cast("int") - 1, F.lit(0)))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def place(x: Column, i: Column, all_steps: Column, before: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        end = F.get(before, c) + total(F.slice(all_steps, c * CHUNK + 1, i - c * CHUNK + 1))
        return F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"))

    sums = F.transform(chunks, lambda c: total(F.slice(steps, c * CHUNK + 1, F.lit(CHUNK))))
    # arrays of arrays bind the sums once, so that the lambdas below do not compute them again for each match
    bound = F.transform(F.array(F.struct(steps.alias("steps"), sums.alias("sums"))), lambda b: F.struct(b["steps"].alias("steps"), F.transform(b["sums"], lambda _, c: total(F.slice(b["sums"], F.lit(1), c))).alias("before")))
    return F.flatten(F.transform(bound, lambda b: F.transform(found, lambda x, i: place(x, i, b["steps"], b["before"]))))


def spans_of(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(ORDER[kind]).alias("kind"), m["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans), weak (spans that need a partner) for each row; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("array<struct<start:int,end:int,value:string>>")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "login": LOGIN, "endpoint": ENDPOINT, "bare": BARE}
    first = {"access": F.contains(text, F.lit("AKIA")), "endpoint": F.contains(text, F.lit("://"))}
    df = documents.select("doc_id", text.alias("text"))
    # first a test without allocation, then the parts of the few rows that have a match
    df = df.select("doc_id", "text", *[F.when(first.get(k, F.lit(True)) & F.rlike("text", F.lit(p)), positions(F.col("text"), p)).alias(k) for k, p in patterns.items()])
    df = df.select("doc_id", F.xxhash64("text").alias("text_hash"), *[F.when(F.col(k).isNotNull(), located(F.col(k))).otherwise(none).alias(k) for k in patterns])
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    df = df.select("doc_id", "text_hash", *[F.coalesce(k, nothing).alias(k) for k in patterns])
    value = lambda m: F.regexp_extract(m["value"], "^" + ASSIGN, 1)
    df = df.withColumn("long_assign", F.filter("assign", lambda m: F.length(value(m)) >= 12)).withColumn("short_assign", F.filter("assign", lambda m: F.length(value(m)).between(4, 11)))
    df = df.withColumn("base", F.concat(spans_of(F.col("long_assign"), "assign"), spans_of(F.filter("access", lambda m: m["end"] - m["start"] >= 18), "access"), spans_of(F.col("hex"), "hex")))
    mixed = F.filter("bare", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]"))
    weak = F.concat(spans_of(F.col("short_assign"), "weak"), spans_of(mixed, "weak"), spans_of(F.col("login"), "login"), spans_of(F.col("endpoint"), "endpoint"))
    return df.withColumn("weak", F.filter(weak, lambda w: ~F.exists("base", lambda b: overlaps(w, b)))).select("doc_id", "text_hash", "base", "weak")


def linked(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, added: the weak spans of ``candidates`` that have a complementary part within SCOPE."""
    key = ["doc_id", "text_hash"]
    some = rows.where(F.size("weak") > 0)
    parts = some.select(*key, F.explode(F.concat("base", "weak")).alias("s")).select(*key, "s.start", "s.kind", "s.end").distinct()
    secret = F.col("kind").isin(ORDER["assign"], ORDER["hex"], ORDER["weak"])
    cell = lambda c: F.floor(c / SCOPE)
    wanted = parts.where(F.col("kind") >= len(BASE)).withColumn("is_secret", secret)
    wanted = wanted.select("*", F.explode(F.sequence(cell(F.col("start") - SCOPE), cell(F.col("end") + SCOPE))).alias("cell")).alias("w")
    # a partner stands in the cell of its start and its end, and in those between
    partner = parts.withColumn("is_secret", secret).select("*", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell")).alias("p")
    near = (F.col("p.start") <= F.col("w.end") + SCOPE) & (F.col("w.start") <= F.col("p.end") + SCOPE)
    same = F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.text_hash") == F.col("p.text_hash")) & (F.col("w.cell") == F.col("p.cell"))
    kept = wanted.join(partner, same & near & (F.col("w.is_secret") != F.col("p.is_secret")), "left_semi")
    kept = kept.select(*key, F.struct("start", "kind", "end").alias("s")).groupBy(*key).agg(F.collect_set("s").alias("added"))
    return kept


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of ``documents``."""
    rows = written(candidates(documents), "secret-candidates")
    links = linked(rows).select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), "added")
    both = rows.join(links, rows["doc_id"].eqNullSafe(F.col("l_id")) & (rows["text_hash"] == F.col("l_hash")), "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == ORDER[k])).cast("long")
    added = F.coalesce("added", F.array().cast(SPAN))
    return both.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", added)).alias("spans"),
        F.size(added).cast("long").alias("n_linked"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
