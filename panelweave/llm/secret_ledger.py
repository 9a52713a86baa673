"""Incremental secret scans over content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. Two tables live in a folder between
runs: `versions` says which blobs each path has ever held, and `ledger` says which blob was
scanned under which rule version and what was found. A run adds the versions that it meets
for the first time, scans only those pairs of blob and rule version that the ledger lacks,
and joins the ledger back to every path that holds the blob. A rule that changes gets a new
version number: blobs are then scanned again under that rule alone, and findings of its
earlier versions stay in the ledger but count no longer. All of it is DataFrame functions.

Texts move only where their blob has something to scan. Positions are sums over the matches
of one blob, so a text with very many hits takes time in proportion to them, and a blob on
very many paths meets them in a join that Spark can split.

Runs at once, or one that is repeated, may scan a pair twice; its findings count once.

Defined results: null text is the empty blob, without findings. Repeated rows each get the
findings of their blob; paths may be null or repeated. Spans are in code points, end
exclusive, over the whole match. Extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import saved

#: kind, version, pattern, group that must be long enough, its least length
RULES = (
    ("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def rule_key(kind: str, version: int) -> str:
    return f"{kind}@{version}"


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the folder, if there is one. A folder without files, as a first write that failed leaves it, is none."""
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def hits_of(text: Column, pattern: str, group: int) -> Column:
    """(gap, hit, held) of a rule's leftmost non-overlapping matches: the lengths of the piece before, of the match, and of the group; null without a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    both = F.zip_with(hits, held, lambda h, g: F.struct(F.length(h).alias("hit"), F.length(g).alias("held")))
    found = F.zip_with(pieces, both, lambda p, m: F.struct(F.length(p).alias("gap"), m["hit"].alias("hit"), m["held"].alias("held")))
    return F.when(F.regexp(text, F.lit(pattern)), found)


def scanned(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """blob_id, body and todo (rule keys) -> blob_id, rule and spans, a row for each rule of todo."""
    each = [F.struct(F.lit(rule_key(kind, version)).alias("rule"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.when(F.array_contains("todo", rule_key(kind, version)), hits_of(F.col("body"), pattern, group)).alias("hits")) for rank, (kind, version, pattern, group, least) in enumerate(rules)]
    tried = saved(blobs.select("blob_id", "todo", F.explode(F.array(*each)).alias("r")).filter(F.array_contains("todo", F.col("r.rule"))).select("blob_id", "r.*"))
    hits = tried.filter(F.col("hits").isNotNull()).select("blob_id", "rule", "rank", "kind", "least", F.posexplode("hits").alias("at", "m"))
    to_here = Window.partitionBy("blob_id", "rule").orderBy("at")
    end = F.sum(F.col("m.gap") + F.col("m.hit")).over(to_here).cast("int")
    spans = hits.withColumn("end", end).filter(F.col("m.held") >= F.col("least"))
    span = F.struct((F.col("end") - F.col("m.hit")).alias("start"), "rank", "end", "kind")
    spans = spans.groupBy("blob_id", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return tried.select("blob_id", "rule").join(spans, ["blob_id", "rule"], "left").select("blob_id", "rule", F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"))


def scan(versions: DataFrame, path: str, text: str, folder: str, rules: tuple = RULES) -> DataFrame:
    """path, blob_id and spans (sorted) of each row of versions; the tables in folder grow by what is new."""
    spark = versions.sparkSession
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("blob_id", F.sha2("body", 256))
    held = saved(texts.select("path", "blob_id"))
    before, ledger = stored(spark, folder, "versions"), stored(spark, folder, "ledger")
    new = held.distinct()
    if before is not None:
        new = new.join(before, new["path"].eqNullSafe(before["path"]) & (new["blob_id"] == before["blob_id"]), "left_anti")
    saved(new).write.mode("append").parquet(f"{folder}/versions")
    keys = F.array(*(F.lit(rule_key(kind, version)) for kind, version, *_ in rules))
    if ledger is None:
        unseen = texts.groupBy("blob_id").agg(F.first("body").alias("body")).withColumn("todo", keys)
        scanned(unseen, rules).write.mode("append").parquet(f"{folder}/ledger")
    else:
        seen = ledger.groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))  # as many as there are rule versions
        todo = F.array_except(keys, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        pairs = saved(held.select("blob_id").distinct().join(seen, "blob_id", "left").select("blob_id", todo.alias("todo")).filter(F.size("todo") > 0))
        if not pairs.isEmpty():
            unseen = texts.join(pairs, "blob_id").groupBy("blob_id").agg(F.first("body").alias("body"), F.first("todo").alias("todo"))
            scanned(unseen, rules).write.mode("append").parquet(f"{folder}/ledger")
    return held.join(current(spark, folder, rules), "blob_id", "left").select(F.col("path").alias(path), "blob_id", F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"))


def current(spark: SparkSession, folder: str, rules: tuple = RULES) -> DataFrame:
    """blob_id and spans (sorted) of each blob in which a rule of now has found something; a pair that two runs have scanned counts once."""
    ledger = stored(spark, folder, "ledger").filter(F.col("rule").isin(*(rule_key(kind, version) for kind, version, *_ in rules)) & (F.size("spans") > 0))
    once = F.transform(F.collect_set(F.struct("rule", "spans")), lambda r: r["spans"])
    return ledger.groupBy("blob_id").agg(F.array_sort(F.flatten(once)).alias("spans"))


def exposed(spark: SparkSession, folder: str, rules: tuple = RULES) -> DataFrame:
    """path, blob_id and spans of every version that a path has ever held and in which something was found."""
    return stored(spark, folder, "versions").join(current(spark, folder, rules), "blob_id").select("path", "blob_id", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start and then by kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    findings = scan(docs, key, text, folder)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return findings.select(key, *(count(rule[0]).alias(f"n_{rule[0]}") for rule in RULES), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob_id")


def clear_stretches(found: DataFrame) -> DataFrame:
    """blob_id and spans -> blob_id and clear: (start, size) of what lies before each stretch of overlapping spans, and after the last (size null)."""
    spans = found.select("blob_id", F.explode("spans").alias("s")).select("blob_id", "s.start", "s.end")
    ordered = Window.partitionBy("blob_id").orderBy("start", "end")
    until = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max("end").over(Window.partitionBy("blob_id"))
    opened = spans.withColumn("until", until).withColumn("last", last).filter("start >= until")
    before = F.collect_list(F.struct(F.col("until").alias("start"), (F.col("start") - F.col("until")).alias("size")))
    after = F.array(F.struct(F.max("last").alias("start"), F.lit(None).cast("int").alias("size")))
    return opened.groupBy("blob_id").agg(F.concat(F.array_sort(before), after).alias("clear"))


def redacted(text: Column, clear: Column, mark: str = "[REDACTED]") -> Column:
    """The clear stretches of the text with a mark between any two; null stays null."""
    return F.array_join(F.transform(clear, lambda c: F.substring(text, c["start"] + 1, F.coalesce(c["size"], F.length(text)))), mark)
