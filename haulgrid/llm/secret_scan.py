"""Secret scanning with a ledger: every historical version is content-addressed, only unseen pairs of blob and rule
version are scanned, findings are joined back to all paths. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.llm.common import stored, writing


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping, of which `value` (a group) has `least` characters or more."""

    kind: str
    pattern: str
    value: int
    least: int
    version: int = 1


SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEY_WORDS = "|".join(["password", "passwd", "secret", "token", "api_?key"])
#: Fixed patterns. A run of hex digits is matched whole, so its least length can stand in the pattern; the same holds
#: for upper-case runs after AKIA. An assignment's value is matched first and measured then.
RULES = (
    Rule("assign", rf"""({either_case(KEY_WORDS)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) in code points, end exclusive.

    The text between matches comes from splitting at them; summed lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = found if rule.value == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.value))
    lengths = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")), lambda x: F.struct(
        F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("own"), F.coalesce(F.length(x["v"]), F.lit(0)).alias("value")))
    empty = F.array().cast(SPANS)
    walked = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["own"]).alias("at"),
            F.when(
                x["value"] >= rule.least,
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["gap"] + x["own"]).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.when(text.rlike(rule.pattern), walked["spans"]).otherwise(empty)


LEDGER = f"blob string, spans {SPANS}, kind string, rule_version int"
_PAIR = ["blob", "kind", "rule_version"]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`blob, spans, kind, rule_version` for every blob and rule, blobs without a finding as well (empty spans).

    A column `seen` of `blobs` (array of kinds, may be null) names the rules that are not to be run on a blob.
    """
    def run(r: Rule, k: int) -> Column:
        spans = rule_spans(F.col("text"), r, k)
        return F.when(~F.coalesce(F.array_contains("seen", r.kind), F.lit(False)), spans) if "seen" in blobs.columns else spans

    scanned = blobs.select("blob", *[run(r, k).alias(r.kind) for k, r in enumerate(rules)])
    rows = F.explode(F.array(*[F.struct(F.col(r.kind).alias("spans"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules]))
    return scanned.select("blob", rows.alias("r")).select("blob", "r.*").filter(F.col("spans").isNotNull())


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows of the rules' present versions; over a stored ledger the filter chooses folders."""
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | ((F.col("kind") == r.kind) & (F.col("rule_version") == r.version))
    return ledger.filter(wanted)


def _addressed(versions: DataFrame) -> DataFrame:
    return versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def _unseen(addressed: DataFrame, paths: DataFrame, current: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the pairs of blob and rule version that `current` lacks; only those are scanned."""
    firsts = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if current is not None:
        seen = current.groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        firsts = firsts.join(seen, "blob", "left").filter(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    own = firsts.withColumnRenamed("path", "_path")
    same = addressed["path"].eqNullSafe(own["_path"]) & (addressed["blob"] == own["blob"])
    texts = addressed.join(own, same).select(addressed["blob"], "text", *(["seen"] if current is not None else []))
    return scan_blobs(texts, rules).dropDuplicates(_PAIR)


def _joined(paths: DataFrame, known: DataFrame) -> DataFrame:
    hits = known.filter(F.size("spans") > 0).dropDuplicates(_PAIR)
    found = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan `versions` (`path`, `text`): returns (`path, blob, spans` for every version, new ledger rows).

    A blob is addressed by the SHA-256 of its text (null: empty), so copies under other paths and unchanged later versions
    are scanned once. `ledger` (`blob, spans, kind, rule_version`) holds earlier scans; a blob is scanned again only for
    rules whose present version it lacks. Texts are drawn by (blob, path), so a blob that a third of the rows share is
    one row of that join; findings return by blob, a join that only has blobs with findings on its small side.
    Every row of `versions` gives one row, repeated rows too; an empty table gives none.
    """
    addressed = _addressed(versions)
    paths = stored(addressed.select("path", "blob"), "paths")
    current = None if ledger is None else _current(ledger, rules)
    fresh = stored(_unseen(addressed, paths, current, rules), "ledger")
    known = fresh if current is None else fresh.unionByName(current.select(*fresh.columns))
    return _joined(paths, known), fresh


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger stored in `folder` by earlier scans; None where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(folder)


def scan_into(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan `versions` (`path`, `text`) against the ledger stored in `folder` and append what was unseen: `path, blob, spans`.

    The ledger has a folder per kind and rule version: a scan reads only the rules' present ones, and a rule whose version rises
    starts an empty one, so all blobs are scanned anew for that rule alone. Findings are joined from the stored rows. A scan
    that is cut off leaves whole rows, which the next one finds and does not scan again; two scans at once may both
    store a pair, which counts once. The guarantees of `scan_versions` on nulls, copies and repeated rows hold.
    """
    spark = versions.sparkSession
    ledger = read_ledger(spark, folder)
    addressed = _addressed(versions)
    paths = stored(addressed.select("path", "blob"), "paths")
    fresh = _unseen(addressed, paths, None if ledger is None else _current(ledger, rules), rules)
    with writing(spark):
        fresh.write.mode("append").partitionBy("kind", "rule_version").option("compression", "zstd").parquet(folder)
    return _joined(paths, _current(spark.read.schema(LEDGER).parquet(folder), rules))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
