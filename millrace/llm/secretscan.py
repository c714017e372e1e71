"""Secret scans, and linking of credentials that come in several parts.

Strong finds (assignments, access keys, long hex strings) are reported as they are.
Weak candidates (identifiers, short secrets, endpoints) are reported only where
complementary parts co-occur within a scope: an interval join of spans within the
same document.  All of it is built-in functions; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import materialize

#: Code points between the parts of one credential, at most; and the width of the join's bins.
SCOPE, BIN = 200, 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    part: str  # id, secret or endpoint: what it can be of a credential
    strong: bool
    value_group: int = 0
    value_least: int = 1


#: In the order in which spans of equal start are listed.  Patterns find maximal runs of a class
#: of characters, so a bound within the pattern drops the same matches as a bound on its result;
#: the assignment's value is bounded afterwards, as a short one still uses up its text.
KINDS = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", "secret", True, 2, 6),
    Kind("access", r"(AKIA[A-Z0-9]{16,})", "id", True),
    Kind("hex", r"([0-9a-f]{24,})", "secret", True),
    Kind("weak_id", r"""((?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]{3,}))""", "id", False),
    Kind("weak_secret", r"""((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{12,}(?![A-Za-z0-9+/_=-]))""", "secret", False),
    Kind("endpoint", r"""((?i:https?|wss?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?&=%+-]+)""", "endpoint", False),
]
SPAN = "array<struct<start:long,end:long,kind:int>>"


def _lengths(text: Column, kind: Kind) -> Column:
    """Lengths of the texts before each match, of the matches, and of the values; null without a match."""
    pattern = F.lit(kind.pattern)
    found = F.struct(
        F.transform(F.split(text, kind.pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length).alias("sizes"),
        (F.transform(F.regexp_extract_all(text, pattern, F.lit(kind.value_group)), F.length) if kind.value_group else F.lit(None).cast("array<int>")).alias("values"),
    )
    return F.when(text.rlike(kind.pattern), found)


def scan(spark: SparkSession, docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns of every row of docs (with text), and spans: start, end (exclusive, in code points)
    and kind (index in KINDS), by start, then kind.

    Strong spans are all reported.  A weak one is dropped if it overlaps a strong one of its
    document; an identifier or a secret is reported if its counterpart lies within SCOPE, an
    endpoint if both do.  Null and empty texts have no spans.  Rows are told apart by a key
    that is written with them, so repeated rows and null ids are safe; an empty table gives
    no rows.  Long texts are scanned whole.  A column of keep named spans gives way; others may have
    any name.  A document's spans meet in one task for its running positions; no text does.
    """
    keep = [c for c in keep if c.lower() != "spans"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("row"),
        *[_lengths(text, k).alias(f"k{i}") for i, k in enumerate(KINDS)],
    )
    found = materialize(spark, found, "matches")
    strong = [i for i, k in enumerate(KINDS) if k.strong]
    some = F.lit(False)
    for i in strong:
        some = some | F.col(f"k{i}").isNotNull()
    # without a strong find, a link needs a weak identifier; other documents have no spans
    for i, k in enumerate(KINDS):
        if k.part == "id":
            some = some | F.col(f"k{i}").isNotNull()
    relevant = some
    plain = found.where(~relevant).select("kept.*", F.array().cast(SPAN).alias("spans"))
    hits = found.where(relevant)

    pieces = None
    for i, _ in enumerate(KINDS):
        k = F.col(f"k{i}")
        zipped = F.arrays_zip(k["gaps"].alias("gaps"), k["sizes"].alias("sizes"), F.coalesce(k["values"], k["sizes"]).alias("values"))
        one = hits.where(k.isNotNull()).select("row", F.lit(i).alias("kind"), F.posexplode(zipped).alias("at", "m"))
        one = one.select("row", "kind", "at", F.col("m.gaps").alias("gap"), F.col("m.sizes").alias("size"), F.col("m.values").alias("value"))
        pieces = one if pieces is None else pieces.union(one)
    order = Window.partitionBy("row", "kind").orderBy("at")
    start = F.sum("gap").over(order) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = pieces.withColumn("start", start).where("size IS NOT NULL").withColumn("end", F.col("start") + F.col("size"))
    least = F.element_at(F.array(*[F.lit(k.value_least) for k in KINDS]), F.col("kind") + 1)
    spans = materialize(spark, spans.where(F.col("value") >= least).select("row", "start", "end", "kind"), "spans")

    linked = link(spans)
    listed = linked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("list"))
    ordered = F.transform("list", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    matched = hits.select("row", "kept").join(listed, "row", "left").select("kept.*", F.coalesce(ordered, F.array().cast(SPAN)).cast(SPAN).alias("spans"))
    return plain.unionByName(matched)


def link(spans: DataFrame) -> DataFrame:
    """The spans (row, start, end, kind) to report.  Spans meet by document and bin of the text."""
    part = F.element_at(F.array(*[F.lit(k.part) for k in KINDS]), F.col("kind") + 1)
    is_strong = F.element_at(F.array(*[F.lit(k.strong) for k in KINDS]), F.col("kind") + 1)
    typed = spans.withColumns({"part": part, "strong": is_strong})
    weak = typed.where(~F.col("strong")).withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / BIN), F.floor((F.col("end") + SCOPE) / BIN))))
    others = typed.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN)))).select(
        "row", "bin", F.col("start").alias("s"), F.col("end").alias("e"), F.col("part").alias("p"), F.col("strong").alias("other_strong")
    )
    near = (F.col("s") <= F.col("end") + SCOPE) & (F.col("e") >= F.col("start") - SCOPE)
    overlaps = (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))
    met = weak.join(others, ["row", "bin"]).where(near)
    judged = met.groupBy("row", "start", "end", "kind", "part").agg(
        F.max(F.col("other_strong") & overlaps).alias("covered"),
        F.max((F.col("p") == "id") & ~overlaps).alias("id"), F.max((F.col("p") == "secret") & ~overlaps).alias("secret"),
    )
    reported = F.when(F.col("part") == "id", F.col("secret")).when(F.col("part") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    kept = judged.where(~F.col("covered") & reported).select("row", "start", "end", "kind")
    return typed.where("strong").select("row", "start", "end", "kind").unionByName(kept)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the strong kinds, a digest of them, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def redact(found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Rows of scan() with text, in which every run of overlapping spans is replaced by mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("merged", lambda m: m["end"]))
    stops = F.concat(F.transform("merged", lambda m: m["start"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(begins.alias("a"), stops.alias("b")), lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")))
    return found.withColumn("merged", merged).withColumn("text", F.when(F.size("spans") > 0, F.array_join(pieces, mask)).otherwise(F.col("text"))).drop("merged", "spans")
