"""Row adapters: flat rows into documents of segments (role, text) with meta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most characters of a document, by adapter.
CAPS = {"text": 6000, "code": 6000, "qa": 4000, "mmlu": 4000, "conversations": 8000, "book": 120000}
MIN_PART, MIN_DOCUMENT = 200, 64
_BLANK = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, "")


def capped(text: Column, cap: int) -> Column:
    return F.substring(stripped(text), 1, cap)


def segment(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def text_rows(df: DataFrame, cap: int = CAPS["text"]) -> DataFrame:
    return df.withColumn("segments", F.array(segment("target", capped(F.col("text"), cap))))


def code_rows(df: DataFrame, cap: int = CAPS["code"], default_license: str = "unknown") -> DataFrame:
    """A row's own license goes before the source's."""
    return df.withColumns({
        "segments": F.array(segment("target", capped(F.col("text"), cap))),
        "license": F.coalesce(F.col("row_license"), F.lit(default_license)),
        "meta": F.create_map(F.lit("language"), F.col("lang"), F.lit("path"), F.col("source")),
    })


def qa_rows(df: DataFrame, cap: int = CAPS["qa"]) -> DataFrame:
    return df.withColumn("segments", F.array(
        segment("context", F.concat(F.lit("Question: "), capped(F.col("question"), cap))), segment("target", F.concat(F.lit("Answer: "), capped(F.col("answer"), cap)))
    ))


def choice_rows(df: DataFrame, cap: int = CAPS["mmlu"]) -> DataFrame:
    """Choices become lines with letters."""
    letters = F.transform("choices", lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    return df.withColumn("segments", F.array(segment("context", F.substring(F.concat(stripped(F.col("question")), F.lit("\n"), F.array_join(letters, "\n")), 1, cap))))


def conversation_rows(turns: DataFrame, cap: int = CAPS["conversations"]) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as documents; the assistant's turns are targets.

    The cap holds for the document: the turn that crosses it is cut, later ones go."""
    who = F.lower("role")
    role = F.when(who.isin("gpt", "assistant"), "target").otherwise("context")
    one = turns.select("conv_id", "turn", role.alias("role"), F.concat(F.lit("<"), who, F.lit("> "), F.coalesce("text", F.lit(""))).alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = one.withColumn("before", before).where(F.col("before") < cap)
    cut = cut.withColumn("text", F.substring(F.col("text"), F.lit(1), (F.lit(cap) - F.col("before")).cast("int")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text")))
    return cut.groupBy("conv_id").agg(listed.alias("segments"))


def book_parts(df: DataFrame, cap: int = CAPS["book"], min_part: int = MIN_PART) -> DataFrame:
    """(doc_id, part, text): a long text in parts of a third of the cap; short parts go."""
    size = cap // 3
    t = F.col("t")
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(greatest(length(t), 1) - 1) div {size}")), lambda i: F.substring(t, (i * size + 1).cast("int"), F.lit(size)))
    split = df.select("doc_id", capped(F.col("text"), cap).alias("t")).select("doc_id", F.posexplode(parts).alias("part", "text"))
    return split.where(F.length(stripped(F.col("text"))) >= min_part)


def usable(df: DataFrame, least: int = MIN_DOCUMENT) -> DataFrame:
    """Drops blank segments, then documents of too few characters."""
    kept = df.withColumn("segments", F.filter("segments", lambda s: stripped(s["text"]) != ""))
    total = F.aggregate("segments", F.lit(0), lambda acc, s: acc + F.length(s["text"]))
    return kept.withColumn("chars", total.cast("long")).where(F.col("chars") >= least)


def flatten(segments: Column, role: str | None = None) -> Column:
    chosen = F.filter(segments, lambda s: s["role"] == role) if role else segments
    return F.array_join(F.transform(chosen, lambda s: s["text"]), "\n")


def pairs(df: DataFrame) -> DataFrame:
    """Context and target of each document that has both."""
    return df.withColumns({"context": flatten(F.col("segments"), "context"), "target": flatten(F.col("segments"), "target")}).where("trim(context) <> '' AND trim(target) <> ''")


_ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def register_adapter(name: str, adapter: Callable[..., DataFrame]) -> None:
    _ADAPTERS[name] = adapter


def adapt(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name](df, **options)


for _name, _adapter in (("text", text_rows), ("code", code_rows), ("qa", qa_rows), ("mmlu", choice_rows), ("conversations", conversation_rows), ("book", book_parts)):
    register_adapter(_name, _adapter)
