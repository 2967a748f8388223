"""Secrets in texts, with weak parts reported only where they complete a credential.

Three base patterns always report.  Weak candidates (identifiers, mixed strings and
endpoints that mean little alone) are joined with the other parts on overlapping
intervals: a candidate counts if a complementary part lies within ``REACH`` code points
of it in the same scope, a scope being a stretch of text without a blank line.  The join
is made by ordering a document's parts and looking at the nearest one on each side, so no
pairs are emitted.  DataFrame functions only; one shuffle, of spans and not of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 256
BLOCK = 256

# The base patterns.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # as runs are maximal, the same as dropping shorter runs

WEAK = "https?://[^\\x00-\\x20\"'<>]+|[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?::[0-9]{1,5})?|[A-Za-z0-9+/_-]{12,}"
BLANK = "\\n[\\x20\\t\\r]*\\n"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def _positions(lengths: Column) -> Column:
    """Begin and end of each match from (gap before it, its length), in order.

    Sums run over blocks of ``BLOCK`` matches, so the cost stays near linear in a text
    with very many matches.
    """
    count = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), count - 1, F.lit(BLOCK)), lambda b: F.slice(lengths, b + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda s: F.aggregate(s, F.lit(0), lambda acc, x: acc + x.gap + x.own))
    bases = F.transform(sums, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda acc, x: acc + x))

    def walk(block: Column, base: Column) -> Column:
        none = F.array().cast("array<struct<b:int,e:int>>")
        return F.aggregate(
            block,
            F.struct(none.alias("at"), base.alias("end")),
            lambda acc, x: F.struct(
                F.concat(
                    acc.at,
                    F.array(F.struct((acc.end + x.gap).alias("b"), (acc.end + x.gap + x.own).alias("e"))),
                ).alias("at"),
                (acc.end + x.gap + x.own).alias("end"),
            ),
            lambda acc: acc.at,
        )

    return F.flatten(F.zip_with(blocks, bases, walk))


def _located(rows: DataFrame, name: str, pattern: str, where: Column | None = None) -> DataFrame:
    """Adds ``name``: begin, end and text of every leftmost non-overlapping match."""
    text = F.col("text") if where is None else F.when(where, F.col("text"))
    found = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found)
    gaps = F.split("text", pattern, -1)
    lengths = F.zip_with(
        F.slice(gaps, 1, F.size("_found")), "_found", lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))
    )
    rows = rows.withColumn("_lengths", F.when(F.size("_found") > 0, lengths))
    place = F.zip_with(_positions(F.col("_lengths")), "_found", lambda p, m: F.struct(p.b.alias("b"), p.e.alias("e"), m.alias("m")))
    empty = F.array().cast("array<struct<b:int,e:int,m:string>>")
    return rows.withColumn(name, F.when(F.size("_found") > 0, place).otherwise(empty)).drop("_found", "_lengths")


def _weak_kind(m: Column) -> Column:
    dotted = m.rlike("^https?://|^[0-9]{1,3}(\\.[0-9]{1,3}){3}")
    upper, lower, digit = m.rlike("[A-Z]"), m.rlike("[a-z]"), m.rlike("[0-9]")
    return (
        F.when(dotted, "endpoint")
        .when(upper & digit & m.rlike("^[A-Z0-9]+$"), "weak_id")
        .when((F.length(m) >= 20) & upper & lower & digit, "weak_secret")
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (digest of the text) and ``parts`` (kind, begin, end), the weak ones unlinked."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("weak", WEAK)):
        rows = _located(rows, name, pattern)
    rows = _located(rows, "breaks", BLANK, F.size("weak") > 0)
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))

    def part(kind: Column, x: Column) -> Column:
        return F.struct(kind.alias("kind"), x.b.alias("b"), x.e.alias("e"))

    def plain(name: str, kind: str) -> Column:
        return F.transform(name, lambda x: part(F.lit(kind), x))

    nothing = F.array().cast("array<struct<kind:string,b:int,e:int>>")
    assign = F.filter(
        F.transform(F.zip_with("assign", values, lambda x, v: F.struct(x.b, x.e, F.length(v).alias("n"))),
                    lambda x: F.when(x.n >= 6, part(F.lit("assign"), x))),
        lambda x: x.isNotNull(),
    )
    access = F.transform(F.filter("access", lambda x: x.e - x.b >= 20), lambda x: part(F.lit("access"), x))
    weak = F.filter(F.transform("weak", lambda x: part(_weak_kind(x.m), x)), lambda x: x.kind.isNotNull())
    rows = rows.withColumn("loose", weak)
    breaks = F.when(F.size("loose") > 0, plain("breaks", "break")).otherwise(nothing)
    parts = F.concat(F.coalesce(assign, nothing), access, plain("hex", "hex"), "loose", breaks)
    return rows.select("id", F.sha2("text", 256).alias("key"), parts.alias("parts"))


def link(parts: DataFrame) -> DataFrame:
    """``id``, ``key``, ``spans`` (sorted, weak ones only where linked); repeated rows are kept."""
    flat = parts.select("id", "key", F.posexplode_outer("parts").alias("pos", "part")).select(
        "id", "key", F.coalesce(F.col("pos") == 0, F.lit(True)).alias("head"), "part.*"
    )
    order = Window.partitionBy("id", "key").orderBy("b", "e", "kind")
    past, coming = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    kind = F.col("kind")
    roles = {
        "name": kind.isin("access", "weak_id"),
        "secret": kind.isin("assign", "hex", "weak_secret"),
        "place": kind == "endpoint",
        "base": kind.isin("assign", "access", "hex"),
        "break": kind == "break",
    }
    for role, of in roles.items():
        flat = flat.withColumn(f"{role}_before", F.max(F.when(of, F.col("e"))).over(past))
        flat = flat.withColumn(f"{role}_after", F.min(F.when(of, F.col("b"))).over(coming))

    def near(role: str) -> Column:
        before, after = F.col(f"{role}_before"), F.col(f"{role}_after")
        left = (before >= F.col("b") - REACH) & (before > F.coalesce("break_before", F.lit(-1)))
        right = (after <= F.col("e") + REACH) & (after < F.coalesce("break_after", F.lit(2**31 - 1)))
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    apart = F.coalesce(F.col("base_before") <= F.col("b"), F.lit(True)) & F.coalesce(F.col("base_after") >= F.col("e"), F.lit(True))
    linked = (
        ((kind == "weak_id") & near("secret"))
        | ((kind == "weak_secret") & (near("name") | near("place")))
        | ((kind == "endpoint") & near("secret"))
    )
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    span = F.struct("b", rank.alias("rank"), "e", "kind")
    kept = F.when(roles["base"] | (linked & apart), span)
    grouped = flat.groupBy("id", "key").agg(
        F.array_sort(F.collect_set(kept)).alias("spans"), F.sum(F.col("head").cast("int")).alias("rows")
    )
    return grouped.select("id", "key", "spans", F.explode(F.sequence(F.lit(1), "rows"))).drop("col")


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.b, s.e)), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, begin, end; sorted by begin, then kind) for every row.

    Positions are code points, ends exclusive.  Null counts as an empty text and has no
    spans.  Repeated rows give one result each.  Other columns are not read.
    """
    return link(candidates(docs, id_col, text_col)).select(F.col("id").alias(id_col), "spans")
